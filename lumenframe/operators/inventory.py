"""Acquisition inventories and catalogs: the tabular side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mixed_date(text: Column) -> Column:
    """MM/DD/YYYY, YYYYMMDD or YYYY-MM-DD; null for anything else."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("MM/dd/yyyy", "yyyyMMdd", "yyyy-MM-dd")])


def clock(text: Column) -> Column:
    """HHMMSS of HH:MM:SS, HHMMSS or HHMMSS.fraction."""
    return F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 6)


def says(column: str, word: str) -> Column:
    """Whether the text holds the word in any case; a null holds nothing."""
    return F.coalesce(F.lower(F.col(column)).contains(word.lower()), F.lit(False))


def refine_modality(rows: DataFrame) -> DataFrame:
    """NM series by their description: QSPECT first, then Recon, then Bed."""
    nm = F.col("modality") == "NM"
    new = F.when(nm & says("description", "QSPECT"), "NM-QSPECT").when(nm & says("description", "Recon"), "NM-SPECT").when(nm & says("description", "Bed"), "NM-Projections")
    return rows.withColumn("modality", F.coalesce(new, F.col("modality")))


# What is of no use for dosimetry. (modality or None for any, word in the description or None for any, whether a row that
# holds the word goes or one that doesn't.)
UNWANTED = [
    ("NM", None, True),
    ("PT", None, True),
    ("SR", None, True),
    ("NM-SPECT", None, True),
    (None, "CRF", True),
    (None, "00001", True),
    ("RTSTRUCT", "Reviewed", False),
    ("CT", "ARMS", True),
    ("CT", "WB", True),
    ("CT", "stnd", True),
]


def of_use(rows: DataFrame, project: str, unwanted: Sequence[tuple[str | None, str | None, bool]] = UNWANTED) -> DataFrame:
    """Rows of the project that no line of the table names. Missing texts hold no word; a missing modality is none of those named."""
    named = ~says("patient", project)
    for modality, word, holds in unwanted:
        text = F.lit(True) if word is None else says("description", word) == F.lit(holds)
        named |= text if modality is None else F.coalesce(F.col("modality") == modality, F.lit(False)) & text
    return rows.where(~named)


def assign_cycles(rows: DataFrame, patient: str, date: str, gap_days: int = 10) -> DataFrame:
    """Number each patient's treatment cycles: a new one starts gap_days or more after the previous distinct date."""
    days = rows.select(patient, date).distinct()
    w = Window.partitionBy(patient).orderBy(date)
    new = F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)) >= gap_days, F.lit(True))
    days = days.withColumn("_new", new.cast("int")).withColumn("cycle", F.sum("_new").over(w).cast("int")).drop("_new")
    return rows.join(days, [patient, date])


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in a full order, so reruns keep the same one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def timepoints(rows: DataFrame, patient: str, date: str, has_structures: Column) -> DataFrame:
    """Only patients with some row for which has_structures holds; label dates TP1, TP2, ... per patient."""
    keep = rows.where(has_structures).select(patient).distinct()
    rank = F.dense_rank().over(Window.partitionBy(patient).orderBy(date))
    return rows.join(keep, patient, "left_semi").withColumn("timepoint", F.concat(F.lit("TP"), rank))


def cycle_mismatches(rows: DataFrame, text: str, cycle: str, most: int = 6) -> DataFrame:
    """Rows whose text names cycles (cycle_1 or cycle1) of which none, up to `most`, is the column's."""
    named = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"cycle_?(\d+)"), 1), lambda d: d.cast("int"))
    low = F.filter(named, lambda d: d <= most)
    return rows.withColumn("named", low).where((F.size("named") > 0) & ~F.array_contains("named", F.col(cycle)))


def split_parameters(text: Column, fields: Sequence[tuple[str, str]], sep: str = "_") -> list[Column]:
    """Typed columns of a delimited parameter text; a part that doesn't cast is null."""
    parts = F.split(text, sep)
    return [F.get(parts, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]


def top_series(rows: DataFrame, group: str, size: Column, count: Column, per_slice: int, least: int, k: int, order: Sequence[str]) -> DataFrame:
    """Per group the k largest series with at least `least` slices; an unknown size is count * per_slice."""
    big = F.coalesce(size, count * per_slice)
    w = Window.partitionBy(group).orderBy(big.desc(), *order)
    return rows.where(count >= least).withColumn("bytes", big).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def match_names(left: DataFrame, right: DataFrame, key: str, prefix: str, name: str, order: str) -> DataFrame:
    """Pair rows with equal keys where right.name contains left.prefix; the last match by `order` wins. An equi-join with a filter."""
    pairs = left.join(right, key).where(F.col(name).contains(F.col(prefix)))
    return pairs.groupBy(key, prefix).agg(F.max_by(name, order).alias("matched"))


def first_existing(cases: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """For each case the value of the first table that has it: left joins and coalesce."""
    out, names = cases, []
    for i, (table, column) in enumerate(tables):
        out = out.join(table.select(key, F.col(column).alias(f"_{i}")), key, "left")
        names.append(f"_{i}")
    return out.withColumn("found", F.coalesce(*names)).drop(*names)


def complete_cases(files: DataFrame, case: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Cases with a file of every kind."""
    return files.where(F.col(kind).isin(list(kinds))).groupBy(case).agg(F.countDistinct(kind).alias("n")).where(F.col("n") == len(kinds)).select(case)


def seeded_split(rows: DataFrame, key: str, seed: int, share: float, buckets: int = 10_000) -> DataFrame:
    """A validation flag by a seeded hash of the key: reruns and machines agree, and no shuffle is needed."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % buckets
    return rows.withColumn("validation", h < int(share * buckets))


def k_folds(rows: DataFrame, key: str, folds: int, labeled: int, group: str) -> DataFrame:
    """Fold by key; the first `labeled` rows of each group by key are labeled."""
    w = Window.partitionBy(group).orderBy(key)
    return rows.withColumns({"fold": (F.col(key) % folds).cast("int"), "labeled": F.row_number().over(w) <= labeled})


def speedups(rows: DataFrame, operation: str, backend: str, value: str, base: str, other: str) -> DataFrame:
    """Pair the medians of two backends per operation and report count, mean, min and max of base / other."""
    wide = rows.groupBy(operation, "size").pivot(backend, [base, other]).agg(F.percentile(value, 0.5))
    ratio = F.try_divide(base, other)
    return wide.where(ratio.isNotNull()).groupBy(operation).agg(F.count("*").alias("n"), F.avg(ratio).alias("mean"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))


def from_sidecars(files: DataFrame, images: DataFrame) -> DataFrame:
    """A catalog of image files by their JSON sidecars, largest first: file, size_category (the folder's name), dimensions, spacing,
    modality, size_mb. files: path and text of *_metadata.json files; images: the paths (file) that exist. Sidecars that don't parse are left out."""
    schema = "nifti_file string, dimensions array<int>, spacing array<double>, modality string, size_mb double"
    read = files.where(F.col("path").endswith("_metadata.json")).select(F.element_at(F.split("path", "/"), -2).alias("size_category"), F.from_json("text", schema).alias("m"))
    rows = read.where("m.nifti_file is not null").select(F.col("m.nifti_file").alias("file"), "size_category", "m.dimensions", "m.spacing", "m.modality", "m.size_mb")
    return rows.join(images.select("file").distinct(), "file", "left_semi").orderBy(F.desc("size_mb"), "file")


def by_size_class(catalog: DataFrame, classes: Sequence[str] = ("large", "xlarge")) -> DataFrame:
    """(size_category, file): the files of the given classes in order of class and name, a row per file."""
    return catalog.where(F.col("size_category").isin(list(classes))).select("size_category", "file").orderBy("size_category", "file")


def series_list(spark: SparkSession, path: str) -> DataFrame:
    """Series of a collection from saved JSON answers of a catalog service: an array of objects a file, columns as they are named there."""
    return spark.read.option("multiLine", "true").json(path)


def inventory_walk(files: DataFrame, readable: Column) -> DataFrame:
    """One row per folder: its first readable file in order of path. files: path, and whatever readable looks at."""
    rows = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return first_rows(rows.where(readable), ["folder"], ["path"])


def tidy_results(results: DataFrame, name: str, text: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """A result table with its row name first, then the parameters parsed from a delimited text, then the numbers."""
    rest = [c for c in results.columns if c not in (name, text)]
    return results.select(name, *split_parameters(F.col(text), fields), *rest)


def write_report(rows: DataFrame, path: str) -> None:
    """A result table as CSV with a header line, one folder of files; an existing one is replaced."""
    rows.write.mode("overwrite").option("header", "true").csv(path)
