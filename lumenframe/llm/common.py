"""Shared helpers: lineage cuts in the cluster's shared folder, ASCII words, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that removes a query's shuffle files when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set and all runs on this
    machine, as in tests; on a cluster that is an error, for executors would not see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; `by` is a column to lay folders out by.

    The lineage ends at files that every executor sees, so losing an executor costs only its running tasks. Spark removes the
    shuffle files behind a cut as soon as it is written, instead of when the driver next collects its garbage.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*cuts: DataFrame, folders: Iterable[str] = ("",)) -> None:
    """Delete the files of cuts, or of some of their folders, that nothing reads any more."""
    bare = lambda path: re.sub(r"^[a-z0-9]+:/+", "/", path)
    for df in cuts:
        sc, top = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
        names = {bare(f).removeprefix(bare(top) + "/").split("/")[0] for f in df.inputFiles() if bare(f).startswith(bare(top) + "/")}
        for path in (sc._jvm.org.apache.hadoop.fs.Path(f"{top}/{name}/{folder}".rstrip("/")) for name in names for folder in folders):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    lower() is the fast path. Only U+0130 and U+212A have lower-case forms with ASCII letters; texts that
    hold them take the slower translate(). Other letters beyond ASCII may change case but stay beyond ASCII.
    """
    odd = text.contains("\u0130") | text.contains("\u212a")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def runs(batches: Iterable, key: str) -> Iterator:
    """The pandas rows of each run of one key, put together over batches. The caller bounds the runs."""
    import numpy as np
    import pandas as pd

    held: list[pd.DataFrame] = []
    for batch in batches:
        at = batch[key].to_numpy()
        ends = [*(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(batch)] if len(batch) else []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            if held and held[0][key].iloc[0] != at[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def hooked(edges: DataFrame) -> DataFrame:
    """Hang every node on its smallest smaller neighbour, then jump pointers until all point at roots.

    edges: (a, b) with a < b. Returns (node, root) for every b. Parents are strictly smaller, so there is no cycle.
    """
    up = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hook")
    while True:
        above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        step = cut(up.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jump")
        up = step.select("node", "root")
        if step.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """Connected components by distributed union-find: hook, compress, contract, repeat.

    edges: two columns (a, b) of ids; loops and nulls are ignored. Returns (node, component) for the nodes of
    some edge, component being the smallest id reachable. Each round leaves at most half of the roots that
    still have edges, so there are O(log n) rounds; nothing is collected to the driver.
    """
    clean = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut(clean, "edges")
    labels = None
    while not rest.isEmpty():
        roots = hooked(rest)
        if labels is None:
            labels = roots
        else:
            moved = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left")
            labels = cut(moved.select("node", F.coalesce("higher", "root").alias("root")).union(roots.join(labels, "node", "left_anti")), "labels")
        to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = rest.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        rest = cut(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tops = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.union(tops.join(labels, "node", "left_anti")).select("node", F.col("root").alias("component"))


def regrouped(groups: DataFrame | None, edges: DataFrame) -> DataFrame:
    """What `components` gives for the edges behind groups, its earlier result, and these ones together.

    Edges go between the groups of their ends, so what is connected already isn't walked again.
    """
    if groups is None:
        return cut(components(edges), "groups")
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    tops = cut(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "tops")
    higher = tops.select(F.col("node").alias("component"), F.col("component").alias("higher"))
    old = groups.join(higher, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    return cut(old.union(tops.join(groups, "node", "left_anti")), "groups")
