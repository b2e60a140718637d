"""A table store for image rows: one Parquet folder per group, looked up by group and dataset name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_images(images: DataFrame, path: str, group: str) -> DataFrame:
    """Append images to a group; datasets are named by a hash of group and image_id, so a rerun names them alike.

    Map and struct columns of metadata are stored as JSON text. Files are sorted by name and hold Bloom filters of names, so a lookup opens
    the row groups that may hold its image alone. Returns (image_id, dataset_name).
    """
    plain = images.select(*(F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in images.dtypes))
    named = plain.withColumn("dataset_name", F.md5(F.concat(F.lit(f"{group}/"), F.col("image_id").cast("string")))).withColumn("group", F.lit(group))
    named.sortWithinPartitions("group", "dataset_name").write.mode("append").option("parquet.bloom.filter.enabled#dataset_name", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("group").parquet(path)
    return named.select("image_id", "dataset_name")


def load_images(spark: SparkSession, path: str, group: str, dataset_name: str | None = None, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Images of a group; both filters reach the scan: the group prunes folders, the name is pushed to Parquet, where it skips row groups.

    metadata names the columns that were saved as JSON text and their types, and restores them.
    """
    rows = spark.read.parquet(path).where(F.col("group") == group)
    rows = rows if dataset_name is None else rows.where(F.col("dataset_name") == dataset_name)
    return rows.withColumns({c: F.from_json(c, kind) for c, kind in (metadata or {}).items()})
