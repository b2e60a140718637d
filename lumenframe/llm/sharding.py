"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, documents


class Capacities:
    """A balanced (treap) tree of (remaining capacity, bin); priorities are a fixed hash, so runs agree."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = Capacities._split(node[3], key)
            return node, right
        left, node[2] = Capacities._split(node[2], key)
        return left, node

    @staticmethod
    def _merge(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Capacities._merge(a[3], b)
            return a
        b[2] = Capacities._merge(a, b[2])
        return b

    def add(self, left: int, place: int) -> None:
        priority = ((left * 0x9E3779B97F4A7C15 + place * 0xBF58476D1CE4E5B9) ^ (place << 17)) % 0xFFFFFFFFFFFFFFC5
        a, b = self._split(self.root, (left, place))
        self.root = self._merge(self._merge(a, [(left, place), priority, None, None]), b)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the tightest (remaining, bin) that holds `least`."""
        a, b = self._split(self.root, (least, -1))
        if b is None:
            self.root = a
            return None
        parent, node = None, b
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            b = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(a, b)
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item. Items go in falling size (ties by position) to the tightest bin that holds them.

    A new bin opens only when none fits; items above the capacity get a bin of their own. With `most`, None as soon
    as more bins would be needed.
    """
    tree, bins, at = Capacities(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            if most is not None and bins >= most:
                return None
            found, bins = (capacity, bins), bins + 1
        left, place = found
        at[i] = place
        tree.add(max(left - sizes[i], -1), place)
    return at


def best_fit_runs(runs: Sequence[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best fit decreasing of (size, count) runs, sizes falling: (run, bin, how many) in order.

    Equal items follow each other into the tightest bin for as long as they fit, for it stays the tightest. So a run costs as much
    as it meets bins, and the bins are those of best_fit_decreasing on the single items.
    """
    tree, bins, out = Capacities(), 0, []
    for i, (size, count) in enumerate(runs):
        while count:
            found = tree.take(size)
            if found is None:
                if most is not None and bins >= most:
                    return None
                found, bins = (capacity, bins), bins + 1
            left, place = found
            n = min(count, max(left // size, 1))
            out.append((i, place, n))
            tree.add(max(left - n * size, -1), place)
            count -= n
    return out


def pack(runs: Sequence[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing at the smallest capacity, found by bisection, that needs at most `shards` bins."""
    if not runs:
        return []
    low = max(runs[0][0], -(-sum(s * n for s, n in runs) // shards))
    high, best = low, None
    while (best := best_fit_runs(runs, high, shards)) is None:
        high = high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        if (found := best_fit_runs(runs, middle, shards)) is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], cells: int, name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in (hash cell, order); a group may hold any share of all rows.

    Cells are hashes of the order columns. Rows are counted per cell first, and each cell is numbered in a task of its own.
    """
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(*order))
    found = dealt.withColumn("row", row).join(starts, [*by, "cell"])
    return found.withColumn(name, (F.col("start") + F.col("row") - 1).cast("long")).drop("cell", "start", "row")


def shard_documents(docs: DataFrame, shards: int = 16, cells: int = 256) -> DataFrame:
    """Put documents into fixed shards of near equal bytes by best fit decreasing; equal texts stay together.

    A document's size is the UTF-8 bytes of its text plus 1. Groups are equal texts (null counts as empty), and every group
    is an item of its own, whatever the table's size. What a packing hangs on is how many groups have each size, so one task packs runs
    of equal sizes: all of them sum up to the bytes B of the table, so there are at most sqrt(2 B) sizes (14 million for 100 TB). Groups of
    one size are numbered by hash and dealt to the bins as the plan says. Slots count rows within a shard.

    Returns doc_id, size, text_crc32, law = 'bytes', shard, slot, grown_shard (null under this law). Null doc_ids are
    ids like others, repeated rows get a slot each, an empty table gives an empty result, other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same")), "rows")
    groups = cut(rows.groupBy("same").agg(F.sum("size").alias("bytes")), "groups")

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        held = [tuple(map(int, r)) for b in batches for r in zip(b["bytes"], b["n"], strict=True)]
        runs, out, at = sorted(held, reverse=True), [], {}
        for i, shard, n in pack(runs, shards):
            size, first = runs[i][0], at.get(i, 0)
            at[i] = first + n
            out.append((size, first, first + n, shard))
        yield pd.DataFrame(out, columns=["bytes", "first", "stop", "shard"])

    plan = cut(groups.groupBy("bytes").agg(F.count("*").alias("n")).coalesce(1).mapInPandas(place, "bytes long, first long, stop long, shard int"), "plan")
    items = numbered(groups, ["bytes"], ["same"], cells, "number").join(plan, "bytes").where("first <= number and number < stop").select("same", "shard")
    put = numbered(rows.join(items, "same").drop("same"), ["shard"], ["doc_id", "text_crc32", "size"], cells, "slot")
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
