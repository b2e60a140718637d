"""Hard-negative mining: disjoint score slots between the upper limits of an anchor's positives, merged from the lowest slot up."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut

#: Rows of a block that a task holds, and scores that it works out at once.
BLOCK, SCORES = 65536, 1 << 22


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as 64-bit integers.

    No partial sum is above the product of two norms, so a float product is exact while that stays within its mantissa.
    """
    most = float(np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)))
    if most < 1 << 23:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 52:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: [[int(c) for c in row] for row in x]
    limit = lambda s: min(max(s, 1 - 2**63), 2**63 - 1)
    left, right = whole(a), whole(b)
    return np.array([[limit(sum(p * q for p, q in zip(x, y, strict=True))) for y in right] for x in left], np.int64).reshape(len(a), len(b))


def leading(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every slot: higher scores first, ties by smaller id; slots below 0 are left out."""
    use = np.flatnonzero(slot >= 0)
    order = use[np.lexsort((ids[use], -score[use], slot[use]))]
    begins = np.flatnonzero(np.diff(slot[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) < k]


def at_least_kth(score: np.ndarray, k: int) -> np.ndarray:
    """True where a score isn't below the k-th best of its row, ties with it included."""
    return score >= np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.ones(score.shape, bool)


def vectors_of(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def tiles(rows: DataFrame, anchors: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows in blocks of at most about `most` under each value of `by`, and every anchor once for every block of its own.

    Anchors go to rows, since there are fewer; a block's rows come first. Blocks are dealt out, not keys, so a value that holds most rows is spread like others.
    """
    spark, n = rows.sparkSession, rows.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(n / most), min(parts, math.ceil(n / 1024)), 1)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("anchor", F.lit(False))
    sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("anchor", F.lit(True))
    both = placed.unionByName(sent, allowMissingColumns=True)
    return both.repartition(parts, *by, "block").sortWithinPartitions(*by, "block", "anchor")


def met(batches: Iterable[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """A block's rows with some of its anchors at a time; anchors are never held together."""
    place, held = None, None

    def pieces() -> Iterator[pd.DataFrame]:
        for batch in batches:
            edge = pd.concat([batch[c] != batch[c].shift() for c in (*by, "block", "anchor")], axis=1).any(axis=1)
            yield from (piece for _, piece in batch.groupby(edge.cumsum(), sort=False))

    for piece in pieces():
        key = tuple(piece[c].iloc[0] for c in (*by, "block"))
        if key != place:
            place, held = key, None
        if not piece["anchor"].iloc[0]:
            held = piece if held is None else pd.concat([held, piece])
        elif held is not None:
            step = max(1, SCORES // len(held))
            for i in range(0, len(piece), step):
                yield held, piece.iloc[i : i + step]


def best_positives(batches: Iterable[pd.DataFrame], by: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Each anchor's k best other rows in a block of its label."""
    for rows, anchors in met(batches, by):
        score = inner(vectors_of(anchors["v"]), vectors_of(rows["v"]))
        ids, row = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        i, j = np.nonzero(at_least_kth(score, k + 1))
        other = anchors["row"].to_numpy()[i] != row[j]
        i, j = i[other], j[other]
        pick = leading(i, score[i, j], ids[j], k)
        i, j = i[pick], j[pick]
        yield pd.DataFrame({"anchor_row": anchors["row"].to_numpy()[i], "positive_id": ids[j], "positive_row": row[j], "positive_score": score[i, j]})


def best_of_slots(batches: Iterable[pd.DataFrame], by: list[str], k: int) -> Iterator[pd.DataFrame]:
    """Each anchor's k best rows of another label in every slot of a block.

    Slot s holds the scores that the upper limits of positives 0 to s allow and those of later ones don't.
    """
    for rows, anchors in met(batches, by):
        score = inner(vectors_of(anchors["v"]), vectors_of(rows["v"]))
        ids, apart = rows["vec_id"].to_numpy(), anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()
        uppers, lowest = anchors["uppers"].tolist(), anchors["lowest"].to_numpy()
        at, slots, where = [], [], []
        wide = max(map(len, uppers))
        tops = np.array([[*u, *[np.iinfo(np.int64).min] * (wide - len(u))] for u in uppers], np.int64)
        allowed = apart & (score <= tops[:, :1]) & (score >= lowest[:, None])
        for s in range(wide):
            inside = allowed & (score <= tops[:, s, None])
            if s + 1 < wide:
                inside &= score > tops[:, s + 1, None]
            i, j = np.nonzero(inside & at_least_kth(np.where(inside, score, np.iinfo(np.int64).min), k))
            at.append(i), slots.append(np.full(len(i), s)), where.append(j)
        i, s, j = np.concatenate(at), np.concatenate(slots), np.concatenate(where)
        pick = leading(i * wide + s, score[i, j], ids[j], k)
        i, s, j = i[pick], s[pick], j[pick]
        yield pd.DataFrame({"anchor_row": anchors["row"].to_numpy()[i], "slot": s, "negative_id": ids[j], "negative_row": rows["row"].to_numpy()[j], "negative_score": score[i, j]})


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; tasks pass on k rows of a key each, before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of another label whose score is `low` to `high` percent of the positive's.

    `anchors` and `label` are columns over vec_id and label. A component x becomes floor(256 * x); scores are exact integer inner products.
    Higher scores come first, ties by smaller vec_id. An anchor's positives are its first `positives` other rows of the same label.

    The positives' upper limits, floor(high * score / 100) in descending order, cut the scores into disjoint slots. Anchors go to blocks of all rows; a block
    keeps the first `negatives` of every slot, and those of all blocks are merged the same way. From the lowest slot up, merged lists hold the
    first `negatives` at or below each limit, so each positive's window is answered by one list without those below its lower limit.

    Rows with a null label, vector or vec_id, or a null or non-finite component take no part. Vectors meet those of equal length only; empty ones
    score 0. Rows that share a vec_id are rows of their own, and an anchor is never its own positive. Scores beyond 64 bits stand at the limit.
    Anchors without positives, and windows without rows (all of negative positives), give no rows. An empty table gives an empty result; other columns are ignored.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    @F.pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: np.floor(256 * np.asarray(v, np.float64)).tobytes())

    rows = vectors.where(fine).select("vec_id", label.alias("label"), F.size("embedding").alias("size"), packed(x).alias("v"), anchors.alias("asks"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "rows")
    asks, rows = rows.where("asks").drop("asks"), rows.drop("asks")
    kind = rows.schema["label"].dataType.simpleString()

    same = ["label", "size"]
    near = tiles(rows, asks, same, block).mapInPandas(lambda b: best_positives(b, same, positives), "anchor_row long, positive_id long, positive_row long, positive_score long")
    near = first_of(near, ["anchor_row"], [F.desc("positive_score"), F.col("positive_id"), F.col("positive_row")], positives).withColumn("place", F.col("nth") - 1).drop("nth")
    near = cut(near, "positives")
    bound = lambda share: F.expr(f"cast({share} * cast(positive_score as decimal(20)) / 100 as decimal(38,6))")
    limits = near.select("anchor_row", "place", F.floor(bound(high)).cast("long").alias("upper"), F.ceil(bound(low)).cast("long").alias("lower"))
    limits = limits.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", "upper"))).alias("tops"), F.min("lower").alias("lowest"))
    limits = limits.select(F.col("anchor_row").alias("row"), F.col("tops.upper").alias("uppers"), "lowest")

    alike = ["size"]
    asked = asks.join(limits, "row")
    far = tiles(rows, asked, alike, block).mapInPandas(lambda b: best_of_slots(b, alike, negatives), "anchor_row long, slot int, negative_id long, negative_row long, negative_score long")
    order = [F.desc("negative_score"), F.col("negative_id"), F.col("negative_row")]
    slots = first_of(far, ["anchor_row", "slot"], order, negatives)
    lists = slots.groupBy("anchor_row").agg(F.collect_list(F.struct("slot", (-F.col("negative_score")).alias("down"), "negative_id", "negative_score")).alias("found"))

    # At most positives * negatives entries an anchor. Lower slots hold lower scores: the list of slot s is its own followed by that of slot s + 1.
    of_slot = lambda s: F.array_sort(F.filter("found", lambda e: e["slot"] == s))
    merged = F.array(*[F.slice(F.concat(*[of_slot(s) for s in range(p, positives)]), 1, negatives) for p in range(positives)])
    lists = lists.select("anchor_row", merged.alias("merged"))
    answers = near.join(lists, "anchor_row").select("anchor_row", "positive_id", "positive_score", F.posexplode(F.filter(F.col("merged")[F.col("place")], lambda e: 100 * e["negative_score"].cast("decimal(20)") >= low * F.col("positive_score").cast("decimal(20)"))).alias("nth", "e"))
    named = asks.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return answers.join(named, "anchor_row").select("anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("e.negative_id").alias("negative_id"), "positive_score", F.col("e.negative_score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL = {
    "op13_hard_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::hugeint) as e
            from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::bigint as score
            from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
        p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select anchor_id, positive_id, (row_number() over w)::int as rank, other as negative_id, positive_score, score as negative_score from p join s using (anchor_id)
        where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        window w as (partition by anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 10"""
}
