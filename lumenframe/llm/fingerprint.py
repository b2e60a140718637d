"""Document fingerprints: a homomorphic multiset hash of paragraphs."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import documents

#: Lanes for equality, and lanes for likeness, all summed modulo 2**32.
SAME, LIKE = 32, 256
#: Characters of text that are hashed at once.
BLOCK = 1 << 20


def step(k: int) -> np.uint64:
    """The k-th seed of a splitmix64 sequence."""
    return np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, computed once a word; emptied between blocks when it has grown."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word) | 1
        return found

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()


def paragraphs(text: str | None) -> list[str]:
    """Lines of the text, blank ones included; none for a null or empty text."""
    return text.split("\n") if text else []


def fingerprints(texts: Sequence[str | None], words: WordHashes | None = None) -> np.ndarray:
    """One row of SAME and LIKE uint32 lanes (as bytes) per text: the sum of its paragraphs' vectors.

    A paragraph's equality lanes are expanded from its 128-bit hash. Its likeness lanes are a signed sketch of
    its runs of three words (cut off at its end), so that paragraphs which share wording have vectors that point
    the same way. Sums are modulo powers of two: order doesn't matter, and a paragraph is inserted or
    deleted by adding or subtracting its vector.
    """
    words = WordHashes() if words is None else words
    n = len(texts)
    same = np.zeros((n, SAME // 2), np.uint64)
    parts = [paragraphs(t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, n)
    if counts.sum():
        digests = b"".join(xxhash.xxh3_128_digest(p.encode()) for ps in parts for p in ps)
        seeds = np.frombuffer(digests, "<u8").reshape(-1, 2)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
        for lane in range(0, SAME // 2):
            both = mixed(seeds[:, 0] + step(lane + 1)) ^ mixed(seeds[:, 1] + step(lane + 101))
            low = np.add.reduceat(both & np.uint64(0xFFFFFFFF), at) & np.uint64(0xFFFFFFFF)
            high = np.add.reduceat(both >> np.uint64(32), at) & np.uint64(0xFFFFFFFF)
            same[counts > 0, lane] = low | (high << np.uint64(32))
    like = np.zeros((n, LIKE), np.uint32)
    for i, text in enumerate(texts):
        if not text:
            continue
        tokens = text.encode().replace(b"\n", b" \0 ").split()
        h = np.zeros(len(tokens) + 2, np.uint64)
        h[:-2] = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
        stop = h == words[b"\0"]
        h[stop] = 0
        last = h[1:-1] == 0
        third = np.where(last, np.uint64(0), h[2:])
        runs = mixed(h[:-2] + h[1:-1] * np.uint64(0xD6E8FEB86659FD93) + third * np.uint64(0xA0761D6478BD642F))[h[:-2] != 0]
        lanes = (runs & np.uint64(LIKE - 1)).astype(np.int64)
        signs = np.where(runs >> np.uint64(63), 1.0, -1.0)
        like[i] = np.bincount(lanes, signs, LIKE).astype(np.int64).astype(np.uint32)
    return np.hstack([same.view(np.uint8), like.view(np.uint8)])


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Insert (sign 1) or delete (sign -1) the paragraphs behind b."""
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    same = a[: 4 * SAME].view(np.uint32) + np.uint32(sign % (1 << 32)) * b[: 4 * SAME].view(np.uint32)
    like = a[4 * SAME :].view(np.uint32) + np.uint32(sign % (1 << 32)) * b[4 * SAME :].view(np.uint32)
    return np.concatenate([same.view(np.uint8), like.view(np.uint8)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal fingerprints, else the cosine of the likeness lanes, not below 0."""
    x, y = (np.ascontiguousarray(v[:, 4 * SAME :]).view(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0)).round(6)


def printed(v: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in v]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (base64 of the lanes) per row, without a shuffle; null and empty texts have zero lanes."""

    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordHashes()
        for batch in batches:
            words.trim()
            yield pd.Series([p for i in range(0, len(batch), 256) for p in printed(fingerprints(list(batch.iloc[i : i + 256]), words))], dtype=object)

    return docs.select("doc_id", hashed("text").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of an edited text, and their likeness.

    The edited text replaces the last floor(n / 2) code points by the first as many (or all) of the next
    document's in descending doc_id; after the last comes the first. Texts are shuffled once, in blocks of
    consecutive doc_ids bounded by quantiles; the head of each block is also sent to the end of the block before.

    Null texts are empty. Null doc_ids come last. Rows with one doc_id are neighbours, in the order of a hash of their texts, so
    blocks end within them too; only rows equal in both stay together. Blocks are cut to about equal bytes, on a sample of
    200 rows a block that settles nothing else. A single document's next is itself. An empty table gives an empty
    result; other columns are ignored.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    n = blocks or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (-1 - F.coalesce(F.col("doc_id").cast("long"), F.lit(none))).alias("key"))
    # -1 - doc_id falls as doc_id rises, and no long has none there: the order is (key, tie).
    rows = rows.withColumn("tie", F.xxhash64("text"))
    sizes = rows.select("key", "tie", (F.octet_length("text") + 64).alias("bytes"))
    total = rows.count()
    found = sizes.sample(min(1.0, 200 * n / max(total, 1)), seed=7).collect()
    found = sorted((r["key"], r["tie"], r["bytes"]) for r in found)
    weight = np.cumsum([r[2] for r in found])
    cuts = sorted({found[i][:2] for i in np.searchsorted(weight, [weight[-1] * k / n for k in range(1, n)]).tolist()}) if found else []

    @F.pandas_udf("int")
    def part(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(cuts, x) for x in zip(key.tolist(), tie.tolist(), strict=True)], dtype="int32")

    # The first row of every block that has any: its text also ends the block before.
    tops = sizes.groupBy(part("key", "tie").alias("part")).agg(F.min(F.struct("key", "tie")).alias("top")).collect()
    heads = sorted((r["top"]["key"], r["top"]["tie"]) for r in tops)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series, tie: pd.Series) -> pd.Series:
        """The row's block; for the head of a block also the block before, as -1 - block."""
        out = []
        for x in zip(key.tolist(), tie.tolist(), strict=True):
            b = bisect.bisect_right(heads, x) - 1
            out.append([b, -1 - (b - 1) % len(heads)] if heads[b] == x else [b])
        return pd.Series(out)

    placed = rows.withColumn("place", F.explode(places("key", "tie")))
    placed = placed.select("doc_id", "text", "key", "tie", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), (F.col("place") < 0).alias("after"))
    dealt = placed.repartition(n, "block").sortWithinPartitions("block", "after", "key", "tie", "text")

    def flush(held: list, words: WordHashes) -> pd.DataFrame:
        texts = [h[1] for h in held]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        words.trim()
        own, other = fingerprints(texts, words), fingerprints(edited, words)
        return pd.DataFrame({
            "doc_id": [h[0] for h in held[:-1]],
            "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": printed(own[:-1]),
            "edited_fingerprint": printed(other),
            "near_edited": likeness(own[:-1], other),
            "near_next": likeness(own[:-1], own[1:]),
        })

    def each(batches: Iterable) -> Iterator:
        words, held, size, block, ended = WordHashes(), [], 0, None, False
        for batch in batches:
            for doc, text, at, after in zip(batch["doc_id"], batch["text"], batch["block"], batch["after"], strict=True):
                if at != block:
                    held, size, block, ended = [], 0, at, False
                if ended:
                    continue
                held.append((doc, text))
                size += len(text)
                ended = bool(after)
                if len(held) > 1 and (ended or size > BLOCK):
                    yield flush(held, words)
                    held, size = held[-1:], len(text)

    # Ids travel as text: pandas would turn a column with nulls into floats.
    found = dealt.select(F.col("doc_id").cast("string"), "text", "block", "after").mapInPandas(
        each, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
