"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy, with calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import documents
from lumenframe.llm.fingerprint import mixed

#: Characters of a subword at most, hash buckets, size of an embedding.
LONGEST, BUCKETS, SIZE = 4, 1 << 16, 16
#: Code points of the text that are hashed at once, and of a training excerpt.
PIECE, EXCERPT = 1 << 18, 240
#: The name of texts without a language.
UNKNOWN = "und"


def letters(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def plain(text: str) -> np.ndarray:
    """Code points in lower case; all but letters and marks are spaces, and the text begins and ends with one."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).copy()
    other = [c for c in np.unique(chars).tolist() if unicodedata.category(chr(c))[0] not in "LM"]
    chars[np.isin(chars, other)] = 32
    return chars


def subwords(chars: np.ndarray, begins: int) -> np.ndarray:
    """Buckets of all subwords of 1 to LONGEST characters that begin at the first `begins` places; a space marks either end of a word and stands nowhere else."""
    out, h, space = [], np.zeros(len(chars), np.uint64), chars == 32
    broken = np.zeros(len(chars), bool)
    for n in range(1, LONGEST + 1):
        count = min(len(chars) - n + 1, begins)
        if count <= 0:
            break
        h = h[:count] * np.uint64(0xD6E8FEB86659FD93) + chars[n - 1 : n - 1 + count] + np.uint64(n)
        if n < 3:
            keep = ~(space[:count] & space[n - 1 : n - 1 + count])
        else:
            broken = broken[:count] | space[n - 2 : n - 2 + count]
            keep = ~broken
        out.append((mixed(h[keep]) >> np.uint64(48)).astype(np.int64))
    return np.concatenate(out)


def pieces(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a whole text, each once, PIECE places at a time."""
    chars = plain(text)
    for at in range(0, len(chars), PIECE):
        yield subwords(chars[at : at + PIECE + LONGEST - 1], PIECE)


class Model:
    """An embedding per bucket, averaged over a text, and a linear layer with softmax; a temperature and a threshold make it calibrated."""

    def __init__(self, langs: Sequence[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs = list(langs)
        self.embed = ((rng.random((BUCKETS, SIZE)) - 0.5) / SIZE).astype(np.float32)
        self.out, self.bias = np.zeros((SIZE, len(self.langs)), np.float32), np.zeros(len(self.langs), np.float32)
        self.warmth, self.least = 1.0, 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp((logits - logits.max(-1, keepdims=True)) / self.warmth)
        return e / e.sum(-1, keepdims=True)

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float, lot: int, seed: int) -> None:
        """Stochastic gradient descent with a falling rate, small lots at a time."""
        rng, steps, step = np.random.default_rng(seed), max(1, epochs * -(-len(bags) // lot)), 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), lot):
                part = order[i : i + lot]
                flat, sizes = np.concatenate([bags[j] for j in part]), np.array([len(bags[j]) for j in part])
                owner = np.repeat(np.arange(len(part)), sizes)
                cells, times = np.unique(owner * BUCKETS + flat, return_counts=True)
                owner, bucket = cells // BUCKETS, cells % BUCKETS
                weight = (times / sizes[owner]).astype(np.float32)[:, None]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                mean = np.add.reduceat(self.embed[bucket] * weight, starts)
                e = np.exp((z := mean @ self.out + self.bias) - z.max(1, keepdims=True))
                error = e / e.sum(1, keepdims=True)
                error[np.arange(len(part)), labels[part]] -= 1
                now = rate * (1 - step / steps)
                # Each text takes its own step of `now` on the embeddings; the shared layer takes their mean.
                np.add.at(self.embed, bucket, -now * weight * (error @ self.out.T)[owner])
                self.out -= now / len(part) * 4 * (mean.T @ error)
                self.bias -= now / len(part) * 0.1 * error.sum(0)
                step += 1

    def table(self) -> np.ndarray:
        """What a subword adds to the logits: averaging and the linear layer commute."""
        return self.embed @ self.out

    def logits(self, text: str, table: np.ndarray) -> np.ndarray:
        counts = np.zeros(BUCKETS, np.int64)
        for bag in pieces(text):
            counts += np.bincount(bag, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        return counts[some] @ table[some].astype(np.float64) / max(1, counts.sum()) + self.bias

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, precision: float) -> None:
        """The temperature with the least log loss, and the least probability from which on at least `precision` of the answers are right, both on examples that taught nothing."""
        rows = np.arange(len(labels))

        def loss(warmth: float) -> float:
            self.warmth = warmth
            return float(-np.log(self.probabilities(logits)[rows, labels] + 1e-12).mean())

        self.warmth = min(np.geomspace(0.1, 10, 41).tolist(), key=loss)
        p = self.probabilities(logits)
        best, right = p.max(1), p.argmax(1) == labels
        order = np.argsort(-best, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        self.least = float(best[order][good[-1]]) if len(good) else 1.0


def train(texts: Sequence[str], labels: Sequence[str], epochs: int = 12, rate: float = 2.0, lot: int = 16, precision: float = 0.99, seed: int = 5) -> Model:
    """Fit on excerpts; every fifth only calibrates. Texts without letters teach nothing."""
    use = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t)]
    langs = sorted({labels[i] for i in use})
    model = Model(langs, seed)
    if len(langs) < 2:
        return model
    y = np.array([langs.index(labels[i]) for i in use])
    bags = [np.concatenate(list(pieces(texts[i]))) for i in use]
    held = np.arange(len(use)) % 5 == 4
    model.fit([b for b, h in zip(bags, held, strict=True) if not h], y[~held], epochs, rate, lot, seed)
    if held.any():
        table = model.table()
        model.calibrate(np.array([model.logits(texts[i], table) for i, h in zip(use, held, strict=True) if h]), y[held], precision)
    return model


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; documents in fold 0 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit_languages(docs: DataFrame, most: int = 4000, salts: int = 64) -> Model:
    """Learn from at most `most` documents outside fold 0 with a lang, an id and a letter, dealt evenly to the langs: those with the smallest hashes.

    A lang gives at most most / salts documents, rounded up, of each of `salts` classes of hashes, so that no lang is sorted in one task. Each
    teaches with an excerpt of EXCERPT characters from a place of the text that its hash chooses, so the driver holds at most most * EXCERPT characters,
    whatever the size of the table or the texts. Langs beyond `most` in number, by the hashes of their first documents, aren't learned. `und` isn't learned.
    """
    taught = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0) & letters("text"))
    start = F.pmod(F.xxhash64("doc_id", F.lit("excerpt")), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))).cast("int") + 1
    rows = taught.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", F.substring(F.col("text"), start, F.lit(EXCERPT)).alias("excerpt"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(salts))).orderBy("h", "doc_id", "excerpt")
    dealt = rows.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= -(-most // salts))
    sample = dealt.orderBy("nth", "h", "lang", "doc_id", "excerpt").limit(most).collect()
    return train([r["excerpt"] for r in sample], [r["lang"] for r in sample])


def languages(model: Model, text: str) -> Column:
    """(lang, score) of whole texts: the likeliest lang and its calibrated probability; texts without a letter should not be asked."""
    table = model.table()

    @F.pandas_udf("lang string, score double")
    def told(batch: pd.Series) -> pd.DataFrame:
        rows = [(UNKNOWN, 0.0)] * len(batch)
        for i, t in enumerate(batch):
            if t and model.langs:
                p = model.probabilities(model.logits(t, table))
                rows[i] = model.langs[int(p.argmax())], round(float(p.max()), 6)
        return pd.DataFrame(rows, columns=["lang", "score"])

    return told(F.col(text))


def identify_languages(docs: DataFrame, most: int = 4000) -> DataFrame:
    """The language of every whole text, with the calibrated probability of it.

    Only text and lang of documents outside fold 0 teach; lang, source and doc_id are never inputs of a prediction. `accepted` is false where the probability
    is below the threshold from which on 99 % of the calibration documents are right: then the lang is only the likeliest of those learned. Null texts and
    those without a letter are `und` with score 0 and not accepted; so is every text where no lang was learned. With one lang learned all others have it with score 1. Ties
    go to the first lang in order. Null ids count as held out. Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
    Prediction runs in the scan's own partitions, without a shuffle. Returns doc_id, held_out, lang_pred, score, accepted.
    """
    model = fit_languages(docs, most)
    seen = docs.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), F.when(letters("text"), F.col("text")).alias("seen"))
    told = seen.select("doc_id", "held_out", languages(model, "seen").alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"), ((F.col("told.lang") != UNKNOWN) & (F.col("told.score") >= model.least)).alias("accepted"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))
