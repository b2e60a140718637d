"""Source divergence audit: run-length columns of term counts per source, compared on the intersected runs of each pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, documents

#: Bytes of terms as they are, A-Z lower-cased, and a space for all that terms never hold.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Probabilities are whole numbers of this unit.
UNIT = 1_000_000_000
#: Distinct (source, term) pairs that a task counts before it hands them on, and distinct count vectors of a block.
HELD, BLOCK_BITS = 400_000, 11


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / total), by long division in steps of a thousand: exact for totals below 9 * 10^15."""
    out, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exact in 64 bits."""
    return (p - q) ** 2 // (p + q)


def plain(texts: list) -> pd.Series:
    """A column of texts that is one also when it is empty."""
    return pd.Series(texts, dtype=object)


def tally(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents of every term per (lang, source), summed over a part of the table; one row without a term per group."""
    words: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def told() -> Iterator[pd.DataFrame]:
        for (lang, source), counts in words.items():
            terms = list(counts)
            n = len(terms) + 1
            texts = {"lang": plain([lang] * n), "source": plain([source] * n), "term": plain([None, *terms])}
            yield pd.DataFrame({**texts, "n": [0, *counts.values()], "docs": [0, *map(docs[lang, source].__getitem__, terms)]})

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            total = words.setdefault((lang, source), Counter())
            found = text.translate(FOLDED).split()
            held -= len(total)
            total.update(found)
            held += len(total)
            docs.setdefault((lang, source), Counter()).update(set(found))
            if held > HELD:
                yield from told()
                words, docs, held = {}, {}, 0
    yield from told()


class Runs:
    """A group's column over the vocabulary's order: the ends of its runs of equal counts, and their probabilities."""

    def __init__(self, counts: np.ndarray, ends: np.ndarray, total: int) -> None:
        last = np.append(np.flatnonzero(counts[1:] != counts[:-1]), len(counts) - 1)
        self.ends, self.p = ends[last], scaled(counts[last], np.int64(total))

    def divergence(self, other: Runs) -> int:
        """The distance summed over all terms: once for each run of the intersection, times its length."""
        ends = np.union1d(self.ends, other.ends)
        p, q = self.p[np.searchsorted(self.ends, ends)], other.p[np.searchsorted(other.ends, ends)]
        return int((distance(p, q) * np.diff(ends, prepend=0)).sum())


def compared(facts: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a < b) of one block of count vectors, in the order that clusters equal counts."""
    facts = facts.sort_values("source")
    names = facts["source"].tolist()
    sums, pairs = np.zeros((len(names), len(names)), np.int64), [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if len(vectors):
        vectors = vectors.sort_values("place")
        at = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), len(vectors)), np.int64)
        rows = [at[s] for sources in vectors["sources"] for s in sources]
        counts[rows, np.repeat(np.arange(len(vectors)), vectors["sources"].map(len))] = np.concatenate(vectors["counts"].to_numpy())
        ends = np.cumsum(vectors["terms"].to_numpy())
        totals = (facts["n"] + 2 * facts["v"]).tolist()
        columns = [Runs(c, ends, t) for c, t in zip(counts, totals, strict=True)]
        for i, j in pairs:
            sums[i, j] = columns[i].divergence(columns[j])
    texts = {"lang": plain(facts["lang"].tolist()[:1] * len(pairs)), "a": plain([names[i] for i, _ in pairs]), "b": plain([names[j] for _, j in pairs])}
    return pd.DataFrame({**texts, "value": np.array([sums[i, j] for i, j in pairs], np.int64)})


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """How far the sources of each lang are from each other in their terms, and which terms set each source apart.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a lang keeps those in at least `least_docs` of its documents.
    Counts become probabilities in whole billionths, 1 + floor(10^9 * (count + 2) / (N + 2 V)), and f is floor((p - q)^2 / (p + q)).
    Part `pair`: every other source of the lang with f summed over all kept terms. Part `term`: the `top` kept terms that the source holds more
    often than its lang, by f. Ranks go by value descending, ties by item in the order of its UTF-8 bytes.

    Terms with equal counts in all sources become one vector with a number of terms; vectors are put in order, so that equal counts stand side
    by side, and cut into blocks of 2048. A block encodes each source's column in runs and adds f over the intersected runs of each pair times their
    lengths; sums of blocks are added up. Rows of a term are one per source, so the result's own size bounds every group that a task holds.

    Null text, lang and source count as ''. A (lang, source) without terms has count 0 of every kept term; without kept terms all pairs have value 0.
    A lang with one source has no pairs. Repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    Returns lang, source, part, item, value, rank.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text)
    tallied = rows.mapInPandas(tally, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    cells = cut(tallied.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")

    by_term = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
    kept = cut(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    each = kept.select("lang", "term", "all", F.inline("cells"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all"))
    facts = cells.where("term is null").select("lang", "source").join(each.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    facts = cut(facts.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "all")]), "facts")

    vectors = kept.groupBy("lang", "cells").agg(F.count("*").alias("terms"))
    place = F.monotonically_increasing_id()  # the partition, then the row in it: blocks never span partitions
    ordered = vectors.repartitionByRange("lang", "cells").sortWithinPartitions("lang", "cells").select("lang", place.alias("place"), "terms", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
    ordered = cut(ordered.withColumn("block", F.shiftright("place", BLOCK_BITS)), "ordered")
    blocks = ordered.select("lang", "block").union(facts.select("lang", F.lit(-1).cast("long"))).distinct()
    heads = cut(blocks.join(facts, "lang"), "heads")
    pairs = heads.groupBy("lang", "block").cogroup(ordered.groupBy("lang", "block")).applyInPandas(compared, "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    of_pairs = pairs.select("lang", "value", ways).withColumn("part", F.lit("pair"))

    share, far = F.pandas_udf(lambda count, total: pd.Series(scaled(count.to_numpy(), total.to_numpy())), "long"), lambda p, q: F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")
    told = each.where("n > 0").join(facts.select("lang", "source", F.col("n").alias("group_n"), "v", F.col("all").alias("lang_n")), ["lang", "source"])
    told = told.withColumn("p", share(F.col("n"), F.col("group_n") + 2 * F.col("v"))).withColumn("q", share(F.col("all"), F.col("lang_n") + 2 * F.col("v"))).where("p > q")
    of_terms = told.select("lang", "source", F.col("term").alias("item"), far("p", "q").alias("value"))

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(of_pairs).select(columns).union(ranked(of_terms).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


ORACLE_SQL = {
    "op11_source_divergence": r"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
        t as (select id, lang, source, unnest(words) as term from d), g as (select distinct lang, source from d),
        k as (select lang, term, count(*) as total from t group by all having count(distinct id) >= 10),
        c as (select lang, source, term, count(*) as n from t group by all),
        a as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.total from g join k using (lang) left join c using (lang, source, term)),
        s as (select *, sum(n) over w + 2 * count(*) over w as group_n, sum(total) over w + 2 * count(*) over w as lang_n from a window w as (partition by lang, source)),
        p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // group_n as p, 1 + (1000000000::hugeint * (total + 2)) // lang_n as q from s),
        f as (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
        r as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source
                left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
            union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q)
        select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r qualify part = 'pair' or rank <= 10"""
}
