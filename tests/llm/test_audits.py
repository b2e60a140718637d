"""Source divergence, language identification and hard negatives against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import divergence, embeddings, hard_negatives, language_id

DOCS = "doc_id long, text string, lang string, source string, term string, n long, docs int, p long, place int, block int, rank int"


def audited():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Éclair", "straße", "日本", "x", "the", "The", "a_b", "c3d"]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(words[: 3 + i % 9]) for _ in range(rng.randrange(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "É", None, ""])))
    rows += [(900, None, "en", "s9"), (901, "", "en", "s9"), (902, "12 3 --", "xx", "a"), (903, "rare", "xx", "b"), (904, "alone", "yy", "only"), (905, "the " * 30_000, "en", "s2")]
    rows += rows[:12] + [(None, "the alpha", "en", "s1")]
    return rows


def divergence_of(rows, least=10, top=10):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        sources = sorted(s for a, s in groups if a == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = share(sum((counts[lang, s] for s in sources), collections.Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_source_divergence(spark, parts):
    rows = audited()
    df = spark.createDataFrame([(*r, "t", 1, 1, 1, 1, 1, 1) for r in rows], DOCS).repartition(parts)
    got = divergence.source_divergence(df).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == divergence_of(rows)
    assert any(r["lang"] == "xx" and r["part"] == "pair" and r["value"] == 0 for r in got)


def test_source_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).collect() == []
    wordless = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None)], DOCS)
    assert divergence.source_divergence(wordless).collect() == []


def test_tallies_are_handed_on_in_parts(monkeypatch):
    import pandas as pd

    batch = pd.DataFrame({"lang": "en", "source": ["a", "b", "a"], "text": [b"x y z x", b"X q", b"y y"]})
    monkeypatch.setattr(divergence, "HELD", 2)
    parts = list(divergence.tally([batch]))
    assert len(parts) > 2
    sums = pd.concat(parts).dropna().groupby(["source", "term"])[["n", "docs"]].sum()
    assert sums.loc[("a", b"y")].tolist() == [3, 2] and sums.loc[("b", b"x")].tolist() == [1, 1]


def test_probabilities_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.scaled(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 2) // total


def test_runs_intersect_like_single_terms():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(1, 9, 20)
        a, b = np.sort(rng.integers(0, 4, 20)), rng.integers(0, 3, 20)
        ends = np.cumsum(lengths)
        got = divergence.Runs(a, ends, 500).divergence(divergence.Runs(b, ends, 700))
        p, q = divergence.scaled(np.repeat(a, lengths), np.int64(500)), divergence.scaled(np.repeat(b, lengths), np.int64(700))
        assert got == sum(int(x - y) ** 2 // int(x + y) for x, y in zip(p, q, strict=True))
        assert len(divergence.Runs(a, ends, 500).ends) <= 4


# ---- languages -------------------------------------------------------------------------------------------------
SYLLABLES = {"aa": ["ka", "lo", "mi", "sut", "ven"], "bb": ["ström", "gråd", "flø", "kæ", "ung"], "cc": ["что", "это", "был", "ни", "мо"]}
TEXTS = "doc_id long, text string, lang string, source string, score double, told string, seen string, nth int, h long, held_out string"


def spoken(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5, "x", "y", 1, 1, "z") for r in rows], TEXTS).repartition(3)


def test_languages_held_out(spark):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- ²!", "bb"), (1003, "kalomi sutven", None), (None, "ström gråd", "bb"), (1004, "что " * 200_000, "cc"), (1005, "日本語", None)]
    got = {r["doc_id"]: r for r in language_id.identify_languages(frame(spark, spoken() + odd)).collect()}
    for i, _, lang in spoken():
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i]["held_out"] == held
        assert got[i]["lang_pred"] == lang and got[i]["score"] > 0.8
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[1003]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and got[None]["held_out"] and got[1004]["lang_pred"] == "cc"
    assert got[1005]["lang_pred"] in SYLLABLES and 0 <= got[1005]["score"] <= 1


def test_languages_of_nothing(spark):
    assert language_id.identify_languages(spark.createDataFrame([], TEXTS)).collect() == []
    unlabelled = language_id.identify_languages(frame(spark, [(1, "ka lo", None), (2, "mi", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    single = language_id.identify_languages(frame(spark, [(i, "ka lo mi", "aa") for i in range(9)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in single} == {("aa", 1.0)}


def test_only_text_and_allowed_labels_teach(spark):
    """Changing labels of held-out documents, sources or other columns changes no prediction."""
    rows = spoken(90)
    changed = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    first = sorted(tuple(r) for r in language_id.identify_languages(frame(spark, rows)).collect())
    other = frame(spark, changed).withColumn("source", F.col("doc_id").cast("string")).repartition(1)
    assert sorted(tuple(r) for r in language_id.identify_languages(other).collect()) == first


def subwords_of(text):
    chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    found = collections.Counter()
    for n in range(1, language_id.LONGEST + 1):
        for i in range(len(chars) - n + 1):
            part = chars[i : i + n]
            if " " not in part[1:-1] and any(c != " " for c in part) and not (n < 3 and " " in part[:1] and part[-1] == " "):
                found["".join(part)] += 1
    return found


@pytest.mark.parametrize("text", ["a", "Ab cd", "été 12 là-bas  x", "ein wort, zwei Wörter. " * 40])
@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_subwords_are_those_of_the_whole_text(monkeypatch, text, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    bags = np.concatenate(list(language_id.pieces(text)))
    assert len(bags) == sum(subwords_of(text).values())
    monkeypatch.setattr(language_id, "PIECE", 1 << 18)
    whole = np.concatenate(list(language_id.pieces(text)))
    assert sorted(bags.tolist()) == sorted(whole.tolist())
    assert sorted(collections.Counter(whole.tolist()).values()) == sorted(subwords_of(text).values())


def test_gradient_steps_lower_the_loss():
    rows = spoken(60)
    one, many = (language_id.train([t for _, t, _ in rows], [lang for *_, lang in rows], epochs=e) for e in (1, 10))

    def loss(model):
        table = model.table()
        return -sum(math.log(model.probabilities(model.logits(t, table))[model.langs.index(lang)]) for _, t, lang in rows)

    assert loss(many) < loss(one) < 60 * math.log(3)


def test_threshold_keeps_the_precision():
    model = language_id.Model(["a", "b"])
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 2000)
    logits = np.stack([1 - labels, labels], 1) * 2.0 + rng.standard_normal((2000, 2))
    model.calibrate(logits, labels, 0.97)
    p = model.probabilities(logits)
    sure = p.max(1) >= model.least
    assert 0.2 < sure.mean() < 1 and (p.argmax(1) == labels)[sure].mean() >= 0.97
    assert abs(p.max(1).mean() - (p.argmax(1) == labels).mean()) < 0.03


# ---- hard negatives --------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, row string, size string, block int, asks string, v int"


def vectors_of():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 6))
    rows = []
    for i in range(260):
        x = centres[i % 4] * (i % 3 != 0) + 0.4 * rng.standard_normal(6)
        rows.append((i, np.round(x, 2 if i % 5 else 0).astype(np.float32).tolist(), i % 4))
    rows += [(1000 + i, [0.5] * 6, 1) for i in range(40)] + [(2000 + 20 * i, [0.5, 0.5, 0.5, 0.25, 0.5, 0.5], 2) for i in range(15)]
    rows += [(3000, None, 1), (3020, [1.0] * 6, None), (3040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3060, [float("nan")] * 6, 1), (3080, [float("inf")] * 6, 1), (None, [0.5] * 6, 1)]
    rows += [(3100, [0.1, 0.2], 1), (3101, [0.3, 0.1], 1), (3102, [0.2, 0.1], 2), (3120, [], 1), (3121, [], 1), (3122, [], 3), (3140, [3e4] * 6, 9), (3141, [2e4] * 6, 9), (3142, [1e4] * 6, 8)]
    return rows + [rows[20], rows[41], (20, rows[20][1], 3)]


def mined(rows, k=5, m=10):
    fine = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, x, lab) in enumerate(fine):
        if i % 20:
            continue
        dot = [(sum(p * q for p, q in zip(x, y, strict=True)), j, other, b) for b, (j, y, other) in enumerate(fine) if len(y) == len(x)]
        order = lambda s: (-s[0], s[1])
        positives = sorted((s for s in dot if s[2] == lab and s[3] != a), key=order)[:k]
        for ps, pid, *_ in positives:
            negatives = sorted((s for s in dot if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:m]
            out += [(i, pid, r + 1, s[1], ps, s[0]) for r, s in enumerate(negatives)]
    return sorted(out)


@pytest.mark.parametrize(("block", "scores"), [(65536, 1 << 22), (40, 64)])
def test_hard_negatives(spark, monkeypatch, block, scores):
    monkeypatch.setattr(hard_negatives, "SCORES", scores)
    df = spark.createDataFrame([(*r, "r", "s", 1, "a", 1) for r in vectors_of()], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, F.col("label"), block=block)
    assert sorted(tuple(r) for r in got.collect()) == mined(vectors_of())


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, F.col("label")).collect() == []
    lonely = spark.createDataFrame([(20, [1.0], 1, "r", "s", 1, "a", 1), (21, [1.0], 2, "r", "s", 1, "a", 1)], VECTORS)
    assert hard_negatives.hard_negatives(lonely, F.col("vec_id") % 20 == 0, F.col("label")).collect() == []


def test_inner_products_are_exact():
    rng = np.random.default_rng(7)
    for size in (4, 1 << 10, 1 << 22, 1 << 29):
        a, b = (rng.integers(-size, size, (5, 8)).astype(float) for _ in range(2))
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
        assert hard_negatives.inner(a, b).tolist() == want
    assert hard_negatives.inner(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


# ---- stored codes of embeddings --------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1, 2, 5, 64, 300])
def test_estimates_are_unbiased_and_bounded(size):
    """Mean error over many rotations is near zero, and true cosines stay within the stated bound."""
    rng = np.random.default_rng(size)
    x = embeddings.unit(rng.standard_normal((40, size)) + (np.arange(40)[:, None] % 3 == 0))
    truth, errors, outside = x @ x.T, [], 0
    for seed in range(30):
        stored = embeddings.Stored(embeddings.encoded(x, 1000 * seed), size, 1000 * seed)
        estimate = stored.rebuilt[0] @ stored.rebuilt[1].T
        errors.append(estimate - truth)
        v = stored.variance[0][:, None] + stored.variance[1] + stored.variance[0][:, None] * stored.variance[1] * size
        outside += int((np.abs(estimate - truth) > 5 * np.sqrt(v) + 1e-5).sum())
        assert not (~stored.undecided(0, 40, 0.93, 5.0) & (truth >= 0.93)).any()
    error = np.array(errors)
    assert outside <= 5 and abs(error.mean()) < 0.01
    assert np.abs(error.mean(0)).max() <= 5 * max(error.std(0).max(), 1e-6) / math.sqrt(30)


def test_vectors_are_fetched_for_undecided_pairs_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, 0, rng.standard_normal(64).tolist()) for i in range(900)]
    rows += [(1000 + i, 0, (np.array(rows[i][2]) + 0.05 * rng.standard_normal(64)).tolist()) for i in range(40)]
    sizes, cut = {}, embeddings.cut
    monkeypatch.setattr(embeddings, "cut", lambda df, name, *a: sizes.setdefault(name, cut(df, name, *a)))
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sum(r["n_links"] for r in got.collect()) == 80
    assert sizes["asked"].select("place").distinct().count() < 0.15 * len(rows)


def test_rows_that_share_an_id_are_counted_apart(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, 0, a), (1, 0, b), (2, 0, [1.0, 0.01, 0.0])], "vec_id long, label int, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
