"""The ten operators against brute force, on texts with nulls, ties, repeated rows, and columns with clashing names."""

import collections
import functools
import hashlib
import inspect
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import bpe, common, embeddings, fingerprint, language_model, licenses, minhash, mixing, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, source string, size long, component string, label int, words string, rank int, row string"


def rows_of():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "éclair", "zeta", "ETA", "theta,", "iota."]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    base = " ".join(f"w{i}" for i in range(120))
    texts += [base, base, base.replace("w7 ", "other "), base.replace("w50", "x y"), base.upper()]
    texts += [None, None, "", "   ", "one", "one two three", "ONE two\tthree", "\n\n", "日本語 テキスト", "a" * 5000, "line\nline\nother line"]
    texts += ["Released under the MIT License.", "mit\nlicense apache  LICENSE; General-Public License", "licensed under cc by-nc 4.0", "mit licenses"]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 99, "x", 1, "w", 5, "r") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[41], (None, base, None, 1, None, None, None, None, None), (None, None, "s1", 1, None, None, None, None, None), (2**60 + 1, "big id text", "s2", 1, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates(docs, none):
    got = minhash.near_duplicates(docs, k=4).collect()
    sets = collections.defaultdict(list)
    for r in rows_of():
        if r[0] is not None:
            sets[r[0]].append(shingles(r[1], 4))
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert len(got) == len(rows_of())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert r["component_id"] == top(r["doc_id"]) and r["kept"] == (top(r["doc_id"]) == r["doc_id"])
            assert r["n_shingles"] in map(len, sets[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    s = minhash.super_minhash(np.concatenate([a, b, a[:1]]), np.array([300, 300, 1]), 128)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15
    assert len(set((s[2] >> np.uint64(32)).tolist())) == 128  # one element meets every register once


def test_large_buckets_are_split(spark, monkeypatch):
    rows = [(i, " ".join([f"w{j}" for j in range(60)] + [f"own{i}"])) for i in range(40)]
    monkeypatch.setattr(minhash, "BUCKET", 8)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_hubs_connect_a_large_bucket_and_the_rest_meets_all(spark, monkeypatch):
    """One bucket of two kinds of texts and some odd ones: all links between different texts are found."""
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "HUBS", 2)
    head = [f"w{j}" for j in range(40)]
    rows = [(i, " ".join(head + [f"{kind}{j}" for j in range(25)] + [f"own{i}"])) for i, kind in enumerate("a" * 30 + "b" * 11 + "cdef")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=64, rows=1).collect()}
    assert got == {i: 0 if i < 30 else 30 if i < 41 else i for i in range(45)}


def test_recall_near_the_threshold(spark):
    """Pairs at similarities from 0.8 to 0.86, each in a group of its own: at least 0.9 of them are found (all of them, but for luck), and none below 0.8."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(300):
        n, change = rng.randrange(60, 200), 0
        words = [f"p{i}x{j}" for j in range(n)]
        other = list(words)
        while True:
            change += 1
            nxt = [*other]
            nxt[-change] = f"q{i}y{change}"
            a, b = shingles(" ".join(words), 5), shingles(" ".join(nxt), 5)
            if len(a & b) < 0.8 * len(a | b):
                break
            other = nxt
        below = i % 3 == 0
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(nxt if below else other))]
        want[2 * i + 1] = 2 * i + 1 if below else 2 * i
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [d for d, c in want.items() if c != d]
    assert sum(got[d] == want[d] for d in near) >= 0.9 * len(near) and all(got[d] == d for d in want if want[d] == d)


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001), (5, 5)], "a long, b long")
    got = dict(common.components(edges).collect())
    assert {got[i] for i in ids} == {0} and got[1001] == 1000


def test_later_links_join_earlier_groups(spark):
    rng = random.Random(2)
    pairs = [[(rng.randrange(150), rng.randrange(150)) for _ in range(n)] for n in (40, 0, 30, 25)]
    walked, plain = [], common.components
    groups, so_far = None, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "components", lambda edges: plain((walked.append(edges.where("a <> b").count()), edges)[1]))
        for lot in pairs:
            so_far += lot
            groups = common.regrouped(groups, spark.createDataFrame(lot, "a long, b long"))
            assert sorted(map(tuple, groups.collect())) == sorted(map(tuple, plain(spark.createDataFrame(so_far, "a long, b long")).collect()))
        common.regrouped(groups, spark.createDataFrame(so_far, "a long, b long"))
    assert walked[-1] == 0  # what is connected already isn't walked again


def test_licenses(docs, none):
    got = collections.Counter(tuple(r)[:6] for r in licenses.scan_licenses(docs).collect())
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = collections.Counter()
    for d, t, *_ in rows_of():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        want[d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    assert got == want
    labels = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert labels[56]["labels"] == "mit,mit-notice" and labels[56]["score"] == 1.0 and labels[58]["labels"] == "cc-by-nc" and labels[59]["labels"] == ""
    assert licenses.scan_licenses(none).count() == 0


def test_ascii_lower(spark):
    got = spark.createDataFrame([("AZ\u00c9 \u212a \u0130K",), ("PLAIN",), (None,)], "t string").select(common.ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["az\u00c9 \u212a \u0130k", "plain", None]


def fingerprint_order(rows):
    tie = lambda t: int(np.array(fingerprint.xxhash.xxh64_intdigest((t or "").encode(), 42), np.uint64).astype(np.int64))
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))


def likeness_of(a, b):
    """Run by run in whole numbers: the cosine of signed sums of three-word runs."""

    def lanes(text):
        out, most = [0] * fingerprint.LIKE, 1 << 64
        for line in text.split("\n"):
            h = [fingerprint.xxhash.xxh3_64_intdigest(w) | 1 for w in line.encode().split()] + [0, 0]
            for x, y, z in zip(h, h[1:-1], h[2:]):
                v = (x + y * 0xD6E8FEB86659FD93 + z * 0xA0761D6478BD642F) % most
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    v = (v ^ v >> shift) * factor % most
                out[v % fingerprint.LIKE] += 1 if v >> 63 else -1
        return out

    x, y = lanes(a), lanes(b)
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return 1.0 if sorted(a.split("\n")) == sorted(b.split("\n")) else max(0.0, sum(v * w for v, w in zip(x, y)) / norm) if norm else 0.0


def test_likeness_is_that_of_a_plain_count(docs):
    ordered = fingerprint_order(rows_of())
    got = collections.defaultdict(set)
    for r in fingerprint.edited_fingerprints(docs, blocks=5).collect():
        got[r["doc_id"], r["edited_sha256"]].add((r["near_edited"], r["near_next"]))
    for r, nxt in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = r[1] or "", nxt[1] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want = likeness_of(t, edited), likeness_of(t, u)
        assert any(all(abs(x - y) < 2e-6 for x, y in zip(g, want)) for g in got[r[0], hashlib.sha256(edited.encode()).hexdigest()])


def test_half_the_rows_without_an_id_are_split(spark):
    rows = [(None if i % 2 else i, f"text number {i} " * 50) for i in range(400)]
    found = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), blocks=8)
    ordered = fingerprint_order(rows)
    want = collections.Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() for (_, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]))
    assert collections.Counter(r["edited_sha256"] for r in found.collect()) == want
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 200


def test_fingerprints(docs, none):
    got = fingerprint.edited_fingerprints(docs, blocks=4).collect()
    ordered = fingerprint_order(rows_of())
    want = collections.Counter()
    for r, nxt in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = r[1] or "", nxt[1] or ""
        want[r[0], len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprint.edited_fingerprints(none, blocks=4).count() == 0


def test_fingerprints_are_homomorphic():
    a, b, ab, ba, aa = fingerprint.fingerprints(["x y z", "other words", "x y z\nother words", "other words\nx y z", "x y z\nx y z"])
    assert (fingerprint.combine(a, b) == ab).all() and (ab == ba).all() and (fingerprint.combine(ab, b, -1) == a).all() and (aa != a).any()
    assert fingerprint.likeness(ab[None], ba[None])[0] == 1 and fingerprint.likeness(a[None], b[None])[0] < 0.3


def test_fingerprints_of_many_equal_words_do_not_wrap():
    both = fingerprint.fingerprints(["word " * 40_000, "word " * 20_000])
    assert fingerprint.likeness(both[:1], both[1:])[0] > 0.999
    doubled = fingerprint.combine(both[1], both[1])
    assert fingerprint.likeness(doubled[None], both[:1])[0] > 0.999
    assert (fingerprint.combine(doubled, both[1], -1) == both[1]).all()


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        v = rng.standard_normal(16)
        rows += [(4 * i, i % 3, v.tolist()), (4 * i + 1, i % 3, (v + 0.25 * rng.standard_normal(16)).tolist()), (4 * i + 2, (i + 1) % 3, v.tolist())]
    rows += [(0, 0, rows[0][2]), (900, 0, rows[0][2]), (901, 0, None), (902, 0, [0.0] * 16), (903, None, rows[0][2]), (904, 0, [float("nan")] * 16), (905, 0, [None] + [1.0] * 15), (906, 0, []), (None, 0, rows[0][2]), (907, 0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, node string")
    got = embeddings.near_duplicate_vectors(df).collect()
    fine = [(d, y, np.array(v, float)) for d, y, v in rows if d is not None and y is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v) != 0)]
    links, parent = collections.defaultdict(list), {d: d for d, *_ in fine}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, y, v) in enumerate(fine):
        n = 0
        for j, (e, z, w) in enumerate(fine):
            if i != j and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                n += 1
                a, b = sorted((top(d), top(e)))
                parent[b] = a
        links[d].append(n)
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] in links and r["n_links"]:
            assert r["n_links"] in links[r["vec_id"]] and r["component_id"] == top(r["vec_id"])
    want = sorted((d, n) for d, ns in links.items() for n in ns)
    have = sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] in links)
    assert want == have
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_near_the_threshold(spark):
    """Recall of pairs at cosines from 0.93 to 0.95, each by itself among others, against brute force; nothing below 0.93."""
    rng, rows = np.random.default_rng(9), []
    for i in range(400):
        v, w = rng.standard_normal(64), rng.standard_normal(64)
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = 0.91 + 0.04 * i / 399
        rows += [(2 * i, 0, v.tolist()), (2 * i + 1, 0, (c * v + math.sqrt(1 - c * c) * w).tolist())]
    x = np.array([r[2] for r in rows])
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) - 2 * np.eye(len(x))
    want = (cosine >= 0.93).sum(1)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 300


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, block_words=4, cells=8).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((r[0], r[2], n(r[1])) for r in rows_of())
    sizes = collections.Counter()
    for r in rows_of():
        sizes[r[2]] += n(r[1])
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, pot = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = pot / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            pot -= target[s]
        open_ -= full
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-5) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 4 * 12 for s in names)
    again = mixing.mix_sources(docs.repartition(7), block_words=4, cells=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(none).count() == 0


def test_apportionment_is_by_highest_quotients(spark):
    votes = [53.0, 24.0, 23.0, 7.5, 0.0, 1.0]
    df = spark.createDataFrame([(1, i, v, 17) for i, v in enumerate(votes)], "g int, p int, votes double, seats int")
    got = {r["p"]: r["quota"] for r in mixing.apportion(df, "g", "p", "votes", "seats").collect()}
    want = collections.Counter()
    for _ in range(17):
        want[max(range(6), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert got == {i: want[i] for i in range(6)}


def test_bpe_is_exact(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    got = collections.Counter(tuple(r) for r in bpe.encode_documents(docs).collect())
    want = collections.Counter()
    for r in rows_of():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want and bpe.encode_documents(none).count() == 0
    model = bpe.load(bpe.tokenizer_path())
    for text in ["<|endoftext|>a<|endoftext|>", "\x1c\x85 　x", "🎉é́ 12345", "aaaa" * 300, "it's WE'LL", " \n\n  b", "don't  stop\r\n"]:
        assert model.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids and model.decode(model.encode(text)) == text


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, shards=5, cells=3).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows_of())
    slots, homes = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(none).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 50) for _ in range(300)]
    at = sharding.best_fit_decreasing(sizes, 60)
    left, want = [], [0] * 300
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fit = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        b = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(60)
        left[b] -= sizes[i]
        want[i] = b
    assert at == want
    runs = sorted(collections.Counter(sizes).items(), reverse=True)
    loads = collections.Counter()
    for i, b, n in sharding.pack(runs, 7):
        loads[b] += n * runs[i][0]
    assert len(loads) <= 7 and max(loads.values()) - min(loads.values()) <= 4


def test_runs_pack_like_single_items():
    """The bins of 100,000 items placed one by one, in size order, are those of their runs."""
    rng = random.Random(8)
    sizes = sorted((int(rng.lognormvariate(6, 1)) + 1 for _ in range(100_000)), reverse=True)
    runs = [(s, len(list(g))) for s, g in itertools.groupby(sizes)]
    for capacity in (max(sizes), sum(sizes) // 15):
        dealt = [b for _, b, n in sharding.best_fit_runs(runs, capacity) for _ in range(n)]
        assert dealt == sharding.best_fit_decreasing(sizes, capacity)


def test_shards_are_those_of_the_packing(spark):
    """Every group is packed by itself: each size's groups fill the bins as the packing says."""
    rng = random.Random(9)
    texts = ["x" * int(rng.lognormvariate(3, 1)) + str(i % 700) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).collect()
    groups = collections.Counter()
    for t in texts:
        groups[t] += len(t) + 1
    runs = sorted(collections.Counter(groups.values()).items(), reverse=True)
    want = collections.Counter()
    for i, b, n in sharding.pack(runs, 6):
        want[runs[i][0], b] += n
    home = {texts[r["doc_id"]]: r["shard"] for r in got}
    assert collections.Counter((groups[t], b) for t, b in home.items()) == want


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://www.Example.com/{i % 5}?b=2&a=1", t) for i, t in enumerate(["<p>one</p>", "<p>one</p>", "", None, "a\r\n\r\nWARC/1.1\r\n\r\nb", "é" * 1000, "<p>one</p>"])] + [(None, None, "x"), (9, "bad url\r\nX: y", "x"), (9, "u", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, top string")
    warc.write_warc(df, str(tmp_path / "w"), file_bytes=2000)
    got = [tuple(r) for r in warc.capture_history(spark, str(tmp_path / "w"), 3).select("page_id", "payload_bytes", "record_type", "refers_to", "urlkey").collect()]
    best = {}
    for i, _, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    want = sorted((str(i), len((t or "").encode()), "response" if best[t or ""] == (-1 if i is None else i) else "revisit") for i, _, t in rows)
    assert sorted((str(a), b, c) for a, b, c, *_ in got) == want
    keys = [g[4] for g in got]
    assert keys == sorted(keys) and "com,example)/0?a=1&b=2" in keys
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.capture_history(spark, str(tmp_path / "e"), 2).count() == 0


def test_spooled_runs_are_merged():
    """Runs that come in several batches are merged from disk in the order of all rows."""
    rng = random.Random(6)
    rows = [(f"u{rng.randrange(9)}", f"t{rng.randrange(5)}", rng.choice([None, rng.randrange(50)]), "response", 1, "D", None, f"f{k % 7}", k, 1) for k in range(900)]
    key = lambda r: (r[7], warc.sort_key(r))
    dealt = [[*r, r[7]] for r in sorted(rows, key=key)]
    names = [c.split()[0] for c in warc.INDEX.split(", ")] + ["run"]
    kinds = [warc.pa.int64() if c.split()[1] == "long" else warc.pa.string() for c in warc.INDEX.split(", ")] + [warc.pa.string()]
    spool = warc.Spool()
    for i in range(0, 900, 64):
        spool.add(warc.pa.RecordBatch.from_arrays([warc.pa.array(c, t) for c, t in zip(zip(*dealt[i : i + 64]), kinds)], names=names))
    assert spooled(spool) == sorted(rows, key=warc.sort_key)


def spooled(spool):
    return [tuple(r) for b in spool.merged() for r in zip(*(c.to_pylist() for c in b.columns))]


def test_a_thousand_runs_are_merged_in_passes(monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 4)
    monkeypatch.setattr(warc, "BATCH", 7)
    names = [c.split()[0] for c in warc.INDEX.split(", ")] + ["run"]
    kinds = [warc.pa.int64() if c.split()[1] == "long" else warc.pa.string() for c in warc.INDEX.split(", ")] + [warc.pa.string()]
    rng, rows = random.Random(2), []
    for run in range(1000):
        own = [(f"k{rng.randrange(50)}", "2020", rng.choice([None, rng.randrange(9)]), "response", 1, "d", None, f"f{run}", i, 5) for i in range(rng.randrange(1, 4))]
        rows += [(*r, f"r{run:04}") for r in sorted(own, key=warc.sort_key)]
    spool = warc.Spool()
    for i in range(0, len(rows), 50):
        spool.add(warc.pa.RecordBatch.from_arrays([warc.pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50]), kinds)], names=names))
        assert all(len(level) < 4 for level in spool.levels) and len(spool.levels) <= 6
    assert spooled(spool) == sorted((r[:-1] for r in rows), key=warc.sort_key)


def test_very_long_pages(spark, tmp_path):
    rows = [(1, "http://a", "<p>" + "long é " * 700_000), (2, "http://b", "short"), (3, "http://c", "<p>" + "long é " * 700_000)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.capture_history(spark, str(tmp_path / "w"), 2).collect()}
    size = len(rows[0][2].encode())
    assert got == {1: (size, "revisit", 3), 2: (5, "response", None), 3: (size, "response", None)}


def test_loser_tree_merge():
    rng = random.Random(4)
    row = lambda: (rng.choice("abc"), str(rng.randrange(9)), rng.choice([None, 1, 2]), "response", 0, "", None, "f", rng.randrange(99), 1)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted([row() for _ in range(rng.randrange(6))], key=warc.sort_key) for _ in range(k)]
        merged = list(warc.loser_tree_merge(runs))
        assert [warc.sort_key(r) for r in merged] == sorted(warc.sort_key(r) for run in runs for r in run)


def lm_in_one_process(rows, burn_in=2, samples=2, theta=1.0):
    """The language model dish by dish in plain Python, with Stirling numbers of its own: (after, word) -> probability."""
    hashed = functools.cache(lambda w: np.array([language_model.xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64))
    tokens = lambda t: [b"\t", *(t or "").encode().lower().split(), b"\n"]
    learned = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    n = collections.Counter(p for x in learned for p in itertools.pairwise(x))
    count, follows = collections.Counter(w for x in learned for w in x[1:]), collections.Counter(w for x in learned for w in x[:-1])
    base = 1 / (len(count) + 1)

    @functools.cache
    def weight(d, c, t):
        if t < 1 or t > c:
            return 0.0
        return 1.0 if c == 1 else weight(d, c - 1, t - 1) + (c - 1 - d * t) * weight(d, c - 1, t)

    alone = lambda d, c, t: weight(d, c - 1, t - 1) / weight(d, c, t)
    opens = lambda d, c, t, others, p: (others + d * t) * p / ((others + d * t) * p + c - d * t)

    def first(d, c, others, p):
        low, high = 1, c
        while low < high:
            t = (low + high + 1) // 2
            low, high = (t, high) if opens(d, c - 1, t - 1, others, p) >= alone(d, c, t) else (low, t - 1)
        return low

    def moved(d, c, t, others, p, key):
        for k in range(min(c, language_model.MOVES) if c > 1 else 0):
            leaves, sits = (float(x[0]) for x in language_model.uniforms(key, k))
            t -= leaves < alone(d, c, t)
            t += sits < opens(d, c - 1, t, others, p)
        return t

    t = dict.fromkeys(n, 1)
    often = collections.Counter(n.values())
    d = language_model.discount_of(often[1], often[2])
    root, kept = {}, []
    for sweep in range(burn_in + samples + 1):
        c = collections.Counter()
        for (_, w), k in t.items():
            c[w] += k
        few = collections.Counter(c.values())
        d0 = language_model.discount_of(few[1], few[2])
        if sweep:
            clipped, (d1, before) = {w: min(root[w], c[w]) for w in c}, last
            root = {w: moved(d1, c[w], clipped[w], theta + d1 * (before - clipped[w]), base, language_model.seat_key(sweep, hashed(w))) for w in c}
        else:
            root = {w: first(d0, c[w], theta + d0 * len(c), base) for w in c}
        last = d0, sum(root.values())
        unseen = (theta + d0 * sum(root.values())) / (theta + sum(c.values())) * base
        p = {w: (c[w] - d0 * root[w]) / (theta + sum(c.values())) + unseen for w in c}
        at = collections.Counter()
        for (u, _), k in t.items():
            at[u] += k
        for (u, w), k in n.items():
            if k > 1:
                others = theta + d * (at[u] - t[u, w])
                t[u, w] = moved(d, k, t[u, w], others, p[w], language_model.seat_key(sweep, hashed(u), hashed(w))) if sweep else first(d, k, others, p[w])
        if sweep > burn_in:
            at = collections.Counter()
            for (u, _), k in t.items():
                at[u] += k
            kept.append((dict(t), at, p, unseen))
    probability = lambda u, w: sum((n[u, w] - d * t.get((u, w), 0) + (theta + d * at[u]) * p.get(w, unseen)) / (theta + follows[u]) for t, at, p, unseen in kept) / samples
    return probability, tokens, count


def test_lm_is_the_model_of_one_process(spark):
    """Scores don't hang on slices, files or partitions, and are those of a plain sampler; probabilities sum to one."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["ration", "nation", "Überzug"]
    texts = [" ".join(words[min(int(rng.expovariate(0.2)), 32)] for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[7]), (None, "never seen w1 before"), (None, None)]
    probability, tokens, count = lm_in_one_process(rows)
    assert max(collections.Counter(p for x in texts for p in itertools.pairwise(tokens(x))).values()) > 40
    for u in [b"\t", *count]:
        if u != b"\n":
            assert math.isclose(sum(probability(u, w) for w in [*count, b"never"]), 1.0, rel_tol=1e-9)
    want = collections.defaultdict(set)
    for _, t in rows:
        want[t].add(round(sum(math.log10(probability(u, w)) for u, w in itertools.pairwise(tokens(t))), 6))
    total = sum(len((t or "").encode()) for _, t in rows)
    for deal, size, parts in ((2, 8 << 20, 1), (7, 500, 3), (40, 60, 11)):  # parts of the model, which send each other what they need
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(deal)
        got = language_model.score_texts(frame, slice_characters=size, part_tokens=total // (6 * parts)).join(frame.select("doc_id", "text").distinct(), "doc_id").collect()
        assert len(got) == 300 + 1
        assert all({round(r["score"], 6)} == want[r["text"]] for r in got)


def test_lm_chances_of_sitting_alone():
    """Exact up to EXACT customers; beyond, the estimate stays near the exact ratio."""
    for d in (0.3, 0.6, 0.8, 0.95):
        alone = language_model.Alone(d)
        log = np.full((701, 702), -np.inf)
        log[1, 1] = 0.0
        for c in range(2, 701):
            t = np.arange(1, c + 1)
            log[c, 1 : c + 1] = np.logaddexp(log[c - 1, :c], np.where(t < c, np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf) + log[c - 1, 1 : c + 1])
        for c, near in ((40, 1e-9), (256, 1e-9), (257, 0.09), (700, 0.09)):
            t = np.arange(2, c + 1)
            assert np.abs(alone(np.full(len(t), c), t) / np.exp(log[c - 1, t - 1] - log[c, t]) - 1).max() < near
            assert alone(np.array([c]), np.array([1]))[0] == 0


def test_lm_moves_sample_the_conditional():
    """Moves of single customers lead to tables in proportion to S(c, t) times the weights of new tables."""
    c, d, others, p = 9, 0.6, 3.0, 0.2
    weight = {(1, 1): 1.0}
    for k in range(2, c + 1):
        for t in range(1, k + 1):
            weight[k, t] = weight.get((k - 1, t - 1), 0) + (k - 1 - d * t) * weight.get((k - 1, t), 0)
    exact = np.array([weight[c, t] * p**t * math.prod(others + d * j for j in range(t)) for t in range(1, c + 1)])
    n, alone = 20000, language_model.Alone(d)
    t = np.ones(n, np.int64)
    for sweep in range(6):
        t = language_model.moved(np.full(n, c), t, np.full(n, others), np.full(n, p), alone, language_model.seat_key(sweep, np.arange(n)))
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - exact / exact.sum()).max() < 0.015


def test_toxicity_learns(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows, labels = [], []
    for i in range(260):
        w = [word() for _ in range(rng.randrange(5, 90))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "vilest", "grim"]) + word()[:2] + "!"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(None, None), (1000, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    judged = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 260]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in judged]) > 0.9
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, empty).count() == 0


def test_network_gradients():
    net = toxicity.Network([b"ab", b"c"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, y = [[b"ab", b"c", b"xyz"], [b"c"], [b"q", b"ab"]], np.array([1.0, 0.0, 1.0])
    _, g = net.learn(windows, y)
    for name in ("cuf", "cub", "uf", "ub", "w", "cw", "key", "query", "out", "chars"):
        p, at = net.p[name], np.unravel_index(np.abs(g[name]).argmax(), net.p[name].shape)
        old = p[at]
        p[at] = old + 1e-3
        up = net.learn(windows, y)[0]
        p[at] = old - 1e-3
        down = net.learn(windows, y)[0]
        p[at] = old
        assert math.isclose((up - down) / 2e-3, g[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_words_are_read_once(monkeypatch):
    """Blocks of texts share their words, and equal texts one score; scores are those of the pass that learning takes."""
    rng = random.Random(9)
    some = ["abc", "Abc,", "x" * 40, "--", "\u00e9t\u00e9", *("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15))) for _ in range(60))]
    texts = [" ".join(rng.choice(some) for _ in range(n)) for n in (0, 1, 5, 31, 32, 33, 48, 120) for _ in range(4)]
    texts += [None, "", " \t", *texts[-9:]]
    net = toxicity.Network([b"abc", b"--"], 3)
    net.p = {k: v if k == "words" else v + np.float32(0.3) * np.random.default_rng(1).standard_normal(v.shape).astype(np.float32) for k, v in net.p.items()}
    read, inputs = [], toxicity.Network.inputs
    monkeypatch.setattr(toxicity.Network, "inputs", lambda self, words, *more: (read.extend(words), inputs(self, words, *more))[1])
    got = net.scores(texts, most=200)
    tokens = {t for x in texts for t in toxicity.tokens(x)}
    assert collections.Counter(read) == collections.Counter(tokens)
    for text, score in zip(texts, got, strict=True):
        held = toxicity.tokens(text)
        at = sorted(set(held)) or [b""]
        a = net.word_vectors(at)[0] @ net.p["w"] + net.p["b"]
        best = []
        for s in toxicity.window_starts(len(held)):
            part = [at.index(w) for w in held[s : s + toxicity.WINDOW]]
            mask = (np.arange(toxicity.WINDOW) < len(part)).astype(np.float32)[None]
            best.append(float(net.pooled(a[np.array(part + [0] * (toxicity.WINDOW - len(part)))][None], mask)[0][0]))
        assert math.isclose(score, toxicity.sigmoid(np.float64(max(best))), abs_tol=2e-6), text


def test_known_words_are_bounded():
    net = toxicity.Network([b"ab"], 3)
    blocks = [[f"w{i} ab {'long' * 5}{i % 3} w{i + 1}", None, f"(w{i}) ab"] for i in range(12)] + [[""], [None], ["ab"]]
    known = toxicity.Known(net, most=6)
    for block in blocks:
        for got, want in zip(net.window_logits(block, known), net.window_logits(block), strict=True):
            assert np.allclose(got, want, atol=1e-6)
        assert len(known.raw) <= 6 + 5 and known.table.shape[1] == len(known.seen)


def test_training_holds_tokens_as_numbers():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(3000)) for _ in range(100)]
    tracemalloc.start()
    net = toxicity.train(texts, [i % 2 for i in range(100)], epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(net.index) == 3000
    assert peak < 16 * 100 * 3000  # four bytes a token and what is held once for each word


def test_training_takes_texts_without_words():
    for texts in ([], [None, "", " "], [None, "one two"]):
        a, b = (toxicity.train(texts, [0] * len(texts), epochs=3) for _ in range(2))
        assert a.scores(["one", None]) == b.scores(["one", None])


def test_windows_cover_all_tokens():
    for n in (0, 1, 16, 31, 32, 33, 48, 49, 200):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_lm_scores(docs, none):
    got = language_model.score_texts(docs, slice_characters=3000).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c = collections.Counter(w for r in rows_of() if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], held(r[0]), len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r[1])), 6)) for r in rows_of())
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_texts(none).count() == 0


def test_lm_without_training_words(spark):
    """A batch of words that only held-out documents hold packs to nothing."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = language_model.score_texts(spark.createDataFrame([(i, f"only{i} held") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == len(ids) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] <= 0 for r in got)


def test_lm_sweeps_are_those_of_the_readme():
    found = inspect.signature(language_model.score_texts).parameters
    assert (found["burn_in"].default, found["samples"].default) == (2, 2)
