"""The language model's sweeps, and its cost: one reading asks for words and pairs, and chances are worked out once a state."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest

from lumenframe.llm import language_model


def test_chances_of_large_dishes_are_worked_out_once_a_state(monkeypatch):
    """Moves are those of chances worked out anew every time, by far fewer bisections."""
    rng = np.random.default_rng(3)
    n = 400
    c = np.where(rng.random(n) < 0.5, rng.integers(1, 100, n), rng.integers(200, 60000, n))
    d, alone = 0.7, language_model.Alone(0.7)
    others, p, key = rng.random(n) * 1000 + 1, rng.random(n) * 0.1, language_model.seat_key(1, np.arange(n))
    begin = language_model.first_tables(c, others, p, alone)
    want = begin.copy()
    for k in range(language_model.MOVES):
        leaves, sits = language_model.uniforms(key, k)
        after = want - (leaves < alone(c, want))
        after += sits < language_model.opens(c - 1, after, others, p, d)
        want = np.where((c > 1) & (k < c), after, want)
    asked, at_saddle = [], language_model.Alone.at_saddle
    monkeypatch.setattr(language_model.Alone, "at_saddle", lambda self, c, t: asked.append(len(c)) or at_saddle(self, c, t))
    assert (language_model.moved(c, begin, others, p, alone, key) == want).all()
    large = int((c > language_model.EXACT).sum())
    assert 0 < large <= sum(asked) < 0.5 * large * language_model.MOVES


@pytest.mark.parametrize("wide", [[], ["w0", "w1"]])
def test_one_reading_asks_for_words_and_pairs(spark, wide):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{min(int(x), 25)}" for x in rng.exponential(4, rng.integers(0, 30))) for _ in range(200)] + [None, "", "  a  b "]
    hashed = lambda w: language_model.xxhash.xxh3_64_intdigest(w) - (1 << 64) * (language_model.xxhash.xxh3_64_intdigest(w) >> 63)
    tokens = lambda t: [b"\t", *(t or "").encode().lower().split(), b"\n"]
    of = np.array([hashed(w.encode()) for w in wide], np.int64)
    rows = spark.createDataFrame([(str(i), t, i % 3) for i, t in enumerate(texts)], "doc_id string, text string, chunk long").coalesce(2)
    words, pairs, part_of = collections.Counter(), collections.Counter(), {}
    for r in language_model.asked(rows, 10, 900, 5, of).collect():
        a = language_model.hashes_of(r["a"])
        if r["kind"] == "word":
            words.update(dict(zip(a.tolist(), language_model.unpacked(r["b"], len(a)).tolist(), strict=True)))
            continue
        c = language_model.hashes_of(r["c"])
        ctx = np.repeat(a, language_model.unpacked(r["b"], len(a)))
        for u, w, n in zip(ctx.tolist(), c.tolist(), language_model.unpacked(r["d"], len(c)).tolist(), strict=True):
            pairs[u, w] += n
            assert part_of.setdefault((u, w) if u in of else u, r["part"]) == r["part"]
    learned = [tokens(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert words == collections.Counter({hashed(w): 0 for t in texts for w in tokens(t)}) + collections.Counter(hashed(w) for x in learned for w in x)
    assert +pairs == collections.Counter((hashed(u), hashed(w)) for x in learned for u, w in itertools.pairwise(x))
    assert set(pairs) == {(hashed(u), hashed(w)) for t in texts for u, w in itertools.pairwise(tokens(t))}


def test_wide_contexts_are_the_frequent_ones(spark):
    """A word that a long text is full of is found from excerpts, wherever it stands; rare ones aren't."""
    long = " ".join(f"x{i} the" for i in range(60000))
    rows = spark.createDataFrame([(long,), (None,), ("",), ("seldom here",)], "text string")
    total, wide = language_model.wide_contexts(rows)
    hashed = lambda w: np.array([language_model.xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64)[0]
    assert total == len(long) + len("seldom here")
    assert {hashed(b"the"), language_model.START_HASH} <= set(wide.tolist()) and hashed(b"seldom") not in wide


def one_by_one(c, t, others, p, alone, rng):
    """A sweep of c moves in each of many equal dishes, none skipped."""
    at = np.arange(len(t))
    chances = language_model.Visited(np.full(len(t), c), t, alone)
    for _ in range(c):
        t = t - (rng.random(len(t)) < chances(at, np.full(len(t), c), t))
        t = t + (rng.random(len(t)) < language_model.opens(c - 1, t, others, p, alone.d))
    return t


@pytest.mark.parametrize(("c", "d", "others", "p", "begin"), [(65, 0.6, 30.0, 0.3, 65), (200, 0.5, 20.0, 0.1, 1), (1500, 0.8, 300.0, 0.05, 400)])
def test_a_sweep_moves_every_customer(c, d, others, p, begin):
    """One sweep leads as far, and spreads as much, as c moves one by one; the first MOVES of them don't."""
    n, alone = 3000, language_model.Alone(d)
    t = np.full(n, begin)
    want = one_by_one(c, t, others, p, alone, np.random.default_rng(7))
    given = np.full(n, c), t, np.full(n, others), np.full(n, p), alone, language_model.seat_key(1, np.arange(n))
    got = language_model.swept(*given)
    near = 5 * want.std() / math.sqrt(n)
    assert abs(got.mean() - want.mean()) < 1.5 * near and abs(got.std() - want.std()) < near
    top = int(max(got.max(), want.max())) + 1
    assert np.abs(np.cumsum(np.bincount(got, minlength=top)) - np.cumsum(np.bincount(want, minlength=top))).max() < 0.05 * n
    if c > 100:
        assert abs(language_model.moved(*given).mean() - want.mean()) > 3 * near


def test_skips_are_those_of_plain_numbers():
    """Dishes of all sizes among each other end where each ends alone, and tables wander beyond what is kept of a dish."""
    rng = np.random.default_rng(8)
    n, d = 120, 0.8
    c = np.where(rng.random(n) < 0.4, rng.integers(1, 300, n), rng.integers(200, 20000, n))
    others, p, alone, key = rng.random(n) * 300 + 1, rng.random(n) * 0.1, language_model.Alone(d), language_model.seat_key(2, np.arange(n))
    begin = np.maximum(c // 8, 1)
    got = language_model.swept(c, begin, others, p, alone, key)
    first = language_model.moved(c, begin, others, p, alone, key)
    assert np.abs(got - first).max() > 4 * language_model.MOVES and (got[c <= language_model.MOVES] == first[c <= language_model.MOVES]).all()
    for i in range(n):
        t, left, k, one = int(first[i]), int(c[i]) - language_model.MOVES, language_model.MOVES, c[i : i + 1]
        while left > 0:
            leaves = float(alone(one, np.array([t]))[0])
            opens = lambda t, i=i: float(language_model.opens(c[i] - 1, t, others[i], p[i], d))
            closes = leaves * (1 - opens(t - 1))
            changes = closes + (1 - leaves) * opens(t)
            stays, which = (float(x[0]) for x in language_model.uniforms(key[i : i + 1], k))
            left, k = left - 1 - int(math.log(stays) / math.log1p(-changes)), k + 1
            if left >= 0:
                t += -1 if which * changes < closes else 1
        assert got[i] == t and 1 <= t <= c[i]


def test_sweeps_of_parts_move_every_customer(spark):
    """A part's dishes and the root's words go through whole sweeps."""
    root = language_model.Root.__new__(language_model.Root)
    root.customers, root.tables, root.base, root.theta, root.discount = 9000, 600, 1e-3, 1.0, 0.6
    context, words, c = np.array([7], np.int64), np.array([5, 11], np.int64), np.array([5000, 900])
    t, packed = np.array([400, 10]), language_model.packed
    order, _ = language_model.by_part(words, 1)
    words = words[order]
    rows = [
        {"kind": "dishes", "part": 0, "a": context.tobytes(), "b": packed(np.array([2])), "c": packed(np.array([3])), "d": words.tobytes(), "e": np.arange(2, dtype=np.int32).tobytes(), "f": packed(c), "g": packed(t), "h": packed(np.zeros(2, np.int64))},
        {"kind": "seen", "part": 0, "source": 0, "a": packed(np.array([800, 90])), "b": packed(np.array([9, 4])), "x": 2},
    ]
    dishes, seen = (spark.createDataFrame(language_model.frame([r]), language_model.ROW) for r in rows)
    found = {r["kind"]: r for r in language_model.dish_sweep(dishes, seen, {}, root, 0.7, 1.0, 1, 3, True).collect()}
    alone, p = language_model.Alone(0.7), root.probability(np.array([800, 90]), np.array([9, 4]))
    given = c, t, 1.0 + 0.7 * (3 + t.sum() - t), p, alone, language_model.seat_key(3, np.array([7, 7]), words)
    want = language_model.swept(*given)
    assert (language_model.unpacked(found["dishes"]["g"], 2) == want).all() and (want != language_model.moved(*given)).all()

    need = np.arange(2, dtype=np.int32).tobytes()
    lexicon = {"kind": "lexicon", "part": 0, "a": words.tobytes(), "c": packed(c), "d": need, "e": packed(np.zeros(2, np.int64)), "h": np.array([[0], [2]], np.int64).tobytes()}
    last = {"kind": "root", "part": 0, "b": packed(t)}
    lexicon, last = (spark.createDataFrame(language_model.frame([r]), language_model.ROW) for r in (lexicon, last))
    found = {r["kind"]: r for r in language_model.root_sweep(lexicon, None, last, root, 1, 2).collect()}
    given = c, t, 1.0 + 0.6 * (600 - t), np.full(2, 1e-3), language_model.Alone(0.6), language_model.seat_key(2, words)
    want = language_model.swept(*given)
    assert (language_model.unpacked(found["root"]["b"], 2) == want).all() and (want != language_model.moved(*given)).any()


def test_scores_with_large_dishes_hang_on_no_part(spark):
    """Texts whose pairs have far more customers than are moved one by one get the same scores in any number of parts and files."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in rng.exponential(1.5, 40)) for _ in range(400)]
    assert max(collections.Counter(p for t in texts for p in itertools.pairwise(t.split())).values()) > 1000
    total, found = sum(map(len, texts)), []
    for deal, size, parts in ((1, 8 << 20, 1), (9, 700, 7)):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(deal)
        found.append({r["doc_id"]: r["score"] for r in language_model.score_texts(frame, slice_characters=size, part_tokens=total // (6 * parts)).collect()})
    assert found[0].keys() == found[1].keys() and all(math.isclose(x, found[1][k], rel_tol=1e-12) for k, x in found[0].items())
