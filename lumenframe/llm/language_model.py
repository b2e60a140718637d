"""LM scoring by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs over all training documents.

The model predicts a token from the one before it. Every previous token has a restaurant of its own; all of them share
one parent, the root, whose base is uniform over the known words and one unseen word. What is seated is kept as customers
and tables per dish (a word in a restaurant) in parts that Spark deals by hash and that send each other what they need, so nothing of
the model is bounded or held by one task. A dish with one customer has one table in any seating and is never moved.

Words are told apart by 64-bit hashes. Draws are hashes of sweep, restaurant, word and move, and what they hang on are sums of
whole numbers, so seating is the same however rows are dealt or batched, and equal texts get equal scores.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, cut, discard, documents, runs
from lumenframe.llm.fingerprint import mixed, step

#: The end token, and the context at a document's start. Words hold no white space, so neither is a word.
END, START = b"\n", b"\t"
END_HASH, START_HASH = (int(np.array(xxhash.xxh3_64_intdigest(w), np.uint64).astype(np.int64)) for w in (END, START))
SMOOTH = 0.1
#: A sweep moves so many customers of a dish one by one, and all others of larger dishes with skips over moves that change nothing.
MOVES = 64
#: Up to this many customers, chances of being alone at a table are tabled exactly.
EXACT = 256
#: Contexts that stand in excerpts of all texts more than once in 6 * WIDE bytes are dealt by the next word too: at most 3 * WIDE of them.
WIDE = 512
#: An excerpt has so many characters, and one more for every SHARE characters of its text.
EXCERPT, SHARE = 64, 128


# ---- one dish --------------------------------------------------------------------------------------------------
def uniforms(key: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of 32 bits that hang on nothing but a row's key and the number of its draw."""
    x = mixed(key + step(draw + 2000))
    return ((x >> np.uint64(32)).astype(float) + 0.5) / float(1 << 32), ((x & np.uint64(0xFFFFFFFF)).astype(float) + 0.5) / float(1 << 32)


def seat_key(sweep: int, *ids: np.ndarray) -> np.ndarray:
    """The key of a dish in a restaurant, in one sweep."""
    key = np.full(len(ids[0]), step(1000 + sweep))
    for x in ids:
        key = mixed(key ^ np.ascontiguousarray(x).astype(np.int64).view(np.uint64)) + step(23)
    return key


def discount_of(once: float, twice: float) -> float:
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95))


class Alone:
    """The chance that one customer of a dish sits alone, given customers c and tables t: S(c - 1, t - 1) / S(c, t).

    S are the generalized Stirling numbers of the discount d, S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t), which
    weigh the seatings of c customers at t tables. They are tabled for c up to EXACT. Beyond, the ratio is taken at the saddle point
    of z^-c (1 - (1 - z)^d)^t, which agrees with the exact one within 1.3 % for d from 0.6 on, and 9 % for any.
    """

    def __init__(self, discount: float) -> None:
        self.d = discount
        log = np.full((EXACT + 1, EXACT + 1), -np.inf)
        log[1, 1] = 0.0
        for c in range(2, EXACT + 1):
            t = np.arange(1, c + 1)
            joined = np.where(t < c, np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf) + log[c - 1, 1 : c + 1]
            log[c, 1 : c + 1] = np.logaddexp(log[c - 1, :c], joined)
        self.table = np.zeros_like(log)
        for c in range(1, EXACT + 1):
            self.table[c, 1 : c + 1] = np.exp(log[c - 1, :c] - log[c, 1 : c + 1]) if c > 1 else 1.0

    def at_saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d, low, high = self.d, np.full(len(c), -400.0), np.zeros(len(c))
        for _ in range(60):
            m = (low + high) / 2
            large = -np.expm1(m) * d * np.exp((d - 1) * m) * t > -np.expm1(d * m) * c
            low, high = np.where(large, m, low), np.where(large, high, m)
        return np.where(t >= c, 1.0, np.minimum(d * (t - 1) / (c - 1) * -np.expm1(m) / -np.expm1(d * m), 1.0))

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        few = c <= EXACT
        found = self.table[np.minimum(c, EXACT), np.minimum(t, EXACT)]
        if not few.all():
            found[~few] = self.at_saddle(c[~few].astype(float), t[~few].astype(float))
        return found


@functools.lru_cache(maxsize=2)
def chances_alone(discount: float) -> Alone:
    """Tasks of one worker share them."""
    return Alone(discount)


class Visited:
    """What Alone gives, worked out once for each number of tables that a dish beyond its table comes to.

    A dish has c customers all along. What is kept of it are the states up to MOVES tables from where it began, or from where it last left those behind.
    """

    def __init__(self, c: np.ndarray, t: np.ndarray, alone: Alone) -> None:
        large = c > EXACT
        self.alone, self.c, self.low = alone, c[large].astype(float), t[large] - MOVES
        self.row = np.cumsum(large) - 1
        self.found = np.full((len(self.c), 2 * MOVES + 1), np.nan)

    def __call__(self, dish: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """dish: places among the dishes that this began with; c, t: their customers and tables."""
        out = self.alone.table[np.minimum(c, EXACT), np.minimum(t, EXACT)]
        if len(self.c):
            large = np.flatnonzero(c > EXACT)
            row, tables = self.row[dish[large]], t[large]
            at = tables - self.low[row]
            away = np.flatnonzero((at < 0) | (at > 2 * MOVES))
            if len(away):
                self.found[row[away]], self.low[row[away]], at[away] = np.nan, tables[away] - MOVES, MOVES
            out[large] = self.found[row, at]
            new = np.flatnonzero(np.isnan(out[large]))
            if len(new):
                found = self.alone.at_saddle(self.c[row[new]], tables[new].astype(float))
                self.found[row[new], at[new]] = out[large[new]] = found
        return out


def opens(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
    """The chance that a customer who comes to a dish with c others at t tables opens a new one.

    others: concentration + d * tables of the restaurant's other dishes; p: the dish's probability in the parent.
    """
    new = (others + d * t) * p
    return new / (new + c - d * t)


def first_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, alone: Alone) -> np.ndarray:
    """Where sweeps begin: the number of tables at which a move is as likely to close one as to open one."""
    low, high = np.ones(len(c), np.int64), np.maximum(c, 1).astype(np.int64)
    while (low < high).any():
        t = (low + high + 1) // 2
        more = opens(c - 1, t - 1, others, p, alone.d) >= alone(c, t)
        low, high = np.where(more, t, low), np.where(more, high, t - 1)
        high = np.maximum(low, high)
    return low


def swept(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, alone: Alone, key: np.ndarray) -> np.ndarray:
    """One Gibbs sweep: each of a dish's customers leaves, and sits down given all others.

    The restaurant's other dishes and the parent stand as the last sweep left them, as usual where sampling is distributed. A sweep makes as many moves as
    the dish has customers; which of them a move takes makes no difference to where sweeps lead.
    """
    return moved_on(c, moved(c, t, others, p, alone, key), others, p, alone, key)


def moved(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, alone: Alone, key: np.ndarray) -> np.ndarray:
    """The first MOVES moves of a sweep, one by one: all of them in dishes with up to MOVES customers."""
    out = t.astype(np.int64)
    rows = np.flatnonzero(c > 1)
    c, t, others, p, key = c[rows], out[rows], others[rows], p[rows], key[rows]
    most = int(c.max(initial=0))
    chances, dish = Visited(c, t, alone), np.arange(len(c))
    for k in range(MOVES):
        if 1 < k <= most and (c == k).any():
            out[rows] = t
            going = c > k
            rows, dish, c, t, others, p, key = (x[going] for x in (rows, dish, c, t, others, p, key))
        if not len(rows):
            break
        leaves, sits = uniforms(key, k)
        t = t - (leaves < chances(dish, c, t))
        t = t + (sits < opens(c - 1, t, others, p, alone.d))
    out[rows] = t
    return out


def moved_on(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, alone: Alone, key: np.ndarray) -> np.ndarray:
    """All moves of a sweep after the first MOVES: c - MOVES of them in each larger dish.

    While a dish's tables stay as many, each move closes one or opens one by the same chance, so how many moves change nothing before one does is a
    geometric number, drawn at once. What a dish comes to is distributed as if its customers moved one by one, in as many steps as tables change.
    """
    out = t.astype(np.int64)
    rows = np.flatnonzero(c > MOVES)
    c, t, others, p, key = c[rows], out[rows], others[rows], p[rows], key[rows]
    chances, dish, left, k = Visited(c, t, alone), np.arange(len(c)), c - MOVES, MOVES
    while len(rows):
        leaves = chances(dish, c, t)
        closes = leaves * (1 - opens(c - 1, t - 1, others, p, alone.d))
        changes = closes + (1 - leaves) * opens(c - 1, t, others, p, alone.d)
        stays, which = uniforms(key, k)
        with np.errstate(divide="ignore"):  # nothing can change, or every move does
            left = left - 1 - np.minimum(np.log(stays) / np.log1p(-changes), left).astype(np.int64)
        going = left >= 0
        t = np.where(going, t + np.where(which * changes < closes, -1, 1), t)
        k += 1
        if not left.all() or not going.all():
            out[rows] = t
            going = left > 0
            rows, dish, c, t, others, p, key, left = (x[going] for x in (rows, dish, c, t, others, p, key, left))
    return out


# ---- slices of documents ---------------------------------------------------------------------------------------
def is_held_out(doc_id, folds: int = 10) -> bool:  # noqa: ANN001
    """Whether a doc_id is never learned from; a null id is not learned from either."""
    return pd.isna(doc_id) or zlib.crc32(str(int(doc_id)).encode()) % folds == 0


class Slice:
    """Documents that are worked on together: words are the sorted hashes of their distinct tokens, flat their places there, document
    after document, ends where each ends."""

    def __init__(self, name: int, ids: list, texts: list, folds: int) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.string())))
        coded = split.flatten().dictionary_encode()
        found = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        hashes = np.empty(len(found) + 2, np.uint64)
        hashes[:-2] = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        hashes[-2:] = START_HASH % (1 << 64), END_HASH % (1 << 64)
        self.words, place = np.unique(hashes.view(np.int64), return_inverse=True)
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = np.diff(np.asarray(split.offsets))
        del split, coded
        place = place.astype(np.int32)
        blank = np.flatnonzero(found == b"")  # white space at a text's ends leaves empty strings
        if len(blank):
            filled = code != blank[0]
            n = np.bincount(np.repeat(np.arange(len(texts)), n)[filled], minlength=len(texts))
            code = code[filled]
        self.ends = np.cumsum(n + 2)
        self.flat = np.full(int(self.ends[-1]), place[-1])
        self.flat[self.ends - n - 2] = place[-2]
        inner = np.ones(len(self.flat), bool)
        inner[self.ends - 1] = inner[self.ends - n - 2] = False
        self.flat[inner] = place[code]
        self.name, self.ids = name, ids
        self.learned = np.array([not is_held_out(d, folds) for d in ids])
        used = np.bincount(self.flat, minlength=len(self.words)) > 0
        if not used.all():  # the hash of the empty string
            self.words, self.flat = self.words[used], (np.cumsum(used, dtype=np.int32) - 1)[self.flat]

    @classmethod
    def told(cls, words: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Slice:
        """One whose words and places are known, with the number of tokens of each document; it learns from none."""
        s = cls.__new__(cls)
        s.words, s.flat, s.ends, s.learned = words, flat, np.cumsum(sizes), np.zeros(len(sizes), bool)
        return s

    def counts(self) -> np.ndarray:
        """How often each word is a token of a training document; for the start mark, how many of them there are."""
        return np.bincount(self.flat[np.repeat(self.learned, np.diff(self.ends, prepend=0))], minlength=len(self.words))

    def pairs(self, parts: int, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of neighbours in the order of part, context and word: part, context, word (places), training count,
        and the place of each pair of the texts among them, document after document."""
        inner = np.ones(len(self.flat), bool)
        inner[self.ends - 1] = False
        inner = inner[:-1]
        kept = self.flat[:-1][inner].astype(np.int64)
        bits, below = int(len(self.words)).bit_length(), int(len(kept)).bit_length()
        kept <<= bits
        kept |= self.flat[1:][inner]
        if 2 * bits + below < 64:  # sorting numbers that carry their places is a fifth of an argsort
            kept <<= below
            kept |= np.arange(len(kept), dtype=np.int32)
            kept.sort()
            order = (kept & ((1 << below) - 1)).astype(np.int32)
            kept >>= below
        else:
            order = np.argsort(kept)
            kept = kept[order]
        new = np.ones(len(kept), bool)
        new[1:] = kept[1:] != kept[:-1]
        found, at = kept[new], np.empty(len(kept), np.int32)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        del kept, order
        n = np.bincount(at[np.repeat(self.learned, np.diff(self.ends, prepend=0) - 1)], minlength=len(found))
        ctx, word = (found >> bits).astype(np.int32), (found & ((1 << bits) - 1)).astype(np.int32)
        del found
        keys = self.words.view(np.uint64)
        part = part_of(self.words, parts)[ctx]
        spread = np.flatnonzero(np.isin(self.words, wide)[ctx])
        part[spread] = (mixed(keys[ctx[spread]] + mixed(keys[word[spread]])) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        return part[order], ctx[order], word[order], n[order], back[at]


def slices(batches: Iterable, folds: int, characters: int) -> Iterator[Slice]:
    """Slices of about so many characters of each chunk, in the order of its file: the same whenever it is read."""
    chunk, number, ids, texts, size = None, 0, [], [], 0
    name = lambda: int(mixed(np.array([chunk], np.int64).view(np.uint64) + step(number + 31)).view(np.int64)[0])
    for batch in batches:
        for doc, text, c in zip(batch["doc_id"], batch["text"], batch["chunk"], strict=True):
            if ids and (c != chunk or size > characters):
                yield Slice(name(), ids, texts, folds)
                number, ids, texts, size = number + 1, [], [], 0
            if c != chunk:
                chunk, number = c, 0
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
    if ids:
        yield Slice(name(), ids, texts, folds)


def with_chunk(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id as text, text, and the file split of each document; rows that don't come straight from files are written first."""
    plain = lambda df: df.select(F.col("doc_id").cast("string"), "text", F.xxhash64(F.input_file_name(), F.expr("input_file_block_start()")).alias("chunk"), F.input_file_name().alias("file"))
    probe = plain(docs).limit(1).collect()
    if not probe or probe[0]["file"]:  # a shuffle in between hides the file
        return plain(docs).drop("file"), None
    written = cut(docs.select("doc_id", "text"), "texts")
    return plain(written).drop("file"), written


# ---- packing ---------------------------------------------------------------------------------------------------
# What is sent between tasks goes in blocks, one row from a sender to a receiver: words and contexts as 8-byte hashes in an order that
# both know, and numbers beside them. There are never more rows than there would be without blocks.
def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0: a byte each, 255 standing for the larger ones, which follow as 8 bytes each."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def squeezed(places: np.ndarray) -> bytes:
    """Places below 2^24, their bytes apart from each other and compressed."""
    return pa.Codec("zstd").compress(places.view(np.uint8).reshape(-1, 4).T[:3].tobytes(), asbytes=True)


def spread(raw: bytes, n: int) -> np.ndarray:
    low, middle, high = np.frombuffer(pa.Codec("zstd").decompress(raw, 3 * n, asbytes=True), np.uint8).reshape(3, n).astype(np.int64)
    return low | middle << 8 | high << 16


def hashes_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def places_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part that keeps a word, or a context that isn't wide."""
    return (mixed(np.ascontiguousarray(hashes).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of hashes by part and hash, and (part, from, to) of each block."""
    part = part_of(hashes, parts)
    order = np.lexsort((hashes, part))
    return order, blocks(part[order])


def blocks(part: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(part):
        return []
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(part)], strict=True))


#: A row of any kind: what it is, the part it goes to, who sent it (a part or slice), and what it says.
ROW = f"kind string, part int, source long, {', '.join(f'{c} binary' for c in 'abcdefghi')}, x long, y long, z long, w long"
FIELDS = [c.split()[0] for c in ROW.split(", ")]


def frame(rows: list[dict]) -> pd.DataFrame:
    empty = dict.fromkeys("abcdefghi", b"") | dict.fromkeys("xyzw", 0) | {"source": -1}
    return pd.DataFrame([empty | r for r in rows], columns=FIELDS).astype({"part": "int32", **dict.fromkeys(["source", *"xyzw"], "int64")})


def senders(rows: pd.DataFrame | None, column: str = "a") -> bytes:
    """Who sent blocks of hashes, and how many in each."""
    return b"" if rows is None else np.array([rows["source"], rows[column].map(len) // 8], np.int64).tobytes()


def gathered(rows: DataFrame, key: str, work: Callable[[dict[str, pd.DataFrame], int], Iterable], parts: int | None = None, schema: str = ROW) -> DataFrame:
    """work(rows of each kind in order, key) for each slice (a source), or for each part, in a task of its own; it yields rows, or frames of the given schema."""
    other = "part" if key == "source" else "source"

    def each(batches: Iterable) -> Iterator:
        for own in runs(batches, key):
            kinds = {k: v for k, v in own.groupby("kind")}
            out = work(kinds, int(own[key].iloc[0]))
            yield from ([frame(rows)] if (rows := list(out)) else []) if schema == ROW else out

    dealt = rows.repartition(key) if parts is None else rows.repartitionById(parts, key)
    return dealt.sortWithinPartitions(key, "kind", other).mapInPandas(each, schema)


def of_kind(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.where(F.col("kind").isin(list(kinds))).select(*FIELDS)


# ---- counting --------------------------------------------------------------------------------------------------
def wide_contexts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The bytes of all texts, and the contexts that are dealt by the next word too, the start mark among them.

    They are told from an excerpt of every text, at a place that its hash draws. Scores don't hang on them, only how evenly pairs are dealt.
    """
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).first()
    length = F.length("text")
    size = F.least(length, (length / SHARE).cast("int") + EXCERPT)
    words = ascii_lower(F.substring("text", (F.pmod(F.xxhash64("text"), length - size + 1) + 1).cast("int"), size))
    counted = docs.select(F.explode(F.split(words, r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("word").count()
    most = max(min(total, total // SHARE + EXCERPT * rows) // (6 * WIDE), 1)
    found = [xxhash.xxh3_64_intdigest(r["word"].encode()) for r in counted.where(F.col("count") > most).collect()]
    return total, np.sort(np.array([*found, START_HASH % (1 << 64)], np.uint64).view(np.int64))


def asked(docs: DataFrame, folds: int, characters: int, parts: int, wide: np.ndarray) -> DataFrame:
    """Of each slice (source) and part, kind 'word': its distinct tokens (a) and how often its training documents hold them (b). Kind 'pair': its
    distinct pairs of neighbours: contexts (a), how many words follow each (b), the words (c) and training counts (d)."""

    def each(batches: Iterable) -> Iterator:
        for s in slices(batches, folds, characters):
            order, found = by_part(s.words, parts)
            words, n = s.words[order], s.counts()[order]
            rows = [{"kind": "word", "part": p, "source": s.name, "a": words[i:j].tobytes(), "b": packed(n[i:j])} for p, i, j in found]
            part, ctx, word, n, at = s.pairs(parts, wide)
            del at
            for p, i, j in blocks(part):
                first = np.flatnonzero(np.diff(ctx[i:j], prepend=-1))
                rows.append({"kind": "pair", "part": p, "source": s.name, "a": s.words[ctx[i:j][first]].tobytes(), "b": packed(np.diff(first, append=j - i)), "c": s.words[word[i:j]].tobytes(), "d": packed(n[i:j])})
            yield frame(rows)

    return docs.mapInPandas(each, ROW)


def counted_words(rows: pd.DataFrame, part: int) -> Iterator[dict]:
    """kind 'words': a part's words (a) and training counts (b), their sum x and number y without the start mark; kind 'places': the places of
    a slice's words among them (a)."""
    words = [hashes_of(w) for w in rows["a"]]
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    n = np.concatenate([unpacked(b, len(w)) for b, w in zip(rows["b"], words, strict=True)])
    c = np.bincount(at, n, len(found)).astype(np.int64)
    token = found != START_HASH
    yield {"kind": "words", "part": part, "a": found.tobytes(), "b": packed(c), "x": int(c[token].sum()), "y": int((c[token] > 0).sum())}
    for source, places in zip(rows["source"], np.split(at, np.cumsum([len(w) for w in words])[:-1]), strict=True):
        yield {"kind": "places", "part": part, "source": source, "a": places.astype(np.int32).tobytes()}


def counted_pairs(rows: pd.DataFrame, part: int, parts: int, wide: np.ndarray) -> Iterator[dict]:
    """Add the slices' counts of every pair up. A dish is a pair with customers. Of each part:

    kind 'dishes': those with more than one customer: contexts (a), how many such dishes each has (b) and how many with one customer (c),
    the dishes' words (d, in the order of their parts), the place of each dish's word there (e), customers (f); x and y count
    dishes with one and with two customers. kind 'slice': for each pair that the slice asked for, 0, 1 or 2 as nobody, one or more
    customers have it (a), and the places of the latter among the dishes, as differences (b). To the parts of words: kind 'once' (a: words,
    b: how many dishes with one customer), 'ones' (the same for contexts), 'need' (a: words of the dishes, b: how many), 'from' (a: contexts).
    Wide contexts (x) tell their dishes with one customer (y) and with more (z) as kind 'wide'.
    """
    sizes = np.fromiter((len(w) // 8 for w in rows["c"]), np.int64, len(rows))
    word = hashes_of(b"".join(rows["c"]))
    heads = [hashes_of(c) for c in rows["a"]]
    follow = np.concatenate([unpacked(m, len(h)) for h, m in zip(heads, rows["b"], strict=True)])
    known, number = np.unique(np.concatenate(heads), return_inverse=True)
    rank = np.repeat(number, follow)
    n = np.concatenate([unpacked(raw, k) for raw, k in zip(rows["d"], sizes.tolist(), strict=True)])
    order = np.argsort(word)
    below = int(len(order)).bit_length()
    ranked = np.sort(rank[order] << below | np.arange(len(order)))
    order, c = order[ranked & ((1 << below) - 1)], known[ranked >> below]
    w = word[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    c, w = c[new], w[new]
    more, once = total > 1, total == 1
    contexts, first = np.unique(c[more], return_index=True)
    followers = np.diff(first, append=int(more.sum()))
    single, ones = np.unique(c[once], return_counts=True)
    own_ones = np.zeros(len(contexts), np.int64)
    if len(single):
        at = np.minimum(np.searchsorted(single, contexts), len(single) - 1)
        own_ones = np.where(single[at] == contexts, ones[at], 0)
    words, at = np.unique(w[more], return_inverse=True)
    deal, sent = by_part(words, parts)
    place = np.empty(len(deal), np.int64)
    place[deal] = np.arange(len(deal))
    words, at = words[deal], place[at]
    yield {"kind": "dishes", "part": part, "a": contexts.tobytes(), "b": packed(followers), "c": packed(own_ones), "d": words.tobytes(), "e": at.astype(np.int32).tobytes(), "f": packed(total[more]), "x": int(once.sum()), "y": int((total == 2).sum())}
    for x in wide[np.isin(wide, c)].tolist():
        yield {"kind": "wide", "part": part, "source": part, "x": x, "y": int((once & (c == x)).sum()), "z": int((more & (c == x)).sum())}
    many = np.bincount(at, minlength=len(words))
    for p, i, j in sent:
        yield {"kind": "need", "part": p, "source": part, "a": words[i:j].tobytes(), "b": packed(many[i:j])}
    deal, sent = by_part(contexts, parts)
    for p, i, j in sent:
        yield {"kind": "from", "part": p, "source": part, "a": contexts[deal[i:j]].tobytes()}
    for kind, values in (("once", w[once]), ("ones", c[once])):
        values, n = np.unique(values, return_counts=True)
        deal, sent = by_part(values, parts)
        for p, i, j in sent:
            yield {"kind": kind, "part": p, "source": part, "a": values[deal[i:j]].tobytes(), "b": packed(n[deal[i:j]])}
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    codes, pos = np.minimum(total, 2).astype(np.uint8), np.cumsum(more) - 1
    for source, x in zip(rows["source"], np.split(of, np.cumsum(sizes)[:-1]), strict=True):
        yield {"kind": "slice", "part": part, "source": source, "a": codes[x].tobytes(), "b": np.diff(pos[x[more[x]]], prepend=0).astype(np.int32).tobytes()}


def counted(rows: DataFrame, parts: int, wide: np.ndarray) -> DataFrame:
    """What counted_words and counted_pairs give of each part."""

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        if "word" in kinds:
            yield from counted_words(kinds["word"], part)
        if "pair" in kinds:
            yield from counted_pairs(kinds["pair"], part, parts, wide)

    return gathered(rows, "part", work, parts)


#: The kinds that lexicons need and nothing after them.
LISTED = ("words", "once", "ones", "need", "from")


def lexicons(found: DataFrame, parts: int) -> DataFrame:
    """kind 'lexicon' of each part of words: words (a), training counts (b), dishes with one customer (c), the places of the words that each part's
    dishes need, part after part (d), and how many dishes those are (e), the places of its contexts likewise (f), dishes with one
    customer by context (g), and the parts that d and f come from, with how many each has (h, i). x, y, z: the root's customers, and its words with one and two of them, with a table for each dish; w: its words."""

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        own = kinds["words"].iloc[0]
        words = hashes_of(own["a"])

        def places(kind: str) -> np.ndarray:
            found = hashes_of(b"".join(kinds[kind]["a"])) if kind in kinds else np.zeros(0, np.int64)
            return np.searchsorted(words, found)

        def numbers(kind: str) -> np.ndarray:
            return np.concatenate([unpacked(b, len(a) // 8) for a, b in zip(kinds[kind]["a"], kinds[kind]["b"], strict=True)]) if kind in kinds else np.zeros(0, np.int64)

        once, ones = (np.bincount(places(k), numbers(k), len(words)).astype(np.int64) for k in ("once", "ones"))
        need, many = places("need"), numbers("need")
        c = once + np.bincount(need, many, len(words)).astype(np.int64)
        yield {
            "kind": "lexicon", "part": part, "a": own["a"], "b": own["b"], "c": packed(once), "d": need.astype(np.int32).tobytes(), "e": packed(many), "f": places("from").astype(np.int32).tobytes(), "g": packed(ones),
            "h": senders(kinds.get("need")), "i": senders(kinds.get("from")),
            "x": int(c.sum()), "y": int((c == 1).sum()), "z": int((c == 2).sum()), "w": int((c > 0).sum()),
        }

    return gathered(of_kind(found, *LISTED), "part", work, parts)


# ---- sampling --------------------------------------------------------------------------------------------------
class Root:
    """The root restaurant's totals: sums over its dishes."""

    def __init__(self, rows: DataFrame, base: float, theta: float) -> None:
        """rows: customers x, words with one y and two z of them, tables w."""
        customers, once, twice, tables = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "xyzw")).first()
        self.customers, self.tables, self.base, self.theta, self.discount = customers, tables, base, theta, discount_of(once, twice)

    def unseen(self) -> float:
        """The probability of the one unseen word."""
        return (self.theta + self.discount * self.tables) / (self.theta + self.customers) * self.base

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables) / (self.theta + self.customers) + self.unseen()


def root_sweep(lexicon: DataFrame, news: DataFrame | None, last: DataFrame | None, before: Root, parts: int, sweep: int) -> DataFrame:
    """kind 'root' of each part: its words' customers (a), the tables of all contexts, and tables (b), with totals; kind 'seen', to the
    parts of contexts: customers (a) and tables (b) of the words that they need."""
    rows = lexicon
    for more in (news, last):
        rows = rows if more is None else rows.union(more)

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        own = kinds["lexicon"].iloc[0]
        words, need = hashes_of(own["a"]), places_of(own["d"])
        if "tables" in kinds:
            sent = kinds["tables"]
            new = np.concatenate([unpacked(a, x) for a, x in zip(sent["a"], sent["x"], strict=True)])
        else:
            new = unpacked(own["e"], len(need))
        c = unpacked(own["c"], len(words)) + np.bincount(need, new, len(words)).astype(np.int64)
        alone, p = chances_alone(before.discount), np.full(len(words), before.base)
        if sweep:
            t = np.clip(unpacked(kinds["root"]["b"].iloc[0], len(words)), np.minimum(c, 1), c)
            t = swept(c, t, before.theta + before.discount * (before.tables - t), p, alone, seat_key(sweep, words))
        else:
            t = np.minimum(first_tables(c, np.full(len(words), before.theta + before.discount * before.tables), p, alone), c)
        yield {"kind": "root", "part": part, "a": packed(c), "b": packed(t), "x": int(c.sum()), "y": int((c == 1).sum()), "z": int((c == 2).sum()), "w": int(t.sum())}
        i = 0
        for source, size in hashes_of(own["h"]).reshape(2, -1).T.tolist():
            at = need[i : i + size]
            i += size
            yield {"kind": "seen", "part": source, "source": part, "a": packed(c[at]), "b": packed(t[at]), "x": size}

    return gathered(rows, "part", work, parts)


def dish_sweep(dishes: DataFrame, seen: DataFrame, wide: dict[int, int], root: Root, discount: float, theta: float, parts: int, sweep: int, keep: bool) -> DataFrame:
    """kind 'dishes' again, with tables (g) and their sum over samples (h); to the parts of words, kind 'tables': those opened for their
    words (a), and where a sample is kept 'contexts': those of their contexts (a). Of wide contexts (x) the tables (y) as kind 'wide'.

    wide: the tables of all parts in each wide context, after the last sweep.
    """

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        own = kinds["dishes"].iloc[0].to_dict()
        contexts, words, at = hashes_of(own["a"]), hashes_of(own["d"]), places_of(own["e"])
        followers, ones, n = unpacked(own["b"], len(contexts)), unpacked(own["c"], len(contexts)), unpacked(own["f"], len(at))
        of = np.repeat(np.arange(len(contexts)), followers)
        t, kept = (unpacked(own["g"], len(at)), unpacked(own["h"], len(at))) if sweep else (np.ones(len(at), np.int64), np.zeros(len(at), np.int64))
        if len(at):
            sent = kinds["seen"]
            customers, tables = (np.concatenate([unpacked(v, k) for v, k in zip(sent[name], sent["x"], strict=True)]) for name in "ab")
            p = root.probability(customers, tables)[at]
            total = ones + np.bincount(of, t, len(contexts)).astype(np.int64)
            for k in np.flatnonzero(np.isin(contexts, list(wide))).tolist():
                total[k] = wide[int(contexts[k])]
            others = theta + discount * (total[of] - t)
            alone = chances_alone(discount)
            t = swept(n, t, others, p, alone, seat_key(sweep, contexts[of], words[at])) if sweep else first_tables(n, others, p, alone)
        yield own | {"kind": "dishes", "part": part, "g": packed(t), "h": packed(kept + t if keep else kept)}
        by_word, by_context = (np.bincount(i, t, len(x)).astype(np.int64) for i, x in ((at, words), (of, contexts)))
        for p, i, j in blocks(part_of(words, parts)):
            yield {"kind": "tables", "part": p, "source": part, "a": packed(by_word[i:j]), "x": j - i}
        if keep:
            deal, sent = by_part(contexts, parts)
            for p, i, j in sent:
                yield {"kind": "contexts", "part": p, "source": part, "a": packed(by_context[deal[i:j]]), "x": j - i}
        for k in np.flatnonzero(np.isin(contexts, list(wide))).tolist():
            yield {"kind": "wide", "part": part, "source": part, "x": int(contexts[k]), "y": int(by_context[k])}

    return gathered(dishes.union(seen), "part", work, parts)


def wide_sums(rows: DataFrame, *columns: str) -> dict[int, list[int]]:
    """Sums by wide context: at most WIDE rows."""
    return {r["x"]: [r[c] for c in columns] for r in of_kind(rows, "wide").groupBy("x").agg(*(F.sum(c).alias(c) for c in columns)).collect()}


def sampled(found: DataFrame, lexicon: DataFrame, base: float, parts: int, burn_in: int, samples: int, theta: float) -> tuple[DataFrame, float, list[tuple[DataFrame, Root, DataFrame]]]:
    """Dishes with their tables summed over the samples, the discount, and of each sample the root's rows and totals and the contexts' tables."""
    discount = discount_of(*of_kind(found, "dishes").agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())
    static = wide_sums(found, "y", "z")
    wide, totals = {k: y + z for k, (y, z) in static.items()}, Root(lexicon, base, theta)
    dishes, news, last, old, kept = of_kind(found, "dishes"), None, None, [], []
    # Sweep 0 sets the start, from one table per dish.
    for sweep in range(burn_in + samples + 1):
        keep = sweep > burn_in
        rooted = cut(root_sweep(lexicon, news, last, totals, parts, sweep), "root", by="kind")
        last = of_kind(rooted, "root")
        totals = Root(last, base, theta)
        seated = cut(dish_sweep(dishes, of_kind(rooted, "seen"), wide, totals, discount, theta, parts, sweep, keep), "seats", by="kind")
        opened = wide_sums(seated, "y")
        wide = {k: y + opened.get(k, [0])[0] for k, (y, _) in static.items()}
        for df, folders in old:
            discard(df, folders=folders)
        discard(rooted, folders=("kind=seen",))
        dishes, news, old = of_kind(seated, "dishes"), of_kind(seated, "tables"), [(seated, ("kind=dishes", "kind=tables"))] if keep else [(rooted, ("",)), (seated, ("",))]
        if keep:
            kept.append((last, totals, of_kind(seated, "contexts")))
    return dishes, discount, kept


# ---- scoring ---------------------------------------------------------------------------------------------------
def word_facts(lexicon: DataFrame, found: DataFrame, kept: list[tuple[DataFrame, Root, DataFrame]], parts: int) -> DataFrame:
    """kind 'facts', source slice: a slice's words of a part (a), their training counts (b) and, sample after sample, the tables of
    their restaurants (c) and their customers and tables at the root (d, e)."""
    rows = lexicon.union(of_kind(found, "places"))
    for k, (last, _, contexts) in enumerate(kept):
        named = lambda df, name: df.select(F.lit(name).alias("kind"), *FIELDS[1:])
        rows = rows.union(named(last, f"root{k}")).union(named(contexts, f"contexts{k}"))
    samples = len(kept)

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        own = kinds["lexicon"].iloc[0]
        words = hashes_of(own["a"])
        count, ones, at = unpacked(own["b"], len(words)), unpacked(own["g"], len(words)), places_of(own["f"])
        tables, customers, root_tables = [], [], []
        for k in range(samples):
            root, sent = kinds[f"root{k}"].iloc[0], kinds.get(f"contexts{k}")
            new = np.concatenate([unpacked(a, x) for a, x in zip(sent["a"], sent["x"], strict=True)]) if sent is not None else np.zeros(0, np.int64)
            tables.append(ones + np.bincount(at, new, len(words)).astype(np.int64))
            customers.append(unpacked(root["a"], len(words)))
            root_tables.append(unpacked(root["b"], len(words)))
        for source, places in zip(kinds["places"]["source"], kinds["places"]["a"], strict=True):
            i = places_of(places)
            told = {name: packed(np.concatenate([x[i] for x in values])) for name, values in (("c", tables), ("d", customers), ("e", root_tables))}
            yield {"kind": "facts", "part": part, "source": source, "a": words[i].tobytes(), "b": packed(count[i]), **told}

    return gathered(rows, "part", work, parts)


def own_masses(found: DataFrame, dishes: DataFrame, parts: int) -> DataFrame:
    """kind 'mass', source slice: what each pair that a slice asked for has of its own: 0, 1 or 2 as before (a), and of the
    latter (x) the customers (b) and the sum of tables over the samples (c)."""

    def work(kinds: dict[str, pd.DataFrame], part: int) -> Iterator[dict]:
        own = kinds["dishes"].iloc[0]
        n = len(own["e"]) // 4
        customers, tables = unpacked(own["f"], n), unpacked(own["h"], n)
        for source, codes, places in zip(kinds["slice"]["source"], kinds["slice"]["a"], kinds["slice"]["b"], strict=True):
            at = np.cumsum(places_of(places))
            yield {"kind": "mass", "part": part, "source": source, "a": codes, "b": packed(customers[at]), "c": packed(tables[at]), "x": len(at)}

    return gathered(dishes.union(of_kind(found, "slice")), "part", work, parts)


def score_texts(docs: DataFrame, slice_characters: int = 8 << 20, folds: int = 10, burn_in: int = 2, samples: int = 2, theta: float = 1.0, part_tokens: int = 1 << 21) -> DataFrame:
    """log10 probability of every whole text under a hierarchical Pitman-Yor model of the training documents.

    Tokens are the A-Z lower-cased words between ASCII white space, then one end. Training documents are those whose
    crc32(doc_id as text) mod `folds` is not 0. After `burn_in` Gibbs sweeps, predictive probabilities are averaged
    over `samples` more. Discounts are estimated from how many dishes have one and two customers; theta is the
    concentration of all restaurants. An unseen word has the root's base of 1 / (training types + 1).

    Restaurants are dealt to parts by a hash of their context, or of the pair for the most frequent contexts, and the root's dishes by a hash of the word; there are as many parts as it takes for about part_tokens tokens each, or
    as many as shuffle partitions if each then has a megabyte of text. Each slice of the documents asks for its own distinct words and pairs of neighbours and
    gets what is known of them back, so no task and no driver holds the model. Slices are cut from files in order and are the
    same in both readings.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram), score. Null texts are
    empty: one end token. Null doc_ids are held out. Repeated rows are documents of their own, and equal texts get equal
    scores. An empty table gives an empty result; other columns are ignored. Without training documents all words are unseen.
    """
    spark = docs.sparkSession
    own, _ = with_chunk(docs)
    total, wide = wide_contexts(own)
    parts = max(1, int(total // (6 * part_tokens)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total >> 20)))
    found = cut(counted(asked(own, folds, slice_characters, parts, wide), parts, wide), "counts", by="kind")
    tokens, types = of_kind(found, "words").agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    lexicon = cut(lexicons(found, parts), "lexicon")
    discard(found, folders=[f"kind={kind}" for kind in LISTED])
    base = 1 / (types + 1)
    dishes, discount, kept = sampled(found, lexicon, base, parts, burn_in, samples, theta)

    masses = cut(own_masses(found, dishes, parts), "masses")
    discard(found, folders=("kind=slice", "kind=dishes"))
    discard(dishes, folders=("kind=dishes", "kind=tables"))
    facts = cut(word_facts(lexicon, found, kept, parts), "facts")
    discard(found, lexicon, *(rows for rows, *_ in kept))
    roots = [totals for _, totals, _ in kept]

    def numbered(batches: Iterable) -> Iterator:
        for s in slices(batches, folds, slice_characters):
            ids = ["" if pd.isna(d) else str(d) for d in s.ids]
            yield frame([{"kind": "text", "part": 0, "source": s.name, "a": squeezed(s.flat.astype("<i4")), "b": np.diff(s.ends, prepend=0).tobytes(), "c": " ".join(i or "-" for i in ids).encode(), "x": len(s.flat)}])

    met = facts.union(masses).union(own.mapInPandas(numbered, ROW))

    def scored(kinds: dict[str, pd.DataFrame], _: int) -> Iterator[pd.DataFrame]:
        facts, masses, text = kinds["facts"], kinds["mass"], kinds["text"].iloc[0]
        n = [len(a) // 8 for a in facts["a"]]
        hashes = hashes_of(b"".join(facts["a"]))
        order = np.argsort(hashes)
        c = np.concatenate([unpacked(b, k) for b, k in zip(facts["b"], n, strict=True)])[order]
        tables, *at_root = (np.hstack([unpacked(t, samples * k).reshape(samples, k) for t, k in zip(facts[name], n, strict=True)])[:, order] for name in "cde")
        root = [totals.probability(x, y) for totals, x, y in zip(roots, *at_root, strict=True)]
        sizes = hashes_of(text["b"])
        s = Slice.told(hashes[order], spread(text["a"], text["x"]).astype(np.int32), sizes)
        _, ctx, word, _, at = s.pairs(parts, wide)
        codes = np.frombuffer(b"".join(masses["a"]), np.uint8)
        n, t = (np.concatenate([unpacked(raw, k) for raw, k in zip(masses[name], masses["x"], strict=True)]) for name in "bc")
        mass = np.where(codes == 1, 1 - discount, 0.0)
        mass[codes == 2] = n - discount * t / samples
        p = sum((mass + (theta + discount * t[ctx]) * r[word]) / (theta + c[ctx]) for t, r in zip(tables, root, strict=True)) / samples
        log = np.log10(p)[at]
        base_log = np.log10((c + SMOOTH) / (tokens + SMOOTH * (types + 1)))[s.flat]
        known = np.concatenate([[0], np.cumsum((c > 0)[s.flat])])
        ids = [None if doc == "-" else doc for doc in text["c"].decode().split(" ")]
        first, last = s.ends - sizes + 1, s.ends
        after = np.cumsum(sizes - 1)
        yield pd.DataFrame({
            "doc_id": ids, "held_out": [is_held_out(doc, folds) for doc in ids], "n_tokens": sizes - 1, "n_known": known[last] - known[first], "train_tokens": tokens,
            "base_score": [np.add.reduce(base_log[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)],
            "score": [np.add.reduce(log[i:j]) for i, j in zip((after - sizes + 1).tolist(), after.tolist(), strict=True)],
        })

    result = gathered(met, "source", scored, schema="doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumn("doc_id", F.col("doc_id").cast("long"))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training documents."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
