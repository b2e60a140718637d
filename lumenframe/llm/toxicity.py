"""Toxicity scores: a bidirectional gated recurrent network over characters and words, trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Numbers, documents

#: Marks that are stripped from both ends of a word, and the most bytes of a word that form one token.
MARKS, PIECE = b".,;:!?*%$&#@\"'()[]{}<>|/\\-_+=~`^", 16
#: Tokens in a window; windows overlap by half.
WINDOW = 32
STRIDE = WINDOW // 2
CHARS, WORDS, CHAR_HIDDEN, HIDDEN, KEYS = 8, 8, 8, 12, 8


def raw_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def pieces(word: bytes) -> list[bytes]:
    """The word without marks at its ends, or as it is if it is all marks.

    Longer words become overlapping pieces of PIECE bytes, so none of their characters is left out.
    """
    bare = word.strip(MARKS) or word
    return [bare] if len(bare) <= PIECE else [bare[i : i + PIECE] for i in range(0, len(bare) - PIECE // 2, PIECE // 2)]


def tokens(text: str | None) -> list[bytes]:
    return [t for w in raw_words(text) for t in pieces(w)]


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n tokens; one empty window for none."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Row i of the result is the sum of the rows whose `at` is i."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] = np.add.reduceat(rows[order], first)
    return out


def first_windows(docs: Sequence[np.ndarray], labels: np.ndarray, words: int) -> list[int]:
    """The window that each training document teaches with at first: the one whose words are the most telling of toxic documents.

    docs: numbers below `words` of each document's tokens. Words go by the log ratio of toxic to clean documents that hold them, without
    the document itself. Scores never see these ratios.
    """
    held = np.zeros((2, words), np.int64)
    for d, y in zip(docs, labels.tolist(), strict=True):
        held[y, np.unique(d)] += 1
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]

    def ratios(y: int) -> np.ndarray:
        """Of the words that documents labelled y hold."""
        out = np.zeros(words)
        for w in np.flatnonzero(held[y]).tolist():
            clean, toxic = (int(held[i, w]) - (y == i) for i in (0, 1))
            out[w] = math.log((toxic / n[1] + 1 / sum(n)) / (clean / n[0] + 1 / sum(n)))
        return out

    ratio = [ratios(0), ratios(1)]
    return [int(np.argmax([ratio[y][d[s : s + WINDOW]].max(initial=-math.inf) for s in window_starts(len(d))])) for d, y in zip(docs, labels.tolist(), strict=True)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def scaled(weights: np.ndarray, directions: int = 1) -> np.ndarray:
    """Columns z, r, n of each direction as `Gru.walk` takes them: -x for the gates, -2 x for n; that rounds nothing."""
    size = weights.shape[-1] // (3 * directions)
    return weights * np.tile(np.repeat(np.array([-1, -2], np.float32), [2 * size, size]), directions)


class Gru:
    """One direction: gates z, r and candidate n from inputs already multiplied by W; masked steps keep the state."""

    @staticmethod
    def run(a: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
        """a: (batch, steps, 3H) -> states (batch, steps, H), and what the backward pass needs."""
        batch, steps, width = a.shape
        size = width // 3
        h = np.zeros((batch, size), a.dtype)
        states, memory = np.empty((batch, steps, size), a.dtype), [None] * steps
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g = h @ u
            zr = sigmoid(a[:, t, : 2 * size] + g[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(a[:, t, 2 * size :] + r * g[:, 2 * size :])
            memory[t] = h, z, r, n, g[:, 2 * size :]
            h = h + mask[:, t, None] * (1 - z) * (n - h)
            states[:, t] = h
        return states, memory

    @staticmethod
    def walk(inputs: Callable[[int, int], np.ndarray], u: Sequence[np.ndarray], mask: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
        """The states of `run` in both directions, without what learning needs; a feature to a line, so steps work on whole lines in place.

        inputs(direction, t): (3H, batch), scaled as u is by `scaled`; mask: (steps, batch). Returns the last states (2, H, batch) and
        writes all into `states` (steps, 2, H, batch). With scaled inputs z and r are 1 / (1 + exp(x)) and n is 2 / (1 + exp(x)) - 1.
        """
        steps, batch = mask.shape
        size = len(u[0])
        turn = np.stack([scaled(x).T for x in u])
        h, g = (np.zeros((2, k * size, batch), np.float32) for k in (1, 3))
        gates, z, r, n = g[:, : 2 * size], g[:, :size], g[:, size : 2 * size], g[:, 2 * size :]
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.matmul(turn, h, out=g)
                a = inputs(0, t), inputs(1, steps - 1 - t)
                for x, y in zip(gates, a, strict=True):
                    x += y[: 2 * size]
                np.exp(gates, out=gates)
                gates += 1
                np.divide(n, r, out=n)
                for x, y in zip(n, a, strict=True):
                    x += y[2 * size :]
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                n -= h
                np.divide(1, z, out=z)
                np.subtract(1, z, out=z)
                n *= z
                n[0] *= mask[t]
                n[1] *= mask[steps - 1 - t]
                h += n
                if states is not None:
                    states[t, 0], states[steps - 1 - t, 1] = h
        return h

    @staticmethod
    def grad(d_states: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, memory: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients for a and u."""
        batch, steps, size = d_states.shape
        da, du, dh = np.zeros((batch, steps, 3 * size), d_states.dtype), np.zeros_like(u), np.zeros((batch, size), d_states.dtype)
        for t in range(steps) if back else range(steps - 1, -1, -1):
            h, z, r, n, gn = memory[t]
            dh = dh + d_states[:, t]
            dm = dh * mask[:, t, None]
            dn = dm * (1 - z) * (1 - n * n)
            dz = dm * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da[:, t] = np.hstack([dz, dr, dn])
            dg = np.hstack([dz, dr, dn * r])
            du += h.T @ dg
            dh = dh - dm * (1 - z) + dg @ u.T
        return da, du


class Network:
    """Characters -> bidirectional GRU -> word vector; with a word's embedding -> bidirectional GRU -> attention."""

    def __init__(self, vocabulary: Sequence[bytes], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        word = 2 * CHAR_HIDDEN + WORDS
        self.p = {
            "chars": (0.5 * rng.standard_normal((257, CHARS))).astype(np.float32),
            "words": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORDS))).astype(np.float32),
            "cw": draw(CHARS, 6 * CHAR_HIDDEN), "cb": np.zeros(6 * CHAR_HIDDEN, np.float32),
            "cuf": draw(CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cub": draw(CHAR_HIDDEN, 3 * CHAR_HIDDEN),
            "w": draw(word, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32),
            "uf": draw(HIDDEN, 3 * HIDDEN), "ub": draw(HIDDEN, 3 * HIDDEN),
            "key": draw(2 * HIDDEN, KEYS), "query": draw(KEYS), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        self.p["words"][0] = 0

    def spell(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Character codes (256 pads) and mask of the words."""
        steps = max(1, max(map(len, words), default=1))
        padded = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), np.uint8).reshape(len(words), steps).astype(np.int64)
        mask = (np.arange(steps) < np.fromiter(map(len, words), np.int64, len(words))[:, None]).astype(np.float32)
        return np.where(mask > 0, padded, 256), mask

    def word_vectors(self, words: Sequence[bytes]) -> tuple[np.ndarray, tuple]:
        p, (codes, mask) = self.p, self.spell(words)
        table = p["chars"] @ p["cw"] + p["cb"]
        a = table[codes]
        half = 3 * CHAR_HIDDEN
        f, mf = Gru.run(a[:, :, :half], p["cuf"], mask, False)
        b, mb = Gru.run(a[:, :, half:], p["cub"], mask, True)
        ids = np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))
        return np.hstack([f[:, -1], b[:, 0], p["words"][ids]]), (codes, mask, mf, mb, ids, f.shape[1])

    def read(self, words: Sequence[bytes]) -> np.ndarray:
        """The vectors of word_vectors alone."""
        p, (codes, mask) = self.p, self.spell(words)
        table, half = np.ascontiguousarray(scaled(p["chars"] @ p["cw"] + p["cb"], 2).T), 3 * CHAR_HIDDEN
        codes, mask = np.ascontiguousarray(codes.T), np.ascontiguousarray(mask.T)
        f, b = Gru.walk(lambda d, t: table[d * half : (d + 1) * half].take(codes[t], 1), (p["cuf"], p["cub"]), mask)
        ids = np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))
        return np.hstack([f.T, b.T, p["words"][ids]])

    def inputs(self, words: Sequence[bytes], block: int = 512) -> np.ndarray:
        """Inputs of the word level for each word, (2, words, 3 * HIDDEN) as `Gru.walk` takes them.

        Words go by length, so short ones take few steps.
        """
        out, half = np.empty((2, len(words), 3 * HIDDEN), np.float32), 3 * HIDDEN
        w, bias = scaled(self.p["w"], 2), scaled(self.p["b"], 2)
        by_length = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for i in range(0, len(words), block):
            part = by_length[i : i + block]
            x = self.read([words[j] for j in part]) @ w + bias
            out[0, part], out[1, part] = x[:, :half], x[:, half:]
        return out

    def logits(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logits of `pooled` alone, for windows of words of a table of `inputs`: at, mask are (WINDOW, windows)."""
        p, h = self.p, np.empty((WINDOW, 2, HIDDEN, at.shape[1]), np.float32)
        Gru.walk(lambda d, t: table[d].take(at[t], 0).T, (p["uf"], p["ub"]), mask, h)
        h = h.reshape(WINDOW, 2 * HIDDEN, -1)
        s = np.matmul(p["query"], np.tanh(np.matmul(p["key"].T, h))) - 1e4 * (1 - mask)
        e = np.exp(s - s.max(0)) * np.maximum(mask, 1e-9)
        h *= (e / e.sum(0))[:, None]
        return p["out"] @ h.sum(0) + p["bias"]

    def pooled(self, a: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logit per window from gate inputs (windows, WINDOW, 6 * HIDDEN)."""
        p, half = self.p, 3 * HIDDEN
        f, mf = Gru.run(a[:, :, :half], p["uf"], mask, False)
        b, mb = Gru.run(a[:, :, half:], p["ub"], mask, True)
        h = np.concatenate([f, b], 2)
        key = np.tanh(h @ p["key"])
        s = key @ p["query"] - 1e4 * (1 - mask)
        e = np.exp(s - s.max(1, keepdims=True)) * np.maximum(mask, 1e-9)
        weight = e / e.sum(1, keepdims=True)
        pool = (weight[:, :, None] * h).sum(1)
        return pool @ p["out"] + p["bias"], (h, key, weight, pool, mf, mb)

    def learn(self, windows: list[list[bytes]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for a batch of windows."""
        p = self.p
        words = sorted({w for x in windows for w in x}) or [b""]
        at = {w: i for i, w in enumerate(words)}
        ids, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.float32)
        for i, x in enumerate(windows):
            ids[i, : len(x)], mask[i, : len(x)] = [at[w] for w in x], 1
        v, (codes, cmask, cmf, cmb, wid, steps) = self.word_vectors(words)
        logit, (h, key, weight, pool, mf, mb) = self.pooled((v @ p["w"] + p["b"])[ids], mask)
        y = sigmoid(logit)
        loss = float(-(labels * np.log(y + 1e-7) + (1 - labels) * np.log(1 - y + 1e-7)).mean())
        d = ((y - labels) / len(y)).astype(np.float32)
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        dweight = (h * dpool[:, None, :]).sum(2)
        ds = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
        dkey = ds[:, :, None] * p["query"] * (1 - key * key)
        g["query"] = (key * ds[:, :, None]).sum((0, 1))
        g["key"] = np.einsum("btk,btj->kj", h, dkey)
        dh = weight[:, :, None] * dpool[:, None, :] + dkey @ p["key"].T
        daf, g["uf"] = Gru.grad(dh[:, :, :HIDDEN], p["uf"], mask, False, mf)
        dab, g["ub"] = Gru.grad(dh[:, :, HIDDEN:], p["ub"], mask, True, mb)
        da = summed(np.concatenate([daf, dab], 2)[mask > 0], ids[mask > 0], len(words))
        g["w"], g["b"] = v.T @ da, da.sum(0)
        dv = da @ p["w"].T
        g["words"] = summed(dv[:, 2 * CHAR_HIDDEN :], wid, len(p["words"]))
        g["words"][0] = 0
        dcf, dcb = (np.zeros((len(words), steps, CHAR_HIDDEN), np.float32) for _ in range(2))
        dcf[:, -1], dcb[:, 0] = dv[:, :CHAR_HIDDEN], dv[:, CHAR_HIDDEN : 2 * CHAR_HIDDEN]
        caf, g["cuf"] = Gru.grad(dcf, p["cuf"], cmask, False, cmf)
        cab, g["cub"] = Gru.grad(dcb, p["cub"], cmask, True, cmb)
        ca = np.concatenate([caf, cab], 2)
        g["cb"] = ca.sum((0, 1))
        table = summed(ca.reshape(-1, 6 * CHAR_HIDDEN), codes.reshape(-1), 257)
        g["cw"], g["chars"] = p["chars"].T @ table, table @ p["cw"].T
        return loss, g

    def window_logits(self, texts: Sequence[str | None], known: Known | None = None) -> list[np.ndarray]:
        """Logits of all overlapping windows of each text; `known` keeps words from call to call."""
        known = known or Known(self)
        return self.numbered_logits(known.numbered(texts), known.table)

    def numbered_logits(self, ids: Sequence[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
        """The logits of window_logits from each text's tokens as places in a table of `inputs`."""
        starts = [window_starts(len(d)) for d in ids]
        counts = np.array([len(s) for s in starts])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        ends = np.cumsum([len(d) for d in ids])
        first = np.concatenate([np.array(s, np.int64) + (e - len(d)) for s, e, d in zip(starts, ends, ids, strict=True)])
        stop = np.minimum(first + WINDOW, np.repeat(ends, counts))
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), 512):
            at = first[i : i + 512] + np.arange(WINDOW)[:, None]
            mask = (at < stop[i : i + 512]).astype(np.float32)
            out[i : i + 512] = self.logits(table, flat[np.minimum(at, len(flat) - 1)], mask)
        return np.split(out, np.cumsum(counts)[:-1])

    def scores(self, texts: Sequence[str | None], most: int = 2_000_000) -> list[float]:
        """Per text, the probability of its most toxic window. Equal texts are scored once, in blocks of about `most` characters."""
        numbers, known, out = Numbers(), Known(self), []
        at = [numbers[t] for t in texts]
        held, size = [], 0
        for text in (*numbers, None):
            if held and (size > most or len(out) + len(held) == len(numbers)):
                out += [float(sigmoid(x.max())) for x in self.window_logits(held, known)]
                held, size = [], 0
            held.append(text)
            size += len(text or "")
        return [out[i] for i in at]


class Known:
    """Words that blocks of texts share: each is taken apart, and the network reads each token, once.

    Where they come to more than `most`, those of the last block alone are kept.
    """

    def __init__(self, net: Network, most: int = 1 << 17) -> None:
        self.net, self.most = net, most
        self.raw, self.seen = Numbers(), Numbers()
        #: Tokens of each word, and their numbers word by word; inputs of each token.
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.empty((2, 0, 3 * HIDDEN), np.float32)

    def numbered(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Each text as numbers of its tokens, which are their places in the table."""
        if len(self.raw) > self.most:
            self.shrink()
        ids = [np.fromiter(map(self.raw.__getitem__, w), np.int64, len(w)) for w in map(raw_words, texts)]
        self.last = ids
        words = list(islice(self.raw, len(self.counts), None))
        bare = [w.strip(MARKS) or w for w in words]
        long = {i: [self.seen[t] for t in pieces(words[i])] for i, w in enumerate(bare) if len(w) > PIECE}
        new, short = np.ones(len(words), np.int64), np.ones(len(words), bool)
        for i, part in long.items():
            new[i], short[i] = len(part), False
        first, flat = np.cumsum(new) - new, np.empty(int(new.sum()), np.int64)
        flat[first[short]] = [self.seen[w] for w in bare if len(w) <= PIECE]
        for i, part in long.items():
            flat[first[i] : first[i] + len(part)] = part
        self.counts, self.flat = np.concatenate([self.counts, new]), np.concatenate([self.flat, flat])
        if not self.seen:
            _ = self.seen[b""]  # texts without words have an empty window
        read = self.table.shape[1]
        if read < len(self.seen):
            self.table = np.concatenate([self.table, self.net.inputs(list(islice(self.seen, read, None)))], 1)
        starts = np.cumsum(self.counts) - self.counts
        out = []
        for x in ids:
            n = self.counts[x]
            out.append(self.flat[np.repeat(starts[x] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out

    def shrink(self) -> None:
        """Drop all but the last block's words and their tokens."""
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *self.last]))
        held = np.zeros(len(self.raw), bool)
        held[used] = True
        flat = self.flat[np.repeat(held, self.counts)]
        tokens, self.flat = np.unique(flat, return_inverse=True)
        kept = lambda old, at: Numbers(zip(map(list(old).__getitem__, at.tolist()), range(len(at)), strict=True))
        self.raw, self.seen = kept(self.raw, used), kept(self.seen, tokens)
        self.counts, self.table = self.counts[used], self.table[:, tokens]


def train(texts: Sequence[str | None], labels: Sequence[int], epochs: int = 8, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit on labelled texts. A document is as toxic as its most toxic window, so learning goes by windows.

    Toxic documents teach with their most telling window: by their words at first, then by the network
    itself. Clean ones teach with the window the network takes for the worst, and with one at random.
    Documents are kept as numbers of their tokens, and each token's bytes once.
    """
    numbers, y = Numbers(), np.array(labels, np.int64)
    docs = [np.fromiter(map(numbers.__getitem__, tokens(t)), np.int32) for t in texts]
    words = list(numbers)
    rng = np.random.default_rng(seed)
    frequency = np.zeros(len(words), np.int64)
    for d in docs:
        frequency[np.unique(d)] += 1
    net = Network(sorted(words[i] for i in np.flatnonzero(frequency >= 5).tolist()), seed)
    counts = [len(window_starts(len(d))) for d in docs]
    window = lambda d, i: [words[j] for j in docs[d][i * STRIDE : i * STRIDE + WINDOW].tolist()]
    worst = first_windows(docs, y, len(words))
    m, v, k = {n: 0.0 for n in net.p}, {n: 0.0 for n in net.p}, 0
    for epoch in range(epochs if len(docs) else 0):
        if epoch >= 2 and epoch % 2 == 0:
            table = net.inputs(words or [b""])
            for at in range(0, len(docs), 200):
                worst[at : at + 200] = [int(x.argmax()) for x in net.numbered_logits(docs[at : at + 200], table)]
            del table
        examples = [(d, i, t) for d, (i, t) in enumerate(zip(worst, y, strict=True))] + [(d, int(rng.integers(c)), 0) for d, (c, t) in enumerate(zip(counts, y, strict=True)) if not t]
        order, lot = rng.permutation(len(examples)), min(64, max(8, len(examples) // 40))  # small sets take as many steps
        for i in range(0, len(order), lot):
            batch = [examples[j] for j in order[i : i + lot]]
            _, g = net.learn([window(d, at) for d, at, _ in batch], np.array([t for *_, t in batch], np.float32))
            scale = min(1.0, 1.0 / (math.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            k += 1
            now = rate * (0.2 if epoch >= epochs - 3 else 1.0)
            for name, x in g.items():
                x = x * scale
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.99 * v[name] + 0.01 * x * x
                net.p[name] -= (now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; labels of documents in fold 0 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 1500) -> Network:
    """Learn from labelled documents outside fold 0: at most `most` toxic and `most` clean ones.

    They are those with the smallest hashes of doc_id, whatever the size of the table; this bounds what the driver
    holds. Rows with a null label or id teach nothing, and without labels the network stays as it was drawn.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = marked.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    one = lambda kind: there.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(most).select("doc_id", "toxic")
    # At most 2 * most rows: they go to the texts, instead of all texts to them. Of rows with one id the first text counts.
    chosen = docs.select("doc_id", "text").join(F.broadcast(one(1).union(one(0))), "doc_id")
    sample = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return train([r["text"] for r in sample], [int(r["toxic"]) for r in sample])


def toxicity(net: Network, text: str) -> Column:
    """The score of a whole text between 0 and 1: that of its most toxic window among all overlapping ones.

    Null, empty and wordless texts have one empty window and get its score.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(net.scores(list(batch)), dtype="float64").round(6)

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 1500) -> DataFrame:
    """Score every whole text; the higher, the likelier its label `toxic` is 1.

    Labels, ids and other columns are never inputs. Scoring runs in the scan's own partitions, without a shuffle.
    Null ids count as held out. Repeated rows are scored alike; an empty table gives an empty result.
    Returns doc_id, held_out, score, predicted (1 if score >= 0.5).
    """
    scored = docs.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"), toxicity(fit_toxicity(docs, labels, most), "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
