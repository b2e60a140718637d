"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import documents



@functools.cache
def pieces_pattern(top: int) -> re.Pattern[str]:
    """The byte-level pre-tokenizer's pattern for texts of code points up to top, with character classes spelled out.

    re looks a class up in one step if it holds no code points above U+FFFF, so texts without such get their own pattern.

    Letters and numbers are Unicode's L* and N* categories, white space its White_Space property.
    """

    def ranges(inside) -> str:  # noqa: ANN001
        found, start = [], None
        for code in range(top + 2):
            hit = code <= top and inside(chr(code))
            if hit and start is None:
                start = code
            elif not hit and start is not None:
                found.append(f"\\U{start:08x}-\\U{code - 1:08x}")
                start = None
        return "".join(found)

    letters, numbers = (ranges(lambda c, kind=kind: unicodedata.category(c)[0] == kind) for kind in "LN")
    # The code points with the White_Space property.
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    # The alternatives, in the pre-tokenizer's order.
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 stands for itself, others for U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces(dict):
    """Token ids of a piece as int32 bytes, worked out once. The last generation is kept beside this one, so common pieces stay."""

    def __init__(self, make, most: int = 150_000, most_bytes: int = 32 << 20) -> None:  # noqa: ANN001
        self.make, self.most, self.most_bytes, self.held, self.old = make, most, most_bytes, 0, {}

    def __missing__(self, piece: str) -> bytes:
        self[piece] = found = self.old.get(piece) or self.make(piece)
        self.held += 4 * len(piece) + len(found)
        return found

    def trim(self) -> None:
        if len(self) > self.most or self.held > self.most_bytes:
            self.old, self.held = dict(self), 0
            self.clear()


class BytePairs:
    """An encoder from a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.merge_rank: dict[int, int] = {}
        size = max(self.bytes_of) + 1
        #: Of each token: the rank of the merge that makes it (-1 for a byte), and its parts.
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merge_rank[a << 32 | b] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in added and (len(token) == 1 or self.rank[i] >= 0):
                self.automaton.add_word(raw(token).decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.ids = Pieces(self.encode_piece)
        self.raw = self.table([self.bytes_of.get(i, b"") for i in range(size)])
        self.decimal = self.table([b"%d," % i for i in range(size)])

    @staticmethod
    def table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and all bytes of the strings."""
        lengths = np.array(list(map(len, strings)), np.int64)
        return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(strings), np.uint8)

    @staticmethod
    def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        """The strings of the ids, one after another."""
        starts, lengths, flat = table
        n = lengths[ids]
        ends = np.cumsum(n)
        return flat[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes() if len(ids) else b""

    def compatible(self, x: int, y: int) -> bool:
        """Whether merging the bytes of x and y by rank gives just (x, y).

        Walk back in time: undo the later of the merges that made the two tokens at the boundary, and see whether
        the tokens that met there before would have merged with each other first. Of equal pairs the left one is
        merged first, so on a tie the left token's merge wins and the right token's loses.
        """
        key = x << 32 | y
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, merges = self.rank, self.merge_rank
        a, b, ok = x, y, key not in merges
        rank_a, rank_b = rank[a], rank[b]
        while ok:
            if rank_a > rank_b:
                a = self.right[a]
                ok = merges.get(a << 32 | b, rank_a) >= rank_a
                rank_a = rank[a]
            elif rank_b >= 0:
                b = self.left[b]
                ok = merges.get(a << 32 | b, rank_b + 1) > rank_b
                rank_b = rank[b]
            else:
                break
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_piece(self, piece: str) -> bytes:
        """The ids as int32. Each prefix of the piece has one last token: the match ending there that fits the last token before it.

        The single byte is the last match to end anywhere. Just one match fits, so it needs no test when all others failed.
        """
        text = piece.encode().decode("latin-1")
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        fits, compatible = self.fits, self.compatible
        for end, (n, token) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            if n != end and n > 1:
                before = last[end - n]
                ok = fits.get(before << 32 | token)
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[end], size[end] = token, n
        out, at = array("i"), len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out.tobytes()

    @staticmethod
    def find(text: str) -> list[str]:
        top = 0x7F if text.isascii() else 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
        return pieces_pattern(top).findall(text)

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """Runs of pieces; True marks an added token."""
        parts = self.split_added.split(text) if self.split_added else [text]
        return [(True, [p]) if p in self.added else (False, self.find(p)) for p in parts if p]

    def encode(self, text: str) -> np.ndarray:
        self.ids.trim()
        return np.frombuffer(b"".join(array("i", [self.added[run[0]]]).tobytes() if is_added else b"".join(map(self.ids.__getitem__, run)) for is_added, run in self.pieces(text)), np.int32)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.joined(self.decimal, ids)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The bytes behind the ids as UTF-8; broken sequences become U+FFFD."""
        return self.joined(self.raw, ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, row by row, without a shuffle.

    path: the tokenizer's JSON file, readable on the executors; by default the installed public one. Null texts are
    empty and have no tokens. Repeated rows and null doc_ids are kept, an empty table gives an empty result, other
    columns are ignored. Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids adds ids and decoded.
    """

    shape = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    @F.pandas_udf(f"struct<{shape.replace(' ', ':').replace(',:', ', ')}>")
    def codec(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load(path or tokenizer_path())
        for batch in batches:
            out = []
            for text in batch:
                ids = model.encode(text or "")
                decoded = model.decode(ids)
                out.append((len(ids), hashlib.sha256(model.decimals(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids.tolist(), decoded) if with_ids else ())))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in shape.split(", ")])

    return docs.select("doc_id", codec("text").alias("coded")).select("doc_id", "coded.*")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))
