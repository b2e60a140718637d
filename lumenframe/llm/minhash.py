"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, documents, regrouped, runs
from lumenframe.llm.fingerprint import WordHashes, mixed, step

#: Shingles that are hashed into signatures at once.
BLOCK = 1 << 18
#: Documents of one bucket that a task compares with each other, or with as many others.
BUCKET = 1024
#: Members of a larger bucket that all others are compared with first, on average.
HUBS = 16


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; else empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    width = min(k, n)
    x = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[i : n - width + 1 + i]
    return np.unique(mixed(x))


def super_minhash(elements: np.ndarray, counts: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures of several sets laid end to end: one row of m uint64 values per set.

    Every element walks through a random permutation of the m registers, one step a level (Fisher-Yates), and offers
    the register it meets at level j the value j + a random fraction. A register keeps the least value. Later levels
    only offer larger values, so a set stops as soon as each of its registers has one: large sets after a level
    or two. Elements of all sets take a level together.
    """
    signature = np.full((len(counts), m), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    order: np.ndarray | None = None
    for level in range(m):
        u = mixed(elements + step(seed * m + level + 1))
        at = level + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        if order is None:
            register = at
        else:
            rows = np.arange(len(elements))
            register = order[rows, at].astype(np.int64)
            order[rows, at] = order[rows, level]
        np.minimum.at(signature.reshape(-1), owner * m + register, np.uint64(level << 32) | (u >> np.uint64(32)))
        open_sets = signature.max(1) >= np.uint64((level + 1) << 32)
        keep = open_sets[owner]
        if not keep.any():
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint16), (int(keep.sum()), 1))
            order[np.arange(len(order)), at[keep]] = 0
        elif not keep.all():
            order = order[keep]
        elements, owner = elements[keep], owner[keep]
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One int64 per band of `rows` registers."""
    sets, m = signature.shape
    x = np.zeros((sets, m // rows), np.uint64) + np.arange(m // rows, dtype=np.uint64)
    for i in range(rows):
        x = mixed(x * np.uint64(0xA0761D6478BD642F) + signature[:, i::rows][:, : m // rows])
    return x.view(np.int64)


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, same (hash of the shingle set, null without shingles), keys (a key per band)."""

    @F.pandas_udf("struct<n_shingles: long, same: string, keys: array<long>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            counts, same, keys, held = [], [], [], []

            def flush() -> None:
                full = [s for s in held if len(s)]
                found = iter(band_keys(super_minhash(np.concatenate(full), np.array([len(s) for s in full]), bands * rows), rows) if full else ())
                counts.extend(map(len, held))
                same.extend(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in held)
                keys.extend(next(found) if len(s) else None for s in held)
                held.clear()

            size = 0
            for text in batch:
                held.append(shingle_set(text, k, words))
                size += len(held[-1])
                if size > BLOCK:
                    flush()
                    words.trim()
                    size = 0
            flush()
            yield pd.DataFrame({"n_shingles": counts, "same": same, "keys": keys})

    return docs.select("doc_id", sign("text").alias("signed")).select("doc_id", "signed.*")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, same, shingles) of whole texts; ids are not null here."""

    def each(batches: Iterable) -> Iterator:
        words = WordHashes()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                sets = [shingle_set(t, k, words) for t in part["text"]]
                words.trim()
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "same": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.mapInPandas(each, "doc_id long, same string, shingles array<long>")


class Groups:
    """Union-find over the groups that a tile's rows come with."""

    def __init__(self, group: np.ndarray) -> None:
        self.names, self.at = np.unique(group, return_inverse=True)
        self.parent = np.arange(len(self.names))

    def top(self, g: int) -> int:
        while self.parent[g] != g:
            self.parent[g] = self.parent[self.parent[g]]
            g = self.parent[g]
        return int(g)

    def of_rows(self) -> np.ndarray:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        return self.parent[self.at]

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(self.at[i]), self.top(self.at[j])
        self.parent[b] = a
        return a != b


def tile_links(sets: list[np.ndarray], group: np.ndarray, earlier: np.ndarray, percent: int, lot: int = 16, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places (i, j) that connect what sets with a Jaccard similarity of at least percent / 100 connect: a forest.

    Rows are compared with all others, `lot` at a time, those of small groups first after one lot of any; it ends when every row
    outside the largest group has been compared, or every row of `only` where that is given. Pairs of one group need no link, and pairs that
    agree in a column of `earlier` (keys of earlier bands) have met in an earlier bucket.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    elements, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(counts >= 2, np.cumsum(counts >= 2), 0)  # 0: held by one set alone
    column = number[column]
    groups, done, edges = Groups(group), np.zeros(n, bool), []
    while True:
        own = groups.of_rows()
        count = np.bincount(own, minlength=len(groups.names))
        left = np.flatnonzero(~done & (own != count.argmax())) if only is None else only[~done[only]]
        if not len(left):
            return edges
        hubs = np.arange(min(lot, n)) if only is None and not done.any() else left[np.argsort(count[own[left]], kind="stable")[:lot]]
        done[hubs] = True
        marks = np.zeros((number.max() + 1, len(hubs)), np.uint8)
        for k, h in enumerate(hubs.tolist()):
            marks[column[starts[h] : starts[h] + sizes[h]], k] = 1
        marks[0] = 0
        fits = 100 * np.minimum(sizes[:, None], sizes[hubs]) >= percent * np.maximum(sizes[:, None], sizes[hubs])
        fits &= own[:, None] != own[hubs]
        for band in range(earlier.shape[1]):
            fits &= earlier[:, band, None] != earlier[hubs, band]
        rows = np.flatnonzero(fits.any(1))
        for part in np.array_split(rows, max(1, int(sizes[rows].sum()) >> 19)):
            if not len(part):
                continue
            ends = np.cumsum(sizes[part])
            flat = np.repeat(starts[part] - ends + sizes[part], sizes[part]) + np.arange(ends[-1])
            common = np.add.reduceat(marks[column[flat]], ends - sizes[part], axis=0, dtype=np.int64)
            linked = fits[part] & (100 * common >= percent * (sizes[part, None] + sizes[hubs] - common))
            for i, k in zip(*np.nonzero(linked), strict=True):
                if groups.join(int(part[i]), int(hubs[k])):
                    edges.append((int(part[i]), int(hubs[k])))


def compared(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside each tile. tiles: tile, band, rep, component, keys, shingles, hub; where a tile has hubs, links to them alone."""

    def each(batches: Iterable) -> Iterator:
        for tile in runs(batches, "tile"):
            tile = tile.drop_duplicates("rep") if tile["hub"].any() else tile
            group, hubs = tile["component"].to_numpy(), np.flatnonzero(tile["hub"])
            if len(tile) > 1 and (group != group[0]).any():
                rep, band = tile["rep"].to_numpy(), int(tile["band"].iloc[0])
                edges = np.array(tile_links(list(tile["shingles"]), group, np.stack(tile["keys"].to_numpy())[:, :band], percent, only=hubs if len(hubs) else None)).reshape(-1, 2)
                if len(edges):
                    yield pd.DataFrame({"a": rep[edges[:, 0]], "b": rep[edges[:, 1]]})

    return tiles.repartition("tile").sortWithinPartitions("tile", F.desc("hub")).mapInPandas(each, "a long, b long")


def blocks_of(n: Column) -> Column:
    return F.ceil(n / BUCKET).cast("int")


def hub_links(members: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets' members to a few of them, hubs, that go to each of a bucket's blocks: rows in proportion to the bucket.

    members: key, band, rep, component, size, keys, shingles. Hubs are drawn by a hash, about HUBS a bucket.
    """
    m = members.withColumns({"hub": F.pmod(F.xxhash64("rep", "key"), F.col("size")) < HUBS, "block": F.pmod(F.xxhash64("rep"), blocks_of(F.col("size"))).cast("int")})
    places = F.when(F.col("hub"), F.sequence(F.lit(0), blocks_of(F.col("size")) - 1)).otherwise(F.array("block"))
    tiles = m.withColumn("block", F.explode(places))
    return compared(tiles.select(F.xxhash64("key", "block").alias("tile"), "band", "rep", "component", "keys", "shingles", "hub"), percent)


def bucket_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect each bucket's documents. members: key, band, rep, component, size, keys, shingles.

    Members outside a bucket's largest component are compared with all others. Both are split into blocks of BUCKET, and each block
    of the former meets each of the latter in a tile of its own; no pair becomes a row. So a bucket that is connected but for a few moves
    about once.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), (F.sum("n") - F.max("n")).alias("outside"))
    m = members.join(top, "key")
    out = F.col("component") != F.col("top")
    mine = lambda n: F.pmod(F.xxhash64("rep"), blocks_of(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks_of(n) - 1)
    pair = lambda u, b: F.struct(u.alias("u"), b.alias("b"))
    as_member = F.transform(every(F.col("outside")), lambda u: pair(u, mine(F.col("size"))))
    as_outsider = F.transform(every(F.col("size")), lambda b: pair(mine(F.col("outside")), b))
    tiles = m.withColumn("t", F.explode(F.array_distinct(F.concat(as_member, F.when(out, as_outsider).otherwise(F.slice(as_member, 1, 0))))))
    return compared(tiles.select(F.xxhash64("key", "t.u", "t.b").alias("tile"), "band", "rep", "component", "keys", "shingles", F.lit(False).alias("hub")), percent)


def unsettled(met: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The members (key, band, rep) of buckets that hold more than one component, with their component and the bucket's size."""
    if groups is None:
        members = met.select("key", "band", "rep", F.col("rep").alias("component"))
    else:
        members = met.join(groups, met["rep"] == groups["node"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    split = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    return members.join(split, "key")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity of at least percent / 100.

    Words are split at ASCII white space and A-Z lower-cased. Equal sets form a class, and the class's smallest doc_id
    stands for it. Representatives that agree on a band of their signatures meet in a bucket; 32 bands of 4 miss a
    pair at 0.8 once in 2 * 10**7. Pairs of a bucket that are not connected yet are verified on full sets inside a task
    that returns a spanning forest, each pair in the first bucket where it meets. Large buckets are compared with a few hubs first,
    and only members which that leaves outside the bucket's largest component then meet all others. Bands go in rounds of 1, 5 and the
    rest: a bucket whose members earlier rounds have connected has nothing left to verify. Links are grouped by union-find, later ones between the groups of earlier ones.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id). A document
    without words has no shingles and no links. Rows with a null doc_id are returned unlinked, with a null
    component_id and kept false. Rows that share a doc_id are one node with the links of all of them. An empty
    table gives an empty result; other columns are ignored.
    """
    marked = cut(signed(docs, k, bands, rows), "signed")
    whole = F.col("same").isNotNull() & F.col("doc_id").isNotNull()
    classes = cut(marked.where(whole).groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
    reps = marked.where(whole).join(classes, "same").where("doc_id = rep").select("rep", "same", "keys").dropDuplicates(["rep", "same"])
    buckets = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    met = cut(buckets.join(shared, "key", "left_semi"), "buckets")

    wanted = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = sets_of(texts, k).join(classes.select(F.col("rep").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi")
    sets = sets.dropDuplicates(["doc_id", "same"]).select(F.col("doc_id").alias("rep"), "same", "shingles")
    sets = cut(sets.join(reps, ["rep", "same"]).select("rep", "keys", "shingles"), "sets")

    groups = None
    for low, high in ((0, 1), (1, 6), (6, bands)):
        if low == 1:  # from here on only the sets of buckets that are not settled move
            met = cut(unsettled(met.where("band > 0"), groups).select("rep", "band", "key"), "open")
            sets = cut(sets.join(met.select("rep").distinct(), "rep", "left_semi"), "sets")
        members = cut(unsettled(met.where(F.col("band").between(low, high - 1)), groups), "members")
        large = members.where(F.col("size") > BUCKET)
        if not large.isEmpty():
            groups = regrouped(groups, cut(hub_links(large.join(sets, "rep"), percent), "hubs"))
            members = cut(unsettled(members.select("key", "band", "rep"), groups), "members")
        groups = regrouped(groups, cut(bucket_links(members.join(sets, "rep"), percent), "links"))

    rep = classes.join(groups, classes["rep"] == groups["node"], "left").select("same", F.coalesce("component", "rep").alias("rep"))
    result = marked.select("doc_id", "n_shingles", "same").join(rep, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4)


ORACLE_SQL = {
    "op1_minhash_dedup": """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
        n as (select doc_id, len(s)::bigint as n_shingles from s), x as (select doc_id, unnest(s) as x from s),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.x = b.x and a.doc_id <> b.doc_id group by all),
        l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
        r as (select doc_id, doc_id as at from n union select r.doc_id, l.b from r join l on l.a = r.at)
        select n.doc_id, n_shingles, min(r.at) as component_id, n.doc_id = min(r.at) as kept from n join r on r.doc_id = n.doc_id group by n.doc_id, n_shingles"""
}
