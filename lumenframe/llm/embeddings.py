"""Embedding near-dedup: randomised-rotation binary codes with correction factors and exact recomputation."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import components, cut, runs

#: Vectors of one bucket that a task compares with each other; larger buckets are split into pairs of blocks.
BLOCK = 2048
#: Seeds of the codes' rotations come after those of the tables.
CODES = 1_000_000


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def collision_rate(size: int, cosine: float, seed: int = 3, trials: int = 4096) -> float:
    """How often two unit vectors at this cosine have the same largest signed coordinate after a random rotation."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((trials, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((trials, size))
    z -= (x * z).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z
    return float((corner(x) == corner(y)).mean()) if size > 1 else 1.0


def corner(x: np.ndarray) -> np.ndarray:
    """The coordinate that is largest in size, and its sign."""
    at = np.abs(x).argmax(1)
    return 2 * at + (x[np.arange(len(x)), at] < 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; scaled by their largest component first, so nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def turns(size: int) -> int:
    """Rotations of a code: as many as give it 256 bits."""
    return -(-256 // size)


@functools.lru_cache(maxsize=4)
def frames(size: int, seed: int) -> np.ndarray:
    """The rotations of a code, one below the other."""
    return np.concatenate([rotation(size, seed + i) for i in range(turns(size))]).astype(np.float32)


def encoded(x: np.ndarray, seed: int) -> np.ndarray:
    """What is stored of unit vectors: two binary codes from rotations of their own, and a correction factor of each, as one row of bytes a vector.

    A code holds the signs of the vector in several rotated frames; its factor is the inner product of the normalized code and the vector's image. The first code stands for the vector
    where it is compared with others, the second where others are compared with it.
    """
    size, n = x.shape[1], turns(x.shape[1])
    parts, factors = [], []
    for side in (0, 1):
        image = np.concatenate([x @ rotation(size, seed + side * n + i).T for i in range(n)], 1) / math.sqrt(n)
        parts.append(np.packbits(image >= 0, axis=1))
        factors.append(np.abs(image).sum(1) / math.sqrt(image.shape[1]))
    return np.hstack([*parts, np.stack(factors, 1).astype("<f4").view(np.uint8)])


class Stored:
    """Codes read back: each side's vector that is rebuilt from signs and factor, and the variance that it adds to an estimate."""

    def __init__(self, code: np.ndarray, size: int, seed: int) -> None:
        n, width = turns(size), -(-turns(size) * size // 8)
        factors = np.ascontiguousarray(code[:, 2 * width :]).view("<f4").astype(float)
        self.rebuilt, self.variance = [], []
        for side in (0, 1):
            signs = np.unpackbits(code[:, side * width : (side + 1) * width], axis=1, count=n * size).astype(np.float32) * 2 - 1
            f = factors[:, side]
            self.rebuilt.append(signs @ frames(size, seed + side * n) / (n * math.sqrt(size) * f[:, None]).astype(np.float32))
            self.variance.append((1 - f * f).clip(0) / (f * f) / max(n * (size - 1), 1))
        self.size = size

    def undecided(self, low: int, high: int, least: float, sigmas: float) -> np.ndarray:
        """True for rows low to high and all columns where the cosine may be `least`: the estimate is unbiased, for the two codes' errors hang on rotations of
        their own, and pairs whose upper confidence bound is below `least` are decided."""
        estimate = self.rebuilt[0][low:high] @ self.rebuilt[1].T
        a, b = self.variance[0][low:high, None], self.variance[1][None]
        return estimate + sigmas * np.sqrt(a + b + a * b * self.size) >= least - 1e-5


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, fewer than n, by union-find."""
    parent = list(range(n))

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    edges = []
    for a, b in pairs.tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            parent[rb] = ra
            edges.append((a, b))
    return edges


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, miss: float = 1e-4, bucket: int = 512, sigmas: float = 5.0, seed: int = 7) -> DataFrame:
    """Link vectors of one label whose cosine in double precision is at least `least`.

    Equal vectors of a label are one node with a count. Nodes are bucketed by the largest signed coordinate after
    random rotations, several rotations to a table so that buckets of the largest label average at most `bucket`
    nodes, and as many tables as keep the chance to miss a pair at `least` below `miss`. Binary codes and their correction factors are stored with a node once.
    Buckets meet with the codes alone; of each the nodes are named that have a pair within the confidence bound. Only those nodes' vectors are fetched, and those pairs
    recomputed exactly. A pair counts in the first table where it meets, so each link is counted once without shuffling pairs; a task returns
    a count per node and a spanning forest of the links. Buckets above BLOCK nodes are split into pairs of blocks.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. Vectors
    that are null, empty or zero, hold null or non-finite components, or have a null label or vec_id link with nothing.
    Vectors of different lengths link with nothing of another length. Rows that share a vec_id are one node in
    components and separate in counts. An empty table gives an empty result; other columns are ignored.
    """
    rows = cut(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
    fine &= ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda c: c + 0.0)))
    nodes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("place", F.monotonically_increasing_id()), "nodes")
    shape = nodes.groupBy("label", F.size("v").alias("size")).agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n"))
    plans = {}
    for size, n in shape.collect():  # one row per length of vectors
        width = max(1, math.ceil(math.log(max(n / bucket, 1)) / math.log(2 * size)))
        rate = collision_rate(size, least) ** width
        plans[size] = width, max(1, math.ceil(math.log(miss) / math.log(max(1 - rate, 1e-12))))

    def place(batches: Iterable) -> Iterator:
        for batch in batches:
            for size, part in batch.groupby(batch["v"].map(len)):
                width, tables = plans[size]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                keys = []
                for table in range(tables):
                    key = np.zeros(len(x), np.int64)
                    for i in range(width):
                        key = key * (2 * size) + corner(x @ rotation(size, seed + table * width + i).T)
                    keys.append(key)
                code = encoded(unit(x), seed + CODES)
                yield pd.DataFrame({"label": part["label"], "size": size, "place": part["place"], "node": part["node"], "copies": part["copies"], "code": [c.tobytes() for c in code], "keys": list(np.stack(keys, 1))})

    kind = nodes.schema["label"].dataType.simpleString()
    placed = cut(nodes.mapInPandas(place, f"label {kind}, size int, place long, node long, copies long, code binary, keys array<long>"), "placed")
    met = placed.select("label", "size", "place", "code", "keys", F.posexplode("keys").alias("table", "key"))
    home = ["label", "size", "table", "key"]
    counted = met.groupBy(*home).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.join(counted, home)
    # Block i of a bucket goes to the pairs (i, j) and (j, i): one row a block, so one row in buckets that need no split.
    met = met.withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("tile", F.xxhash64(*home, F.least("block", "other"), F.greatest("block", "other")))
    tiles = met.select("tile", "table", "size", "place", "code", "keys", "block").repartition("tile").sortWithinPartitions("tile", "place")

    def undecided(tile: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, within the bound that belong to this tile: of both blocks where it stands for two, and not met in an earlier table."""
        size, table, block = int(tile["size"].iloc[0]), int(tile["table"].iloc[0]), tile["block"].to_numpy()
        stored = Stored(np.stack([np.frombuffer(c, np.uint8) for c in tile["code"]]), size, seed + CODES)
        keys, cross = np.stack(tile["keys"].to_numpy()), len(set(block.tolist())) > 1
        for at in range(0, len(tile), 512):
            i, j = np.nonzero(stored.undecided(at, min(at + 512, len(tile)), least, sigmas))
            i += at
            use = (i < j) & (block[i] != block[j]) if cross else i < j
            i, j = i[use], j[use]
            use = ~(keys[i, :table] == keys[j, :table]).any(1)
            yield i[use], j[use]

    def nearby(batches: Iterable) -> Iterator:
        for tile in runs(batches, "tile"):
            some = np.zeros(len(tile), bool)
            for i, j in undecided(tile) if len(tile) > 1 else ():
                some[i] = some[j] = True
            if some.any():
                yield tile[["tile", "table", "place", "block"]][some]

    asked = cut(tiles.mapInPandas(nearby, "tile long, table int, place long, block int"), "asked")
    exact = asked.join(placed.select("place", "size", "node", "copies", "code", "keys"), "place").join(nodes.select("place", "v"), "place")
    exact = exact.repartition("tile").sortWithinPartitions("tile", "place")

    def compare(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
        node, copies, x = tile["node"].to_numpy(), tile["copies"].to_numpy(), unit(np.stack(tile["v"].to_numpy()))
        count, pairs = np.zeros(len(x), np.int64), []
        for i, j in undecided(tile):
            hit = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + (1 << 16)]], x[j[a : a + (1 << 16)]]) >= least for a in range(0, len(i), 1 << 16)] or [np.zeros(0, bool)])
            i, j = i[hit], j[hit]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            pairs += forest(len(x), np.stack([i, j], 1))
        return tile["place"].to_numpy(), count, [(int(node[a]), int(node[b])) for a, b in forest(len(x), np.array(pairs).reshape(-1, 2))]

    def each(batches: Iterable) -> Iterator:
        for tile in runs(batches, "tile"):
            place, count, edges = compare(tile)
            some = count > 0
            frame = pd.DataFrame({"place": place[some], "n": count[some]})
            if len(edges):
                frame = pd.concat([frame, pd.DataFrame(edges, columns=["a", "b"])])
            if len(frame):
                yield frame.reindex(columns=["place", "n", "a", "b"]).astype("Int64")

    found = cut(exact.mapInPandas(each, "place long, n long, a long, b long"), "found")
    near = found.where("place is not null").groupBy("place").agg(F.sum("n").alias("n"))
    groups = components(found.where("a is not null").select("a", "b"))
    known = nodes.join(near, "place", "left").join(groups, "node", "left").select("label", "v", "node", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    result = rows.join(known, ["label", "v"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = {
    "op4_embedding_dedup": """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from r join l on l.a = r.other),
        k as (select a as vec_id, count(*) as n from l group by a), c as (select vec_id, min(other) as component_id from r group by vec_id)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from c left join k using (vec_id)"""
}
