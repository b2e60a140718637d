"""Seeded noise: draws depend on a row's key and the seed alone, so tasks that run again draw the same."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, draw: int) -> Column:
    """Uniform in (0, 1)."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(draw)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def gaussian(key: Column, seed: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, seed, 0))) * F.cos(2 * math.pi * uniform(key, seed, 1))


def lognormal(value: Column, key: Column, sigma: float, seed: int) -> Column:
    """value * exp(sigma z - sigma^2 / 2): the mean is kept; nulls and NaN stay."""
    return value * F.exp(sigma * gaussian(key, seed) - sigma * sigma / 2)


#: Events that are drawn at once; a row with more of them is drawn by a generator of its own.
EVENTS = 1 << 20


def kept_events(counts: np.ndarray, keys: np.ndarray, share: float, seed: int) -> np.ndarray:
    """How many of each row's events a hash of (key, number of the event, seed) keeps; rows go in lots of about EVENTS events."""
    out, big = np.zeros(len(counts), np.int64), counts > EVENTS
    for i in np.flatnonzero(big):
        out[i] = np.random.default_rng([seed, int(keys[i]) & (2**63 - 1)]).binomial(int(counts[i]), share)
    small = np.flatnonzero(~big & (counts > 0))
    lots = np.cumsum(counts[small]) // EVENTS
    for lot in np.unique(lots):
        rows = small[lots == lot]
        n = counts[rows]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = np.repeat(mixed(keys[rows].astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))), n) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hit = (mixed(x) >> np.uint64(11)).astype(float) / (1 << 53) < share
        out[rows] = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def thinned(count: Column, key: Column, share: float, seed: int) -> Column:
    """Keep each of `count` events with probability `share`; nulls stay, negative counts keep none. Each event's draw is a hash of the row's key and its number."""

    @F.pandas_udf("long")
    def draw(n: pd.Series, k: pd.Series) -> pd.Series:
        there = n.notna() & k.notna()
        kept = kept_events(n[there].to_numpy(np.int64), k[there].to_numpy(np.int64), share, seed)
        return pd.Series(kept, index=n.index[there]).reindex(n.index).astype("Int64")

    return draw(count, key)
