"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, cut, documents

#: Rounds of the permutation of a cell's blocks, and the modulus of its pseudo-random bits.
ROUNDS, PRIME = 8, (1 << 31) - 1


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: give the seats of each group to the highest quotients votes / (2k + 1).

    parties: one row per (group, party). A party's final seats lie within M * votes / (2 * all votes) + 1/2 of
    its exact share, M being the parties of the group; seats below that window are sure, and only the
    quotients inside it (about 4 M rows a group) are ranked. Ties go to the smaller party.
    Returns (group, party, quota long).
    """
    whole = Window.partitionBy(group)
    p = parties.select(group, party, F.col(votes).cast("double").alias("v"), F.col(seats).cast("long").alias("n"))
    p = p.withColumns({"all": F.sum("v").over(whole), "m": F.count("*").over(whole)})
    share = F.col("v") * F.col("n") / F.col("all")
    slack = F.col("m") * F.col("v") / (2 * F.col("all")) + 0.5
    some = F.col("v") > 0
    p = p.withColumns({
        "low": F.when(some, F.greatest(F.lit(0), F.floor(share - slack))).otherwise(0).cast("long"),
        "high": F.when(some, F.ceil(share + slack) + 1).otherwise(0).cast("long"),
    })
    k = p.select(group, party, "v", "n", "low", F.explode_outer(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1))).alias("k"))
    by_quotient = Window.partitionBy(group).orderBy(F.desc_nulls_last(F.col("v") / (2 * F.col("k") + 1)), F.col(party), F.col("k"))
    sure = F.sum(F.when(F.col("k") == F.col("low"), F.col("low")).otherwise(0)).over(whole)
    won = F.col("k").isNotNull() & (F.row_number().over(by_quotient) <= F.col("n") - sure)
    return k.select(group, party, "low", won.cast("long").alias("won")).groupBy(group, party).agg((F.max("low") + F.sum("won")).alias("quota"))


#: Whether block {c} of a round changes places, as SQL of both engines: one bit of a product in 62 bits.
_BIT_SQL = f"(({{c}} * 1103515245 + key) % {PRIME}) % 4096 >= 2048"


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 32,
    cells: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """How many words a weighted mix takes of each document.

    A document's size is its number of words. Sources, in code-point order with null last, weigh `weights`,
    repeating. Together they get share * all words; a source's target stops at cap * its size and the excess is
    reshared by weight. Each source is dealt by a seeded hash into cells (shards), about `cells` in all and in
    proportion to size, and a cell's words form a stream cut into equal blocks of about block_words. Targets
    become block quotas for sources, then for a source's cells, by Sainte-Lague. A quota takes the cell's stream
    whole as often as it goes in; the rest are the blocks that a seeded permutation puts first: a swap-or-not shuffle, in each of whose
    rounds block k and block (key - k) mod blocks change places or don't, by a bit drawn for the larger of both.

    Returns doc_id, source, size, source_size, target, taken (repeats counted, never above cap * size). Null or wordless texts have size 0 and nothing is taken of them. A null source is a source; rows with
    the same doc_id are separate documents; null doc_ids count as one id; an empty table gives an empty result;
    other columns are ignored. share must not exceed cap.
    """
    base = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")), "sizes")

    # One row per source from here; the windows without a partition run over these alone.
    one = Window.partitionBy("one")
    s = base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    s = s.withColumn("rank", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"limit": cap * F.col("source_size"), "pot": share * F.sum("source_size").over(one)})
    # Fill by weight: in the order of limit per weight, the first source that the level doesn't reach fixes the level.
    up = one.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("pot") - F.coalesce(F.sum("limit").over(up), F.lit(0.0))
    weight_left = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    s = s.withColumn("level", left / weight_left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))
    s = s.withColumn("target", F.round(F.least("limit", F.coalesce(F.min(fits).over(one)["level"] * F.col("weight"), F.col("limit"))), 6))
    s = s.withColumns({"blocks": F.rint(F.sum("target").over(one) / block_words).cast("long"), "n_cells": F.greatest(F.lit(1), F.ceil(F.try_divide(cells * F.col("source_size"), F.sum("source_size").over(one)))).cast("long")})
    s = cut(s, "sources")
    s = s.join(apportion(s, "one", "rank", "target", "blocks").select("rank", F.col("quota").alias("source_quota")), "rank")

    rows = base.join(s.select(F.col("source").alias("of"), "rank", "n_cells", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("cell", F.col("rank") * 1_000_000_000 + F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("n_cells"))
    held = rows.groupBy("cell", "rank").agg(F.sum("size").alias("cell_size")).join(s.select("rank", "source_quota"), "rank")
    quotas = apportion(held, "rank", "cell", "cell_size", "source_quota")
    plan = held.join(quotas.select("cell", "quota"), "cell").where("cell_size > 0")
    words = F.least(F.col("quota") * block_words, (cap * F.col("cell_size")).cast("long"))
    plan = plan.select("cell", "cell_size", F.floor(words / F.col("cell_size")).cast("long").alias("passes"), words.alias("words"), F.greatest(F.lit(1), F.rint(F.col("cell_size") / block_words)).cast("long").alias("nb"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("cell").cast("string"))), 1, 8), 16, 10).cast("long").alias("shift"))
    plan = plan.withColumn("picked", F.rint((F.col("words") - F.col("passes") * F.col("cell_size")) * F.col("nb") / F.col("cell_size")).cast("long")).drop("words")
    plan = plan.withColumn("keys", F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: (F.col("shift") * (2 * i + 1) * 7919 + i * 104729) % F.lit(PRIME))).drop("shift")

    before = Window.partitionBy("cell").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.where("size > 0").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    placed = placed.join(plan, "cell")
    taken = F.expr(
        f"""passes * size + aggregate(
            sequence(((start + 1) * nb - 1) div cell_size, ((start + size) * nb - 1) div cell_size), 0L,
            (sum, k) -> sum + if(picked > 0 and aggregate(keys, k, (x, key) -> if({_BIT_SQL.format(c="greatest(x, (key + nb - x % nb) % nb)")}, (key + nb - x % nb) % nb, x)) < picked,
                least(start + size, ((k + 1) * cell_size) div nb) - greatest(start, (k * cell_size) div nb), 0L))"""
    )
    result = ("doc_id", "source", "size", "source_size", "target")
    return placed.select(*result, taken.cast("long").alias("taken")).union(rows.where("size = 0").select(*result, F.lit(0).cast("long")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(name: str, parties: str, group: str, party: str, votes: str, seats: str) -> str:
    """CTEs that end in `name` (group, party, quota)."""
    return f"""{name}_p as (select {group}, {party}, {votes}::double as v, {seats}::bigint as n, sum({votes}::double) over (partition by {group}) as a, count(*) over (partition by {group}) as m from {parties}),
        {name}_w as (select *, case when v > 0 then greatest(0, floor(v * n / a - (m * v / (2 * a) + 0.5))) else 0 end::bigint as low, case when v > 0 then ceil(v * n / a + (m * v / (2 * a) + 0.5)) + 1 else 0 end::bigint as high from {name}_p),
        {name}_s as (select {group}, sum(low) as sure from {name}_w group by {group}),
        {name}_k as (select {group}, {party}, v, n, unnest(range(low, high)) as k from {name}_w),
        {name}_r as (select k.*, row_number() over (partition by {group} order by v / (2 * k + 1) desc, {party}, k) <= n - sure as won from {name}_k k join {name}_s using ({group})),
        {name} as (select w.{group}, w.{party}, any_value(w.low) + coalesce(sum(r.won::int), 0)::bigint as quota from {name}_w w left join {name}_r r using ({group}, {party}) group by all)"""


ORACLE_SQL = {
    "op5_mix_sources": f"""with b as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5('17:' || coalesce(doc_id::varchar, '')) as key from documents),
        s0 as (select source, sum(size)::bigint as source_size, 1 as one from b group by source),
        s1 as (select *, row_number() over (order by source nulls last) as rank from s0),
        s2 as (select *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::double as weight, 2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as pot from s1),
        s3 as (select *, (pot - coalesce(sum(cap) over up, 0)) / (sum(weight) over () - coalesce(sum(weight) over up, 0)) as level from s2 window up as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
        water as (select arg_min(level, struct_pack(r := cap / weight, k := rank)) as level from s3 where level * weight <= cap),
        s4 as (select s3.*, round(least(cap, coalesce(water.level * weight, cap)), 6) as target from s3, water),
        s5 as (select *, round_even(sum(target) over () / 32, 0)::bigint as blocks, greatest(1, ceil(1024.0::double * source_size / sum(source_size) over ()))::bigint as n_cells from s4),
        {_apportion_sql("q1", "s5", "one", "rank", "target", "blocks")},
        d as (select doc_id, size, key, source_size, target, s5.rank, s5.rank * 1000000000 + ('0x' || substr(key, 1, 8))::bigint % n_cells as cell from b join s5 on b.source is not distinct from s5.source),
        held as (select cell, d.rank, sum(size)::bigint as cell_size, any_value(q1.quota) as source_quota from d join q1 on q1.rank = d.rank group by cell, d.rank),
        {_apportion_sql("q2", "held", "rank", "cell", "cell_size", "source_quota")},
        plan0 as (select held.cell, cell_size, least(quota * 32, (2.0 * cell_size)::bigint) as words, greatest(1, round_even(cell_size / 32.0::double, 0))::bigint as nb, ('0x' || substr(md5('17/' || held.cell::varchar), 1, 8))::bigint as shift
            from held join q2 on q2.cell = held.cell where cell_size > 0),
        plan as (select *, list_transform(range(1, {ROUNDS + 1}), lambda i: (shift * (2 * i + 1) * 7919 + i * 104729) % {PRIME}) as keys, words // cell_size as passes, round_even(((words - words // cell_size * cell_size) * nb)::double / cell_size, 0)::bigint as picked from plan0),
        placed as (select *, coalesce(sum(size) over (partition by cell order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d where size > 0)
        select doc_id, size, source_size, target, (passes * size + list_sum(list_transform(range(((start + 1) * nb - 1) // cell_size, ((start + size) * nb - 1) // cell_size + 1),
            lambda k: case when picked > 0 and list_reduce(list_prepend(k, keys), lambda x, key: case when {_BIT_SQL.format(c="greatest(x, (key + nb - x % nb) % nb)")} then (key + nb - x % nb) % nb else x end) < picked then least(start + size, ((k + 1) * cell_size) // nb) - greatest(start, (k * cell_size) // nb) else 0 end)))::bigint as taken
        from placed join plan using (cell) union all select doc_id, size, source_size, target, 0::bigint from d where size = 0"""
}
