"""Registered queries over volumes (embeddings as 4 x 4 x 4 images), and their SQL for DuckDB."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry
from lumenframe.operators import dose, intensity, masks, spatial, volumes

D = (4, 4, 4)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.images_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("voxels", F.col("voxels").cast("array<double>"))


def tidy(column, digits: int = 6):  # noqa: ANN001, ANN201
    """Round for comparison, without a negative zero."""
    return F.round(column, digits) + 0.0


def rows(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return volumes.voxel_rows(df, *keep).select("image_id", *keep, "x", "y", "z", tidy(F.col("value"), digits).alias("value"))


def neighbours(df: DataFrame) -> DataFrame:
    """Each image as `a` with the next id's as `b`."""
    a = df.select("image_id", F.struct(*df.columns).alias("a"))
    b = df.select((F.col("image_id") - 1).alias("image_id"), F.struct(*df.columns).alias("b"))
    return a.join(b, "image_id")


# ---- SQL parts -------------------------------------------------------------------------------------------------
VOX = """vox as (select image_id, label, f % 4 + 1 as x, f // 4 % 4 + 1 as y, f // 16 + 1 as z, f, v::double as v
    from (select vec_id as image_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as f from embeddings))"""
STATS = "st as (select image_id, avg(v) as m, stddev_samp(v) as s, min(v) as lo, max(v) as hi from vox group by image_id)"


def grid(nx: int, ny: int, nz: int, name: str = "grid") -> str:
    return f"{name} as (select x, y, z from range(1, {nx + 1}) a(x), range(1, {ny + 1}) b(y), range(1, {nz + 1}) c(z))"


def corner_fill(source: str = "vox", n: int = 4, name: str = "fills") -> str:
    return f"""{name} as materialized (select image_id, (list_sort(list(v))[4] + list_sort(list(v))[5]) / 2 as fill from {source}
        where x in (1, {n}) and y in (1, {n}) and z in (1, {n}) group by image_id)"""


def pulled(name: str, points: str, source: str = "vox", n: int = 4, mode: str = "linear", fills: str = "fills") -> str:
    """CTEs that sample `source` (n voxels an axis) at points (image_id, x, y, z, px, py, pz) into `name` (…, v)."""
    p = [f"cast(p{a} as real)::double" for a in "xyz"]
    inside = " and ".join(f"p{a} >= 1 and p{a} <= {n}" for a in "xyz")
    if mode == "round_first":
        near = f"""select image_id, x, y, z, round_even(px, 0) as qx, round_even(py, 0) as qy, round_even(pz, 0) as qz, 1.0::double as w from {name}_p"""
    elif mode == "nearest":
        near = f"""select image_id, x, y, z, round_even(px, 0) as qx, round_even(py, 0) as qy, round_even(pz, 0) as qz, 1.0::double as w from {name}_p where {inside}"""
    else:
        at = ", ".join(f"least(floor(p{a}) + d{a}, {n}) as q{a}" for a in "xyz")
        w = " * ".join(f"(case when d{a} = 1 then p{a} - floor(p{a}) else 1 - (p{a} - floor(p{a})) end)" for a in "xyz")
        near = f"select image_id, x, y, z, {at}, {w} as w from {name}_p, range(2) i(dx), range(2) j(dy), range(2) k(dz) where {inside}"
    return f"""{name}_p as materialized (select image_id, x, y, z, {p[0]} as px, {p[1]} as py, {p[2]} as pz from ({points})),
        {name}_n as materialized ({near}),
        {name}_g as materialized (select n.image_id, n.x, n.y, n.z, sum(n.w * s.v) as v from {name}_n n
            join {source} s on s.image_id = n.image_id and s.x = n.qx::bigint and s.y = n.qy::bigint and s.z = n.qz::bigint group by all),
        {name} as materialized (select p.image_id, p.x, p.y, p.z, coalesce(g.v, f.fill) as v from {name}_p p
            left join {name}_g g using (image_id, x, y, z) left join {fills} f using (image_id))"""


def rotated(points_of: str, degrees: str, centre: float) -> str:
    """Points of a rotation about z: R(degrees) (p - c) + c."""
    c, s = f"cos(radians({degrees}))", f"sin(radians({degrees}))"
    x, y = f"(x - {centre})", f"(y - {centre})"
    return f"select image_id, x, y, z, {c} * {x} - {s} * {y} + {centre} as px, {s} * {x} + {c} * {y} + {centre} as py, z as pz from {points_of}"


IDS = "ids as (select vec_id as image_id, label from embeddings)"
OUT = "select image_id, x::int as x, y::int as y, z::int as z, round({v}, {n}) + 0.0 as value from {t}"


def out(table: str, v: str = "v", digits: int = 6) -> str:
    return OUT.format(v=v, n=digits, t=table)


Q, SQL = {}, {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(query):  # noqa: ANN001, ANN202
        Q[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


# ---- model, projections ----------------------------------------------------------------------------------------
@register("voxel_grid", f"with {VOX} {out('vox')}")
def voxel_grid(spark, sf_dir):  # noqa: ANN001, ANN201
    return rows(images(spark, sf_dir))


@register("rounded_cast", f"with {VOX} select image_id, x::int as x, y::int as y, z::int as z, round_even(v * 100, 0)::int as value from vox")
def rounded_cast(spark, sf_dir):
    df = images(spark, sf_dir).withColumn("voxels", F.transform("voxels", lambda v: v.cast("double") * 100))
    return volumes.voxel_rows(df.withColumn("voxels", volumes.rounded_cast("voxels", "int"))).select("image_id", "x", "y", "z", F.col("value").cast("int").alias("value"))


@register("corners_median", f"with {VOX}, {corner_fill()} select image_id, round(fill, 6) + 0.0 as fill from fills")
def corners_median(spark, sf_dir):
    return images(spark, sf_dir).select("image_id", tidy(volumes.corners_median("voxels", "dims")).alias("fill"))


@register("one_hot_counts", f"""with {VOX}, lab as (select image_id, (round_even(abs(v) * 10, 0)::int) % 4 as c from vox)
    select l.image_id, k.k::int as channel, sum((l.c = k.k)::int)::bigint as n from lab l, range(1, 4) k(k) group by all""")
def one_hot_counts(spark, sf_dir):
    df = images(spark, sf_dir).withColumn("voxels", F.transform("voxels", lambda v: (F.rint(F.abs(v.cast("double")) * 10) % 4).cast("float")))
    return masks.one_hot(df, 3).select("image_id", "channel", F.aggregate("voxels", F.lit(0).cast("long"), lambda a, v: a + v.cast("long")).alias("n"))


# ---- normalization ---------------------------------------------------------------------------------------------
@register("zscore", f"with {VOX}, {STATS} {out('vox join st using (image_id)', '(v - m) / (s + 1e-8)', 5)}")
def zscore(spark, sf_dir):
    return rows(intensity.z_score(images(spark, sf_dir)), digits=5)


@register("zscore_masked", f"""with {VOX}, st as (select image_id, avg(v) as m, stddev_samp(v) as s from vox where v > 0 group by image_id)
    {out('vox join st using (image_id)', '(v - m) / (s + 1e-8)', 5)}""")
def zscore_masked(spark, sf_dir):
    df = images(spark, sf_dir).withColumn("mask", F.transform("voxels", lambda v: F.greatest(v, F.lit(0.0).cast("float"))))
    return rows(intensity.z_score(df, "mask"), digits=5)


@register("minmax", f"with {VOX}, {STATS} {out('vox join st using (image_id)', '(v - lo) / (hi - lo + 1e-8)')}")
def minmax(spark, sf_dir):
    return rows(intensity.min_max(images(spark, sf_dir)))


@register("rescale", f"with {VOX} {out('vox', 'v * coalesce(nullif(label, 0) + 1, 1) + label * 0.5')}")
def rescale(spark, sf_dir):
    return rows(intensity.rescale(images(spark, sf_dir), F.nullif(F.col("label"), F.lit(0)).cast("double") + 1, F.col("label") * 0.5))


@register("hist_match_pair", f"""with {VOX}, a as (select *, row_number() over (partition by image_id order by v, f) as k from vox),
    b as (select image_id - 1 as image_id, v as w, row_number() over (partition by image_id order by v, f) as k from vox)
    {out('a join b using (image_id, k)', 'w')}""")
def hist_match_pair(spark, sf_dir):
    p = neighbours(images(spark, sf_dir))
    return rows(p.select("image_id", F.col("a.dims").alias("dims"), intensity.histogram_match(F.col("a.voxels"), F.col("b.voxels")).alias("voxels")))


@register("hist_match_resized", f"""with {VOX}, a as (select *, row_number() over (partition by image_id order by v, f) as k from vox),
    b as (select image_id - 1 as image_id, list(v order by v) as t from vox where f < 27 group by image_id),
    c as (select a.*, (k - 1) * 26.0::double / 63 as p, t from a join b using (image_id))
    {out('c', 't[floor(p)::int + 1] + (p - floor(p)) * (t[least(floor(p)::int + 2, 27)] - t[floor(p)::int + 1])')}""")
def hist_match_resized(spark, sf_dir):
    p = neighbours(images(spark, sf_dir))
    return rows(p.select("image_id", F.col("a.dims").alias("dims"), intensity.histogram_match(F.col("a.voxels"), F.slice("b.voxels", 1, 27)).alias("voxels")))


MARKS = """marks as (select image_id, p, quantile_cont(v, p / 100.0::double) as m from vox, range(1, 100) q(p) where v > 0 group by image_id, p),
    goal as (select p, avg(m) as g from marks group by p)"""


@register("nyul_landmarks", f"""with {VOX}, marks as (select image_id, quantile_cont(v, [{', '.join(f'{i / 100}' for i in range(1, 100))}]) as m from vox where v > 0 group by image_id),
    flat as (select unnest(m) as m, generate_subscripts(m, 1) as k from marks) select k::int as k, round(avg(m), 6) + 0.0 as mark from flat group by k""")
def nyul_landmarks(spark, sf_dir):
    return intensity.nyul_standard(intensity.nyul_landmarks(images(spark, sf_dir))).select("k", tidy(F.col("mark")).alias("mark"))


@register("nyul_apply", f"""with {VOX}, marks as (select image_id, quantile_cont(v, [{', '.join(f'{i / 100}' for i in range(1, 100))}]) as m from vox where v > 0 group by image_id),
    flat as (select image_id, unnest(m) as m, generate_subscripts(m, 1) as k from marks),
    std as (select k, avg(m) as g from flat group by k), goal as (select list(g order by k) as g from std),
    j as (select v.*, m, g, len(list_filter(m, lambda e: e < v.v)) as below from vox v join marks using (image_id), goal),
    i as (select *, greatest(1, least(98, below)) as i from j)
    {out('i', 'case when v <= m[1] then g[1] when v >= m[99] then g[99] else (g[i + 1] - g[i]) / (m[i + 1] - m[i] + 1e-8) * v + g[i] - (g[i + 1] - g[i]) / (m[i + 1] - m[i] + 1e-8) * m[i] end', 5)}""")
def nyul_apply(spark, sf_dir):
    df = images(spark, sf_dir)
    marks = intensity.nyul_landmarks(df)
    return rows(intensity.nyul_transform(df, marks, intensity.nyul_standard(marks)), digits=5)


# ---- masks and regions -----------------------------------------------------------------------------------------
POSITIVE = "pos as (select *, case when v > 0 then v else 0 end as w from vox)"


def positive(spark, sf_dir):
    return images(spark, sf_dir).withColumn("voxels", F.transform("voxels", lambda v: F.greatest(v, F.lit(0.0).cast("float"))))


@register("barycenter", f"""with {VOX}, {POSITIVE} select image_id, {', '.join(f'round(sum(w * {a}) / sum(w), 6) + 0.0 as c{a}' for a in 'xyz')} from pos group by image_id""")
def barycenter(spark, sf_dir):
    c = masks.barycenter(positive(spark, sf_dir))
    return c.select("image_id", *(tidy(F.col(f"c{a}")).alias(f"c{a}") for a in "xyz"))


@register("max_radius", f"""with {VOX}, {POSITIVE}, c as (select image_id, sum(w * x) / sum(w) as cx, sum(w * y) / sum(w) as cy, sum(w * z) / sum(w) as cz from pos group by image_id)
    select image_id, round(sqrt(max(case when w > 0 then (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 end)), 6) + 0.0 as radius from pos join c using (image_id) group by image_id""")
def max_radius(spark, sf_dir):
    return masks.barycenter(positive(spark, sf_dir)).select("image_id", tidy(F.col("radius")).alias("radius"))


@register("mask_points", f"""with {VOX}, h as (select image_id, x, y, z, row_number() over (partition by image_id order by f) as r, count(*) over (partition by image_id) as n from vox where v > 0),
    want as (select image_id, k, case when n > 5 then round_even(1 + (k - 1) * (n - 1) / 4.0::double, 0)::int else k end as r from (select image_id, max(n) as n from h group by image_id), range(1, 6) q(k))
    select image_id, k::int as k, coalesce(x, -1)::int as x, coalesce(y, -1)::int as y, coalesce(z, -1)::int as z from want left join h using (image_id, r)""")
def mask_points(spark, sf_dir):
    return masks.mask_points(images(spark, sf_dir), 5)


@register("region_volume", f"with {VOX} select image_id, round(sum((v > 0.5)::int) * 1.0::double / 1000, 6) + 0.0 as volume_cm3 from vox group by image_id")
def region_volume(spark, sf_dir):
    return masks.region_volume(images(spark, sf_dir)).select("image_id", tidy(F.col("volume_cm3")).alias("volume_cm3"))


@register("mip", f"""with {VOX}, m as (select image_id, x, z, max(v) as v from vox group by all), t as (select image_id, quantile_cont(v, 0.995) as top from m group by image_id)
    select image_id, x::int as x, z::int as z, round(greatest(0, least(1, v / greatest(top, 1e-12))), 6) + 0.0 as value from m join t using (image_id)""")
def mip(spark, sf_dir):
    return rows(masks.projection(images(spark, sf_dir))).select("image_id", "x", "z", "value")


DEEP = "deep as (select image_id, f % 2 + 1 as x, f // 2 % 2 + 1 as y, f // 4 + 1 as z, v from vox)"


def deep(spark, sf_dir):
    """The same vectors as volumes of 16 slices of 2 x 2."""
    return volumes.images_from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), (2, 2, 16))


@register("best_slice", f"""with {VOX}, {DEEP}, s as (select image_id, z, round(sum(case when v > 0 then v else 0 end), 9) as a from deep where z - 1 between 2 and 13 group by all)
    select image_id, z::int as z, round(a, 6) + 0.0 as activity from s qualify row_number() over (partition by image_id order by a desc, z) = 1""")
def best_slice(spark, sf_dir):
    return masks.busiest_slice(deep(spark, sf_dir)).select("image_id", "z", tidy(F.col("activity")).alias("activity"))


@register("grad_mag", f"""with {VOX}, g as (select *, {', '.join(f'''case when {a} in (2, 3) then (lead(v) over (partition by image_id, {', '.join(b for b in 'xyz' if b != a)} order by {a})
    - lag(v) over (partition by image_id, {', '.join(b for b in 'xyz' if b != a)} order by {a})) / 2 else 0 end as g{a}''' for a in 'xyz')} from vox) {out('g', 'sqrt(gx * gx + gy * gy + gz * gz + 1e-8)')}""")
def grad_mag(spark, sf_dir):
    return rows(masks.gradient_magnitude(images(spark, sf_dir)))


# ---- spatial ---------------------------------------------------------------------------------------------------
@register("crop", f"with {VOX} select image_id, (x - 1)::int as x, y::int as y, (z - 2)::int as z, round(v, 6) + 0.0 as value, 1.0::double as ox, 2.0::double as oz from vox where x between 2 and 3 and y <= 3 and z >= 3")
def crop(spark, sf_dir):
    df = spatial.crop(images(spark, sf_dir), (1, 0, 2), (2, 3, 2)).withColumns({"ox": F.col("origin")[0], "oz": F.col("origin")[2]})
    return rows(df, "ox", "oz").select("image_id", "x", "y", "z", "value", "ox", "oz")


@register("pad", f"""with {VOX}, {IDS}, {grid(7, 6, 5)} select i.image_id, g.x::int as x, g.y::int as y, g.z::int as z, round(coalesce(v, -1.5), 6) + 0.0 as value, -1.0::double as ox
    from ids i cross join grid g left join vox v on v.image_id = i.image_id and v.x = g.x - 1 and v.y = g.y - 2 and v.z = g.z""")
def pad(spark, sf_dir):
    df = spatial.pad(images(spark, sf_dir), (1, 2, 0), (2, 0, 1), -1.5).withColumn("ox", F.col("origin")[0])
    return rows(df, "ox").select("image_id", "x", "y", "z", "value", "ox")


@register("pad_or_crop", f"""with {VOX}, {IDS}, {grid(7, 1, 4)} select i.image_id, g.x::int as x, g.y::int as y, g.z::int as z, round(coalesce(v, 0), 6) + 0.0 as value, -1.0::double as ox, 2.0::double as oy
    from ids i cross join grid g left join vox v on v.image_id = i.image_id and v.x = g.x - 1 and v.y = g.y + 2 and v.z = g.z""")
def pad_or_crop(spark, sf_dir):
    df = spatial.pad_or_crop(images(spark, sf_dir), (7, 1, 4)).withColumns({"ox": F.col("origin")[0], "oy": F.col("origin")[1]})
    return rows(df, "ox", "oy").select("image_id", "x", "y", "z", "value", "ox", "oy")


@register("translate", "select vec_id as image_id, 0.0::double as ox, ((vec_id % 5) * 1.0)::double as oy, 0.0::double as oz from embeddings")
def translate(spark, sf_dir):
    df = spatial.translate(images(spark, sf_dir), F.col("image_id") % 5, 2)
    return df.select("image_id", *(F.col("origin")[i].alias(f"o{a}") for i, a in enumerate("xyz")))


@register("reorient_all", f"""with {VOX}, t(code, fx, fy, fz) as (values ('RPI', 1, 0, 1), ('LPI', 0, 0, 1), ('RAI', 1, 1, 1), ('LAI', 0, 1, 1), ('RPS', 1, 0, 0), ('LPS', 0, 0, 0), ('RAS', 1, 1, 0), ('LAS', 0, 1, 0))
    select image_id, code, (case when fx = 1 then 5 - x else x end)::int as x, (case when fy = 1 then 5 - y else y end)::int as y, (case when fz = 1 then 5 - z else z end)::int as z,
        round(v, 6) + 0.0 as value, fx * 3.0::double as ox from vox, t""")
def reorient_all(spark, sf_dir):
    df = images(spark, sf_dir)
    whole = spatial.reorient(df.select("*", F.explode(F.array(*map(F.lit, geometry.CODES))).alias("code")), F.col("code")).withColumn("ox", F.col("origin")[0])
    return rows(whole, "code", "ox").select("image_id", "code", "x", "y", "z", "value", "ox")


@register("perm_search", "select vec_id as image_id, case when vec_id % 4 = 3 then '120' else '012' end as permuted, case vec_id % 4 when 0 then '000' when 1 then '100' when 2 then '011' else '000' end as reversed from embeddings")
def perm_search(spark, sf_dir):
    """Reversed axes, and for every fourth image axes that follow each other: x, y and z of `b` are y, z and x of `a`."""
    df = images(spark, sf_dir)
    one = lambda code, k: spatial.reorient(df, code).where(F.col("image_id") % 4 == k)
    turn = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda f: F.get("voxels", F.floor(f / 16).cast("int") + 4 * (f % 4) + 16 * (F.floor(f / 4) % 4).cast("int")))
    permuted = df.where(F.col("image_id") % 4 == 3).withColumn("voxels", turn)
    parts = [one("LPS", 0), one("RPS", 1), one("LAI", 2), permuted]
    turned = functools.reduce(DataFrame.union, [p.select("image_id", F.col("voxels").alias("b")) for p in parts])
    pairs = df.select("image_id", F.col("voxels").alias("a")).join(turned, "image_id")
    return spatial.match_axes(pairs, D).select("image_id", "permuted", "reversed")


@register("orientation_pairs", f"""with {VOX}, t(code, fx, fy, fz) as (values ('RPI', 1, 0, 1), ('LPI', 0, 0, 1), ('RAI', 1, 1, 1), ('LAI', 0, 1, 1), ('RPS', 1, 0, 0), ('LPS', 0, 0, 0), ('RAS', 1, 1, 0), ('LAS', 0, 1, 0)),
    p as (select a.code as source, b.code as target, (a.fx <> b.fx) as gx, (a.fy <> b.fy) as gy, (a.fz <> b.fz) as gz, b.fx as hx, b.fy as hy, b.fz as hz from t a, t b)
    select image_id, source, target, hx * 3.0::double as ox, hy * 3.0::double as oy, hz * 3.0::double as oz, round(v, 6) + 0.0 as first from p join vox on x = case when hx = 1 then 4 else 1 end and y = case when hy = 1 then 4 else 1 end and z = case when hz = 1 then 4 else 1 end""")
def orientation_pairs(spark, sf_dir):
    """All 64 pairs of orientations: the origin and the first voxel after going from one to the other."""
    codes = lambda name: F.explode(F.array(*map(F.lit, geometry.CODES))).alias(name)
    df = images(spark, sf_dir).select("*", codes("source")).select("*", codes("target"))
    done = spatial.reorient(df, F.col("source"), F.col("target"))
    return done.select("image_id", "source", "target", *(F.col("origin")[i].alias(f"o{a}") for i, a in enumerate("xyz")), tidy(F.col("voxels")[0].cast("double")).alias("first"))


@register("spacing_search", """with s as (select vec_id as image_id, ['012', '021', '102', '120', '201', '210'][vec_id % 6 + 1] as permuted from embeddings) select image_id, permuted from s""")
def spacing_search(spark, sf_dir):
    """Spacings 1, 2 and 3 in another order for each image."""
    orders = ["012", "021", "102", "120", "201", "210"]
    target = F.array(*[volumes.doubles([1.0 + int(k) for k in o]) for o in orders])[(F.col("image_id") % 6).cast("int")]
    df = images(spark, sf_dir).withColumns({"a": volumes.doubles((1, 2, 3)), "b": target})
    return df.select("image_id", spatial.match_spacing("a", "b").alias("permuted"))


@register("origin_search", """select vec_id as image_id, a::int as axis, (case when vec_id % 2 = 0 then 0 else a end)::int as spacing, (case when vec_id % 2 = 0 then 2 else 2 - a end)::int as size, a::int as origin, (vec_id % 2)::int as sign from embeddings, range(3) q(a)""")
def origin_search(spark, sf_dir):
    """Every second image's origin has moved to the other end of each axis."""
    df = images(spark, sf_dir).withColumns({"o": volumes.doubles((100, 200, 300)), "s": volumes.doubles((1, 2, 4)), "d": volumes.ints((7, 5, 3))})
    far = F.array(*[F.col("o")[i] + (F.col("image_id") % 2) * F.col("s")[i] * (F.col("d")[2 - i] - 1) for i in range(3)])
    found = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), spatial.match_origin(a, "o", "d", "s", "far").alias("m")) for a in range(3)]))
    return df.withColumn("far", far).select("image_id", found.alias("f")).select("image_id", "f.axis", "f.m.*")


def spaced(n: int, ratio: float) -> str:
    return f"select image_id, x, y, z, (x - 1) * {ratio}::double + 1 as px, (y - 1) * {ratio}::double + 1 as py, (z - 1) * {ratio}::double + 1 as pz from ids, grid"


@register("resample_spacing_linear", f"with {VOX}, {IDS}, {grid(6, 6, 6)}, {corner_fill()}, {pulled('r', spaced(6, 0.75))} {out('r', digits=5)}")
def resample_spacing_linear(spark, sf_dir):
    return rows(spatial.resample_to_spacing(images(spark, sf_dir), (0.75,) * 3, kind="double"), digits=5)


@register("resample_spacing_nearest", f"with {VOX}, {IDS}, {grid(6, 6, 6)}, {corner_fill()}, {pulled('r', spaced(6, 0.75), mode='round_first')} {out('r', digits=5)}")
def resample_spacing_nearest(spark, sf_dir):
    return rows(spatial.resample_to_spacing(images(spark, sf_dir), (0.75,) * 3, "nearest", "double"), digits=5)


def with_offset(df: DataFrame) -> DataFrame:
    """The same voxels, 1.5 mm apart from (id % 3) / 2 on."""
    origin = F.array(F.pmod("image_id", F.lit(3)) * 0.5, F.lit(-0.25), F.lit(0.0))
    return df.withColumns({"origin": origin, "spacing": volumes.doubles((1.5, 1.5, 1.5))})


@register("resample_to_image", f"""with {VOX}, {grid(4, 4, 4)}, {corner_fill()}, mov as (select image_id - 1 as image_id, x, y, z, v from vox),
    {pulled('r', '''select i.image_id, x, y, z, (x - 1 - ((i.image_id + 1) % 3) * 0.5::double) / 1.5::double + 1 as px, (y - 1 + 0.25::double) / 1.5::double + 1 as py, (z - 1) / 1.5::double + 1 as pz
        from (select distinct a.image_id from vox a join mov b on a.image_id = b.image_id) i, grid''', source='mov')} {out('r', digits=5)}""")
def resample_to_image(spark, sf_dir):
    df = images(spark, sf_dir)
    b = with_offset(df).select((F.col("image_id") - 1).alias("image_id"), F.struct("dims", "voxels", "origin", "spacing", "direction").alias("moving"))
    pairs = df.select("image_id", F.struct("dims", "voxels", "origin", "spacing", "direction").alias("fixed")).join(b, "image_id")
    done = spatial.resample_to_image(pairs, kind="double")
    return rows(done.select("image_id", F.col("fixed.dims").alias("dims"), F.col("resampled").alias("voxels")), digits=5)


@register("rotate90", f"with {VOX}, {corner_fill()}, {pulled('r', rotated('vox', '90', 3))} {out('r', digits=5)}")
def rotate90(spark, sf_dir):
    return rows(spatial.rotate(images(spark, sf_dir), 3, 90, kind="double"), digits=5)


@register("rotate45", f"with {VOX}, {corner_fill()}, {pulled('r', rotated('vox', '45', 3))} {out('r', digits=5)}")
def rotate45(spark, sf_dir):
    return rows(spatial.rotate(images(spark, sf_dir), 3, 45, kind="double"), digits=5)


@register("rotate_batched_angles", f"with {VOX}, {corner_fill()}, {pulled('r', rotated('vox', '(image_id % 4) * 25', 2).replace('sin', '-sin'))} {out('r', digits=5)}")
def rotate_batched_angles(spark, sf_dir):
    return rows(spatial.rotate_each(images(spark, sf_dir), 3, -(F.col("image_id") % 4) * 25, kind="double"), digits=5)


@register("scale_half", f"""with {VOX}, {IDS}, {grid(2, 6, 4)}, {corner_fill()},
    {pulled('r', 'select image_id, x, y, z, (x - 1) / 0.5::double + 1 as px, (y - 1) / 1.5::double + 1 as py, z as pz from ids, grid')} {out('r', digits=5)}""")
def scale_half(spark, sf_dir):
    return rows(spatial.scale(images(spark, sf_dir), (0.5, 1.5, 1.0), kind="double"), digits=5)


CHAIN = geometry.compose(geometry.affine_matrix(scale=(1.25, 0.8, 1.0)), geometry.affine_matrix(rotate=(0, 0, 30)), geometry.affine_matrix(translation=(0.3, -0.2, 0.1)))


def chain_points() -> str:
    # Back: minus translation, rotate by -30 degrees, divide by the scales; about 2.
    c, s = f"cos(radians({30}))", "sin(radians(30))"
    x, y, z = "(x - 2 - 0.3::double)", "(y - 2 + 0.2::double)", "(z - 2 - 0.1::double)"
    return f"select image_id, x, y, z, ({c} * {x} + {s} * {y}) / 1.25::double + 2 as px, (-{s} * {x} + {c} * {y}) / 0.8::double + 2 as py, {z} + 2 as pz from vox"


@register("affine_fused", f"with {VOX}, {corner_fill()}, {pulled('r', chain_points())} {out('r', digits=5)}")
def affine_fused(spark, sf_dir):
    return rows(spatial.affine(images(spark, sf_dir), CHAIN, kind="double"), digits=5)


@register("adjoint_resample", f"""with {VOX}, {IDS}, {grid(4, 4, 4)}, {corner_fill()}, {pulled('r', spaced(4, 0.75))}
    select g.image_id, g.x::int as x, g.y::int as y, g.z::int as z, round(coalesce(sum(n.w * o.v), 0), 5) + 0.0 as value
    from vox g left join r_n n on n.image_id = g.image_id and n.qx = g.x and n.qy = g.y and n.qz = g.z
    left join vox o on o.image_id = n.image_id and o.x = n.x and o.y = n.y and o.z = n.z group by g.image_id, g.x, g.y, g.z""")
def adjoint_resample(spark, sf_dir):
    back = geometry.homogeneous(0.75 * geometry.np.eye(3), [0.25] * 3)
    return rows(spatial.adjoint_sample(images(spark, sf_dir), back, D, D), digits=5)


@register("adjoint_pad", f"""with {VOX} select image_id, (x - 1)::int as x, y::int as y, z::int as z, round(v, 6) + 0.0 as value, round(rim, 5) + 0.0 as d_value
    from vox join (select image_id, sum(case when x = 1 or x = 4 then v else 0 end) as rim from vox group by image_id) using (image_id) where x in (2, 3)""")
def adjoint_pad(spark, sf_dir):
    """The gradient of padding x by one voxel at both ends: the inside, and the sum over the rim for the value."""
    df = images(spark, sf_dir)
    rim = volumes.voxel_rows(df).groupBy("image_id").agg(F.sum(F.when(F.col("x").isin(1, 4), F.col("value")).otherwise(0.0)).alias("rim"))
    return rows(spatial.crop(df, (1, 0, 0), (2, 4, 4))).join(rim, "image_id").select("image_id", "x", "y", "z", "value", tidy(F.col("rim"), 5).alias("d_value"))


# ---- dose and pipelines ----------------------------------------------------------------------------------------
@register("dose_local", f"""with {VOX}, d as (select *, v * 100 as hu, case when v * 100 <= 0 then greatest(0.01, 1 + 0.001 * (v * 100)) else 1 + 0.0007 * (v * 100) end as rho from vox)
    {out('d', f'greatest(v, 0) * 1232.3742::double / greatest(0.01, least(3.0, rho))', 5)}""")
def dose_local(spark, sf_dir):
    v = volumes.voxel_rows(images(spark, sf_dir))
    return v.select("image_id", "x", "y", "z", tidy(dose.local_dose(F.col("value"), dose.density(F.col("value") * 100)), 5).alias("value"))


@register("dose_eval", f"""with {VOX}, p as (select a.image_id, a.v * 1e9 * 8.478e-8::double / (2.0 * (1 + 0.0007 * abs(b.v)) + 1e-4) as a, b.v as b from vox a join vox b on b.image_id = a.image_id + 1 and b.f = a.f),
    k as (select *, max(b) over (partition by image_id) as peak from p)
    select image_id, round(avg(abs(a - b)), 4) + 0.0 as mae, round(corr(a, b), 5) + 0.0 as pearson, round(avg(case when b > 0.01 * peak then a - b end), 4) + 0.0 as bias from k group by image_id""")
def dose_eval(spark, sf_dir):
    p = neighbours(images(spark, sf_dir)).select("image_id", F.explode(F.arrays_zip(F.col("a.voxels").alias("v"), F.col("b.voxels").alias("w"))).alias("p"))
    v, w = F.col("p.v").cast("double"), F.col("p.w").cast("double")
    p = p.select("image_id", dose.analytical_dose(v * 1e9, 1 + 0.0007 * F.abs(w), 2.0).alias("a"), w.alias("b"))
    return dose.agreement(p, "a", "b", ["image_id"]).select("image_id", tidy(F.col("mae"), 4).alias("mae"), tidy(F.col("pearson"), 5).alias("pearson"), tidy(F.col("bias"), 4).alias("bias"))


# The window over four voxels, cos at -90, -30, 30 and 90 degrees; Gy per count.
def blend_sql(images: str, instead: str, least: float) -> str:
    """Blending of 4 x 4 x 4 cubes, two voxels apart, of 6 x 6 x 6 volumes `pv` with v: predicted as v times the cube's top, with `instead` in cubes below `least`."""
    return f"""with {VOX}, {IDS}, {grid(6, 6, 6)}, pv as ({images}), s(s) as (values (1), (3)),
        w(k, w) as (values (0, 6.123233995736766e-17::double), (1, 0.8660254037844386::double), (2, 0.8660254037844386::double), (3, 6.123233995736766e-17::double)),
        p as (select v.*, a.s as px, b.s as py, c.s as pz, wa.w * wb.w * wc.w as w from pv v join s a on a.s <= x and x < a.s + 4 join s b on b.s <= y and y < b.s + 4 join s c on c.s <= z and z < c.s + 4
            join w wa on wa.k = x - a.s join w wb on wb.k = y - b.s join w wc on wc.k = z - c.s),
        q as (select *, max(v) over (partition by image_id, px, py, pz) as top from p)
        select image_id, x::int as x, y::int as y, z::int as z, round(sum(w * case when top < {least} then {instead} else v * top end) / (sum(w) + 1e-8), 5) + 0.0 as value from q group by image_id, x, y, z"""


PADDED = "select i.image_id, g.x, g.y, g.z, coalesce(v.v, 0.0) as v from ids i cross join grid g left join vox v on v.image_id = i.image_id and v.x = g.x - 1 and v.y = g.y - 1 and v.z = g.z - 1"


@register("patch_blend", blend_sql(PADDED, "v * 1e9::double * 8.478e-8::double / (2.0::double * (1 + 0.0007::double * abs(v)) + 1e-4::double)", 0.3))
def patch_blend(spark, sf_dir):
    """Cubes of low activity take the analytical dose of their counts and density."""
    df = as_double(spatial.pad(images(spark, sf_dir), (1, 1, 1), (1, 1, 1))).withColumn("rho", F.transform("voxels", lambda v: 1 + 0.0007 * F.abs(v)))
    return rows(dose.blend_patches(df, 4, 2, lambda cube, rho: cube * cube.max(), lambda cube, rho: cube * 1e9 * dose.GRAY / (2.0 * rho + 1e-4), 0.3, ("rho",)), digits=5)


def stats_sql(img: str, mask: str, name: str) -> str:
    return f"{name} as (select i.image_id, count(*) as n, avg(i.v) as mean from {img} i join {mask} m using (image_id, x, y, z) where m.v <> 0 group by i.image_id)"


@register("suv_consistency_pipeline", f"""with {VOX}, {IDS}, {grid(6, 6, 6)}, act as (select image_id, x, y, z, abs(v) + 1 as v from vox), mask as (select image_id, x, y, z, (v > 0)::int::double as v from vox),
    {corner_fill('act', 4, 'fa')}, {corner_fill('mask', 4, 'fm')}, {stats_sql('act', 'mask', 's0')},
    {pulled('a1', spaced(6, 0.75), 'act', 4, 'linear', 'fa')}, {pulled('m1', spaced(6, 0.75), 'mask', 4, 'round_first', 'fm')},
    {corner_fill('a1', 6, 'fa1')}, {corner_fill('m1', 6, 'fm1')},
    {pulled('a2', rotated('a1', '45', 4), 'a1', 6, 'linear', 'fa1')}, {pulled('m2', rotated('m1', '45', 4), 'm1', 6, 'nearest', 'fm1')}, {stats_sql('a2', 'm2', 's1')}
    select i.image_id, round(coalesce(s0.mean, 0), 5) + 0.0 as mean_before, round(coalesce(s1.mean, 0), 5) + 0.0 as mean_after,
        round(abs(coalesce(s1.mean, 0) - coalesce(s0.mean, 0)) / (coalesce(s0.mean, 0) + 1e-9) * 100, 4) + 0.0 as deviation,
        round(abs(coalesce(s1.n, 0) * 0.421875 - coalesce(s0.n, 0)) / (coalesce(s0.n, 0) + 1e-9) * 100, 4) + 0.0 as volume_deviation, 7.5::double as ox
    from ids i left join s0 using (image_id) left join s1 using (image_id)""")
def suv_consistency_pipeline(spark, sf_dir):
    """Mean uptake and volume of a region before and after resampling, rotating and translating image and mask."""
    df = as_double(images(spark, sf_dir))
    act = df.withColumn("voxels", F.transform("voxels", lambda v: F.abs(v) + 1))
    mask = df.withColumn("voxels", F.transform("voxels", lambda v: (v > 0).cast("int").cast("double")))
    moved = lambda d, a, b: spatial.translate(spatial.rotate(spatial.resample_to_spacing(d, (0.75,) * 3, mode=a, kind="double"), 3, 45, mode=b, kind="double"), 10, 1)

    def stats(image: DataFrame, region: DataFrame, name: str) -> DataFrame:
        pairs = image.select("image_id", "origin", F.col("voxels").alias("v")).join(region.select("image_id", F.col("voxels").alias("m")), "image_id")
        picked = F.filter(F.arrays_zip("v", "m"), lambda p: p["m"] != 0)
        pairs = pairs.select("image_id", F.col("origin")[0].alias("ox"), picked.alias("p")).withColumn("n", F.size("p"))
        mean = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["v"]) / F.col("n")
        return pairs.select("image_id", F.col("ox").alias(f"ox{name}"), F.col("n").alias(f"n{name}"), F.when(F.col("n") > 0, mean).otherwise(0.0).alias(f"mean{name}"))

    both = stats(act, mask, "0").join(stats(moved(act, "linear", "linear"), moved(mask, "nearest", "nearest"), "1"), "image_id")
    change = lambda a, b: F.abs(a - b) / (b + 1e-9) * 100
    return both.select(
        "image_id", tidy(F.col("mean0"), 5).alias("mean_before"), tidy(F.col("mean1"), 5).alias("mean_after"), tidy(change(F.col("mean1"), F.col("mean0")), 4).alias("deviation"),
        tidy(change(F.col("n1") * 0.421875, F.col("n0")), 4).alias("volume_deviation"), F.col("ox1").alias("ox"),
    )


def suv_sql(mask: str, pair: str) -> str:
    return f"""with {VOX}, {IDS}, p as (select i.image_id, i.label, i.v as v, m.v as m from vox i join vox m on {pair} and m.f = i.f),
        s as (select image_id, any_value(label) as label, sum(({mask})::int) as n, sum(case when {mask} then v end) as t from p group by image_id)
        select image_id, n::int as n_voxels, round(coalesce(case when n = 0 then 0 else t * (50 + label) / 100 end, 0), 5) + 0.0 as total,
            round(coalesce(case when n = 0 then 0 else t * (50 + label) / 100 / n end, 0), 5) + 0.0 as mean from s"""


def suv_of(pairs: DataFrame) -> DataFrame:
    done = masks.masked_stats(pairs, "v", "m", (F.col("label") + 50) / 100)
    return done.select("image_id", "n_voxels", tidy(F.col("total"), 5).alias("total"), tidy(F.col("mean"), 5).alias("mean"))


def zero_below(column: str, least: float):  # noqa: ANN201
    return F.transform(column, lambda v: F.when(v > least, v).otherwise(0.0).cast("float"))


@register("masked_suv_stats", suv_sql("v > 0.1::float", "m.image_id = i.image_id"))
def masked_suv_stats(spark, sf_dir):
    df = images(spark, sf_dir)
    return suv_of(df.select("image_id", "label", F.col("voxels").alias("v"), zero_below("voxels", 0.1).alias("m")))


@register("masked_suv_shared_mask", suv_sql("m > 0.1::float", "m.image_id = 0"))
def masked_suv_shared_mask(spark, sf_dir):
    df = images(spark, sf_dir)
    shared = df.where("image_id = 0").select(zero_below("voxels", 0.1).alias("m"))  # one row
    return suv_of(df.select("image_id", "label", F.col("voxels").alias("v")).crossJoin(F.broadcast(shared)))


@register("masked_suv_pairs", suv_sql("m > 0.1::float", "m.image_id = i.image_id + 1"))
def masked_suv_pairs(spark, sf_dir):
    p = neighbours(images(spark, sf_dir))
    return suv_of(p.select("image_id", F.col("a.label").alias("label"), F.col("a.voxels").alias("v"), F.col("b.voxels").alias("b")).withColumn("m", zero_below("b", 0.1)))


# ---- kernels without SQL ---------------------------------------------------------------------------------------
# Coefficients of a spline through four voxels, by hand: the ends are voxels, the inner two solve (1, 4, 1) / 6, and one beyond each end goes on in a straight line.
SPLINE = """b(e, i, w) as (values (1, 1, 1.0::double), (4, 4, 1.0::double), (2, 1, -4 / 15.0::double), (2, 2, 24 / 15.0::double), (2, 3, -6 / 15.0::double), (2, 4, 1 / 15.0::double),
        (3, 1, 1 / 15.0::double), (3, 2, -6 / 15.0::double), (3, 3, 24 / 15.0::double), (3, 4, -4 / 15.0::double), (0, 1, 34 / 15.0::double), (0, 2, -24 / 15.0::double), (0, 3, 6 / 15.0::double), (0, 4, -1 / 15.0::double),
        (5, 1, -1 / 15.0::double), (5, 2, 6 / 15.0::double), (5, 3, -24 / 15.0::double), (5, 4, 34 / 15.0::double)),
    pl as (select n, p, least(floor(p), 3)::int as low, p - least(floor(p), 3) as t from (select n, (n - 1) * 0.75::double + 1 as p from range(1, 7) r(n))),
    sh as (select n, low - 1 + j as e, case j when 0 then (1 - t) ** 3 / 6 when 1 then (3 * t ** 3 - 6 * t ** 2 + 4) / 6 when 2 then (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6 else t ** 3 / 6 end as s from pl, range(4) k(j) where p <= 4),
    a as (select n, i, sum(s * w) as w from sh join b using (e) group by n, i)"""


@register("bspline_resample", f"""with {VOX}, {IDS}, {grid(6, 6, 6)}, {corner_fill()}, {SPLINE},
    q as (select v.image_id, ax.n as x, ay.n as y, az.n as z, sum(ax.w * ay.w * az.w * v.v) as v from vox v join a ax on ax.i = v.x join a ay on ay.i = v.y join a az on az.i = v.z group by all)
    select i.image_id, g.x::int as x, g.y::int as y, g.z::int as z, round(coalesce(q.v, f.fill), 6) + 0.0 as value from ids i cross join grid g join fills f using (image_id) left join q on q.image_id = i.image_id and q.x = g.x and q.y = g.y and q.z = g.z""")
def bspline_resample(spark, sf_dir):
    return rows(spatial.resample_to_spacing(images(spark, sf_dir), (0.75,) * 3, "cubic", "double"))


KERNEL = """t as (select a - 3 as dx, b - 3 as dy, c - 3 as dz, sqrt(((a - 3) ** 2 + (b - 3) ** 2 + (c - 3) ** 2)::double) as r from range(7) i(a), range(7) j(b), range(7) l(c)),
    k0 as (select *, exp(-(r * r) / 0.72::double) as near, exp(-0.01::double * r) / (4 * pi() * greatest(r, 0.5) ** 2) as far from t),
    k1 as (select dx, dy, dz, near / sum(near) over () + far / sum(far) over () as w from k0), k as (select dx, dy, dz, w / sum(w) over () as w from k1)"""


@register("dpk_convolve", f"""with {VOX}, {POSITIVE}, {KERNEL} select p.image_id, (p.x + dx)::int as x, (p.y + dy)::int as y, (p.z + dz)::int as z, round(sum(p.w * k.w), 6) + 0.0 as value
    from pos p, k where p.x + dx between 1 and 4 and p.y + dy between 1 and 4 and p.z + dz between 1 and 4 group by all""")
def dpk_convolve(spark, sf_dir):
    return rows(dose.point_kernel_dose(positive(spark, sf_dir)))
