"""Registered queries over bricks, points and chains, and their SQL for DuckDB: the same rows as whole volumes give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry
from lumenframe.operators import bricks, chain, points, spatial, volumes
from lumenframe.plans import volume_queries as v
from lumenframe.plans.volume_queries import IDS, VOX, as_double, corner_fill, grid, images, out, pulled, rows, tidy

Q, SQL = {}, {}
#: Uneven bricks, so that most neighbours of a voxel lie in others.
SIDE = (2, 3, 2)


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(query):  # noqa: ANN001, ANN202
        Q[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def cut(df: DataFrame) -> DataFrame:
    return bricks.split(as_double(df), SIDE)


@register("bricks_resample", v.SQL["resample_spacing_linear"])
def bricks_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(bricks.join(bricks.resample_to_spacing(cut(images(spark, sf_dir)), (0.75,) * 3, kind="double")), digits=5)


@register("bricks_resample_nearest", v.SQL["resample_spacing_nearest"])
def bricks_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(bricks.join(bricks.resample_to_spacing(cut(images(spark, sf_dir)), (0.75,) * 3, "nearest", kind="double")), digits=5)


@register("bricks_rotate", v.SQL["rotate45"])
def bricks_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(bricks.join(bricks.rotate(cut(images(spark, sf_dir)), 3, 45, kind="double")), digits=5)


@register("bricks_gradient", v.SQL["grad_mag"])
def bricks_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(bricks.join(bricks.gradient_magnitude(cut(images(spark, sf_dir)))))


@register("bricks_convolve", v.SQL["dpk_convolve"])
def bricks_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(bricks.join(bricks.point_kernel_dose(cut(v.positive(spark, sf_dir)), (1, 1, 1))))


@register("bricks_blend", v.blend_sql(v.PADDED, "v", 0.3))
def bricks_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = spatial.pad(images(spark, sf_dir), (1, 1, 1), (1, 1, 1))
    return rows(bricks.join(bricks.blend_patches(cut(padded), 4, 2, lambda cube: cube * cube.max(), skip_below=0.3)), digits=5)


@register("bricks_sums", f"with {VOX} select image_id, count(*) as n, round(sum(v), 6) + 0.0 as total, round(min(v), 6) + 0.0 as low, round(max(v), 6) + 0.0 as high from vox group by image_id")
def bricks_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bricks.voxel_sums(cut(images(spark, sf_dir))).select("image_id", "n", *(tidy(F.col(c)).alias(c) for c in ("total", "low", "high")))


# ---- points ----------------------------------------------------------------------------------------------------
# A point for every event, in the volume whose id is the event's modulo 400, some of them outside; voxels are 1, 1.25 and 2 mm apart.
EVENT_POINTS = """ev as (select event_id % 400 as image_id, event_id as point, 0.5::double + (event_id % 83) / 20.0::double as px, 0.75::double + (event_id % 79) / 16.0::double as py, 0.5::double + (event_id % 71) / 8.0::double as pz,
    sqrt(value) as g from events where event_id % 400 in (select vec_id from embeddings))"""
INDEX = "px, (py - 1) / 1.25::double + 1 as py, (pz - 1) / 2.0::double + 1 as pz"
CORNERS = f"""{EVENT_POINTS}, ix as (select image_id, point, g, cast(px as real)::double as px, cast(py as real)::double as py, cast(pz as real)::double as pz from (select image_id, point, g, {INDEX} from ev)),
    co as (select *, px - floor(px) as ax, py - floor(py) as ay, pz - floor(pz) as az, least(floor(px) + dx, 4)::bigint as qx, least(floor(py) + dy, 4)::bigint as qy, least(floor(pz) + dz, 4)::bigint as qz,
        px between 1 and 4 and py between 1 and 4 and pz between 1 and 4 as inside from ix, range(2) i(dx), range(2) j(dy), range(2) k(dz)),
    cw as (select *, case dx when 1 then ax else 1 - ax end as wx, case dy when 1 then ay else 1 - ay end as wy, case dz when 1 then az else 1 - az end as wz from co)"""


def wide_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(images(spark, sf_dir)).withColumn("spacing", volumes.doubles((1, 1.25, 2)))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((e % 400).alias("image_id"), e.alias("point"), (0.5 + e % 83 / 20).alias("px"), (0.75 + e % 79 / 16).alias("py"), (0.5 + e % 71 / 8).alias("pz"), F.sqrt("value").alias("g"))


def sampled_sql(mode: str) -> str:
    at = f"select image_id, point as x, 0 as y, 0 as z, {INDEX} from ev"
    return f"with {VOX}, {IDS}, {EVENT_POINTS}, fills as (select image_id, -7.0::double as fill from ids), {pulled('r', at, mode=mode)} select image_id, x as point, round(v, 5) + 0.0 as value from r"


def at_points(df: DataFrame) -> DataFrame:
    return df.select("image_id", "point", tidy(F.col("value"), 5).alias("value"))


@register("sample_points", sampled_sql("linear"))
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(points.sample_points(bricks.split(wide_images(spark, sf_dir), SIDE), event_points(spark, sf_dir), fill=-7.0))


@register("sample_points_nearest", sampled_sql("nearest"))
def sample_points_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_points(points.sample_points(wide_images(spark, sf_dir), event_points(spark, sf_dir), "nearest", -7.0))


@register("point_gradients", f"""with {VOX}, {CORNERS}, s as (select c.image_id, point, any_value(g) as g, sum(v * (2 * dx - 1) * wy * wz) as sx, sum(v * (2 * dy - 1) * wx * wz) as sy, sum(v * (2 * dz - 1) * wx * wy) as sz
        from cw c join vox v on v.image_id = c.image_id and v.x = qx and v.y = qy and v.z = qz where inside group by c.image_id, point)
    select e.image_id, e.point, round(coalesce(s.g * sx, 0), 5) + 0.0 as dx, round(coalesce(s.g * sy / 1.25::double, 0), 5) + 0.0 as dy, round(coalesce(s.g * sz / 2.0::double, 0), 5) + 0.0 as dz from ev e left join s using (image_id, point)""")
def point_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points.point_gradients(bricks.split(wide_images(spark, sf_dir), SIDE), event_points(spark, sf_dir), "g")
    return found.select("image_id", "point", *(tidy(F.col(c), 5).alias(c) for c in ("dx", "dy", "dz")))


@register("voxel_gradients", f"with {CORNERS} select image_id, qx::int as x, qy::int as y, qz::int as z, round(sum(wx * wy * wz * g), 5) + 0.0 as value from cw where inside and wx * wy * wz * g <> 0 group by all")
def voxel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points.voxel_gradients(wide_images(spark, sf_dir), event_points(spark, sf_dir), "g")
    return found.select("image_id", "x", "y", "z", tidy(F.col("value"), 5).alias("value"))


@register("coordinates_gradient", f"""with {VOX} select image_id, n::int as n, round(case (n - 1) % 4 when 0 then sum(g * (x - 2)) when 1 then sum(g * (y - 2)) when 2 then sum(g * (z - 2)) else sum(g) end, 5) + 0.0 as value
    from (select *, case (n - 1) // 4 when 0 then v when 1 then v * v else v * label end as g from vox, range(1, 13) k(n)) group by image_id, n""")
def coordinates_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = as_double(images(spark, sf_dir))
    g = volumes.voxel_rows(df, "label").select("image_id", "x", "y", "z", F.col("value").alias("gx"), (F.col("value") * F.col("value")).alias("gy"), (F.col("value") * F.col("label")).alias("gz"))
    found = points.coordinates_gradient(g, df).select("image_id", F.posexplode("d_matrix").alias("n", "value"))
    return found.select("image_id", (F.col("n") + 1).cast("int").alias("n"), tidy(F.col("value"), 5).alias("value"))


TURNED = """select image_id, x, y, z, v * v as g, cos(radians(30)) * (x - 2) - sin(radians(30)) * (y - 2) + 2.25 as px, sin(radians(30)) * (x - 2) + cos(radians(30)) * (y - 2) + 2 as py, 0.75::double * (z - 2) + 2 as pz from vox"""


@register("matrix_gradient_turned", f"""with {VOX}, ix as (select image_id, x, y, z, g, cast(px as real)::double as px, cast(py as real)::double as py, cast(pz as real)::double as pz from ({TURNED})),
    co as (select *, px - floor(px) as ax, py - floor(py) as ay, pz - floor(pz) as az, least(floor(px) + dx, 4)::bigint as qx, least(floor(py) + dy, 4)::bigint as qy, least(floor(pz) + dz, 4)::bigint as qz
        from ix, range(2) i(dx), range(2) j(dy), range(2) k(dz) where px between 1 and 4 and py between 1 and 4 and pz between 1 and 4),
    cw as (select *, case dx when 1 then ax else 1 - ax end as wx, case dy when 1 then ay else 1 - ay end as wy, case dz when 1 then az else 1 - az end as wz from co),
    s as (select c.image_id, c.x, c.y, c.z, any_value(g) as g, sum(v * (2 * dx - 1) * wy * wz) as sx, sum(v * (2 * dy - 1) * wx * wz) as sy, sum(v * (2 * dz - 1) * wx * wy) as sz
        from cw c join vox v on v.image_id = c.image_id and v.x = qx and v.y = qy and v.z = qz group by c.image_id, c.x, c.y, c.z),
    m as (select image_id, n, g * case (n - 1) // 4 when 0 then sx when 1 then sy else sz end * case (n - 1) % 4 when 0 then x - 2 when 1 then y - 2 when 2 then z - 2 else 1 end as d from s, range(1, 13) r(n))
    select i.vec_id as image_id, r.n::int as n, round(coalesce(sum(d), 0), 5) + 0.0 as value from embeddings i cross join range(1, 13) r(n) left join m on m.image_id = i.vec_id and m.n = r.n group by i.vec_id, r.n""")
def matrix_gradient_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    pull = geometry.homogeneous(geometry.rotation(3, 30) @ np.diag([1, 1, 0.75]), (0.25, 0, 0))
    df = as_double(images(spark, sf_dir)).withColumn("g", F.transform("voxels", lambda v: v * v))
    found = spatial.matrix_gradient(df, "g", pull, (2, 2, 2)).select("image_id", F.posexplode("d_matrix").alias("n", "value"))
    return found.select("image_id", (F.col("n") + 1).cast("int").alias("n"), tidy(F.col("value"), 5).alias("value"))


@register("adjoint_reorient", f"""with {VOX}, t as (select image_id, x, y, z, case when image_id % 2 = 0 then 5 - x else x end as gx, case when image_id % 2 = 0 then 5 - y else y end as gy, z as gz, v from vox)
    select image_id, x::int as x, y::int as y, z::int as z, round(v * (gx + 10 * gy + 100 * gz), 5) + 0.0 as value, 0.0::double as ox from t""")
def adjoint_reorient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of a weighted sum of reoriented voxels, brought back: every second image turned to RAS, the weights being the new positions; times the voxel itself."""
    df = as_double(images(spark, sf_dir))
    turned = spatial.reorient(df, F.when(F.col("image_id") % 2 == 0, "RAS").otherwise("LPS"))
    weights = F.transform("voxels", lambda v, f: (f % 4 + 1) + 10.0 * (F.floor(f / 4) % 4 + 1) + 100.0 * (F.floor(f / 16) + 1))
    back = spatial.adjoint_reorient(turned.withColumn("voxels", weights), "LPS")
    met = df.select("image_id", F.col("voxels").alias("v")).join(back.withColumnRenamed("voxels", "g"), "image_id").withColumn("voxels", F.zip_with("v", "g", lambda v, g: v * g))
    return rows(met.withColumn("ox", F.col("origin")[0]), "ox", digits=5)


# ---- chains ----------------------------------------------------------------------------------------------------
# New positions of the last grid, through spacing and scale, turned by 45 degrees about position 3.
CHAINED = """select image_id, x, y, z, cos(radians(45)) * (a - 3) - sin(radians(45)) * (b - 3) + 3 as px, sin(radians(45)) * (a - 3) + cos(radians(45)) * (b - 3) + 3 as py, c as pz
    from (select image_id, x, y, z, (x - 1) * 0.5::double + 1 as a, (y - 1) * 0.75::double + 1 as b, (z - 1) * 0.75::double + 1 as c from ids, grid)"""


@register("lazy_chain", f"with {VOX}, {IDS}, {grid(8, 6, 6)}, {corner_fill()}, {pulled('r', CHAINED)} {out('r', digits=5)}")
def lazy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(chain.Chain(images(spark, sf_dir)).rotate(3, 45).scale((1.5, 1, 1)).resample((0.75,) * 3).done(kind="double"), digits=5)
