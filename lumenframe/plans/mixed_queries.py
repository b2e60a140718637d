"""Registered queries over volumes whose geometry is each row's own, batched forms, channels, and the dose pipelines; with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lumenframe.functions import geometry, sql
from lumenframe.operators import dose, masks, spatial, uptake, volumes
from lumenframe.plans.volume_queries import D, IDS, VOX, corner_fill, grid, images, neighbours, out, pulled, rotated, rows, spaced, tidy, with_offset
from lumenframe.session import scratch
from lumenframe.sources import metaimage, nifti

Q, SQL = {}, {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(query):  # noqa: ANN001, ANN202
        Q[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


# ---- geometry of each row --------------------------------------------------------------------------------------
def mixed(spark, sf_dir):  # noqa: ANN001, ANN201
    """Even ids are 4 x 4 x 4, odd ones 8 x 4 x 2."""
    dims = F.when(F.col("image_id") % 2 == 0, volumes.ints(D)).otherwise(volumes.ints((8, 4, 2)))
    return images(spark, sf_dir).withColumn("dims", dims)


MIXED = """mix as (select image_id, case when image_id % 2 = 0 then 4 else 8 end as nx, 4 as ny, case when image_id % 2 = 0 then 4 else 2 end as nz,
    case when image_id % 2 = 0 then x else f % 8 + 1 end as x, case when image_id % 2 = 0 then y else f // 8 % 4 + 1 end as y, case when image_id % 2 = 0 then z else f // 32 + 1 end as z, v from vox),
    shapes as (select distinct image_id, nx, ny, nz from mix)"""


@register("pad_mixed_sizes", f"""with {VOX}, {MIXED}, {grid(9, 6, 5)} select i.image_id, g.x::int as x, g.y::int as y, g.z::int as z, round(coalesce(v, 2.5), 6) + 0.0 as value, -1.0::double as ox, -1.0::double as oz
    from shapes i join grid g on g.x <= nx + 1 and g.y <= ny + 2 and g.z <= nz + 1 left join mix m on m.image_id = i.image_id and m.x = g.x - 1 and m.y = g.y and m.z = g.z - 1""")
def pad_mixed_sizes(spark, sf_dir):
    df = spatial.pad(mixed(spark, sf_dir), (1, 0, 1), (0, 2, 0), 2.5).withColumns({"ox": F.col("origin")[0], "oz": F.col("origin")[2]})
    return rows(df, "ox", "oz").select("image_id", "x", "y", "z", "value", "ox", "oz")


@register("crop_each", f"""with {VOX} select image_id, (x - image_id % 2)::int as x, y::int as y, (z - image_id % 3 // 2)::int as z, round(v, 6) + 0.0 as value, (image_id % 2)::double as ox
    from vox where x - image_id % 2 between 1 and 3 and y <= 2 and z - image_id % 3 // 2 between 1 and 3""")
def crop_each(spark, sf_dir):
    begin = F.array((F.col("image_id") % 2).cast("int"), F.lit(0), F.floor(F.col("image_id") % 3 / 2).cast("int"))
    df = spatial.crop(images(spark, sf_dir), begin, (3, 2, 3)).withColumn("ox", F.col("origin")[0])
    return rows(df, "ox").select("image_id", "x", "y", "z", "value", "ox")


@register("crop_around", f"""with {VOX}, b as (select *, greatest(0, least(1, image_id % 4 - 1)) as b1, 1 as b2, 0 as b3 from vox)
    select image_id, (x - b1)::int as x, (y - b2)::int as y, (z - b3)::int as z, round(v, 6) + 0.0 as value from b where x - b1 between 1 and 3 and y - b2 between 1 and 2 and z - b3 between 1 and 4""")
def crop_around(spark, sf_dir):
    centre = F.array((F.col("image_id") % 4 + 1).cast("int"), F.lit(3), F.lit(2))
    return rows(spatial.crop_around(images(spark, sf_dir), (3, 2, 9), centre))


TURN = "cos(radians(30)) * (x - 3) - sin(radians(30)) * 1.5::double * (y - 3) + 3 as px, sin(radians(30)) / 1.5::double * (x - 3) + cos(radians(30)) * (y - 3) + 3 as py, z as pz"


@register("rotate_anisotropic", f"with {VOX}, {corner_fill()}, {pulled('r', f'select image_id, x, y, z, {TURN} from vox')} {out('r', digits=5)}")
def rotate_anisotropic(spark, sf_dir):
    """Voxels of 1 x 1.5 x 2 mm turn in space, not in the grid."""
    df = images(spark, sf_dir).withColumn("spacing", volumes.doubles((1, 1.5, 2)))
    return rows(spatial.rotate(df, 3, 30, kind="double"), digits=5)


@register("resample_oblique", f"""with {VOX}, {grid(4, 4, 4)}, {corner_fill()}, mov as (select image_id - 1 as image_id, x, y, z, v from vox),
    {pulled('r', '''select i.image_id, x, y, z, cos(0.5::double) * (x - 1) - sin(0.5::double) * 1.25::double * (y - 1) + 0.5::double + 1 as px,
        (sin(0.5::double) * (x - 1) + cos(0.5::double) * 1.25::double * (y - 1)) / 0.8::double + 1 as py, z as pz
        from (select distinct a.image_id from vox a join mov b on a.image_id = b.image_id) i, grid''', source='mov')} {out('r', digits=5)}""")
def resample_oblique(spark, sf_dir):
    """The fixed grid is turned by half a radian; both grids have spacings of their own."""
    c, s = math.cos(0.5), math.sin(0.5)
    df = images(spark, sf_dir)
    fixed = df.withColumns({"direction": volumes.doubles((c, -s, 0, s, c, 0, 0, 0, 1)), "spacing": volumes.doubles((1, 1.25, 1)), "origin": volumes.doubles((0.5, 0, 0))})
    moving = df.withColumns({"spacing": volumes.doubles((1, 0.8, 1)), "image_id": F.col("image_id") - 1})
    return rows(spatial.onto(fixed, moving, "image_id", kind="double"), digits=5)


@register("scale_each", f"""with {VOX}, {IDS}, {grid(6, 4, 4)}, {corner_fill()},
    {pulled('r', 'select image_id, x, y, z, (x - 3) / 1.5::double + 3 as px, y as py, z as pz from ids, grid')} {out('r', digits=5)}""")
def scale_each(spark, sf_dir):
    return rows(spatial.scale_each(images(spark, sf_dir), (1.5, 1, 1), kind="double"), digits=5)


@register("resample_each", f"""with {VOX}, {IDS}, {grid(6, 6, 6)}, fills as (select image_id, 0.0::double as fill from ids),
    {pulled('r', '''select image_id, x, y, z, (x - 1) * s + 1 as px, (y - 1) * s + 1 as py, (z - 1) * s + 1 as pz
        from (select image_id, case when image_id % 2 = 0 then 0.75::double else 1.25::double end as s from ids), grid where image_id % 2 = 0 or (x <= 4 and y <= 4 and z <= 4)''')} {out('r', digits=5)}""")
def resample_each(spark, sf_dir):
    """Spacings of 0.75 and 1.25 mm by turns; 0 outside."""
    s = F.when(F.col("image_id") % 2 == 0, 0.75).otherwise(1.25)
    return rows(spatial.resample_each(images(spark, sf_dir), F.array(s, s, s), kind="double"), digits=5)


@register("resample_rounded_size", f"with {VOX}, {IDS}, {grid(5, 5, 5)}, {corner_fill()}, {pulled('r', spaced(5, 0.75))} {out('r', digits=5)}")
def resample_rounded_size(spark, sf_dir):
    return rows(spatial.resample_to_spacing(images(spark, sf_dir), (0.75,) * 3, kind="double", sizes="round"), digits=5)


@register("rotate_about_centre", f"with {VOX}, {corner_fill()}, {pulled('r', rotated('vox', '(image_id % 3) * 40', 1.5).replace('sin', '-sin'))} {out('r', digits=5)}")
def rotate_about_centre(spark, sf_dir):
    return rows(spatial.rotate_each(images(spark, sf_dir), 3, -(F.col("image_id") % 3) * 40, kind="double", centre=volumes.doubles((1.5, 1.5, 1.5))), digits=5)


@register("affine_two_pass", f"""with {VOX}, {corner_fill()}, {pulled('a', rotated('vox', '30', 2))}, {corner_fill('a', 4, 'fa')},
    {pulled('r', 'select image_id, x, y, z, x - 0.3::double as px, y + 0.2::double as py, z - 0.1::double as pz from vox', 'a', 4, 'linear', 'fa')} {out('r', digits=5)}""")
def affine_two_pass(spark, sf_dir):
    """Two transforms one after the other, each sampled by itself: not what their product samples."""
    df = images(spark, sf_dir).withColumn("voxels", F.col("voxels").cast("array<double>"))
    turned = spatial.affine(df, geometry.affine_matrix(rotate=(0, 0, -30)), kind="double")
    return rows(spatial.affine(turned, geometry.affine_matrix(translation=(0.3, -0.2, 0.1)), kind="double"), digits=5)


@register("physical_points", f"""with {VOX} select image_id, x::int as x, y::int as y, z::int as z, round(0.6::double * 1 * x - 0.8::double * 1.5 * y + image_id % 7, 6) + 0.0 as px, round(0.8::double * x + 0.6::double * 1.5 * y, 6) + 0.0 as py,
    round(2.0::double * z, 6) + 0.0 as pz, round((x + image_id % 7)::double, 6) + 0.0 as plain_x, round((0.6::double * 4 - 0.8::double * 6) / 2 + image_id % 7, 6) + 0.0 as cx from vox""")
def physical_points(spark, sf_dir):
    df = images(spark, sf_dir).withColumns({"origin": F.array((F.col("image_id") % 7).cast("double"), F.lit(0.0), F.lit(0.0)), "spacing": volumes.doubles((1, 1.5, 2)), "direction": volumes.doubles((0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1))})
    v = volumes.voxel_rows(df, "origin", "spacing", "direction")
    at = [F.col(a) for a in "xyz"]
    v = v.withColumns({"p": spatial.physical_point(at), "plain": spatial.physical_point(at, oblique=False), "dims": volumes.ints(D)}).withColumn("centre", spatial.physical_centre())
    return v.select("image_id", "x", "y", "z", *(tidy(F.col("p")[i]).alias(f"p{a}") for i, a in enumerate("xyz")), tidy(F.col("plain")[0]).alias("plain_x"), tidy(F.col("centre")[0]).alias("cx"))


# ---- channels, masks -------------------------------------------------------------------------------------------
@register("channel_barycenters", f"""with {VOX}, lab as (select *, (round_even(abs(v) * 10, 0)::int) % 4 as c from vox), k as (select image_id, k.k::int as channel, x, y, z, (c = k.k)::int as m from lab, range(1, 4) k(k))
    select image_id, channel, {', '.join(f'round(coalesce(sum(m * {a})::double / nullif(sum(m), 0), 0), 6) + 0.0 as c{a}' for a in 'xyz')} from k group by all""")
def channel_barycenters(spark, sf_dir):
    """Labels to planes, planes to one 4-D image, and back to a row per channel."""
    df = images(spark, sf_dir).withColumn("voxels", F.transform("voxels", lambda v: (F.rint(F.abs(v.cast("double")) * 10) % 4).cast("float")))
    whole = masks.join_channels(masks.one_hot(df, 3))
    c = masks.barycenter(masks.split_channels(whole), "channel")
    return c.select("image_id", "channel", *(tidy(F.col(f"c{a}")).alias(f"c{a}") for a in "xyz"))


# The principal axis by squaring the covariance forty times, its trace held at 1: what is left is the outer product of the axis with itself.
@register("endpoints_wide", f"""with recursive {VOX}, pts as (select image_id, f, x - 1 as x, y - 1 as y, z - 1 as z from vox where v > 0.05::double),
    m as (select image_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz from pts group by image_id),
    c as (select p.*, n, p.x - mx as cx, p.y - my as cy, p.z - mz as cz from pts p join m using (image_id)),
    cov as (select image_id, sum(cx * cx) as a, sum(cx * cy) as b, sum(cx * cz) as c, sum(cy * cy) as d, sum(cy * cz) as e, sum(cz * cz) as f from c where n > 1 group by image_id),
    r as (select image_id, 0 as k, a / (a + d + f) as a, b / (a + d + f) as b, c / (a + d + f) as c, d / (a + d + f) as d, e / (a + d + f) as e, f / (a + d + f) as f from cov
        union all select image_id, k + 1, (a * a + b * b + c * c) / t, (a * b + b * d + c * e) / t, (a * c + b * e + c * f) / t, (b * b + d * d + e * e) / t, (b * c + d * e + e * f) / t, (c * c + e * e + f * f) / t
            from (select *, a * a + d * d + f * f + 2 * (b * b + c * c + e * e) as t from r) where k < 40),
    u as (select image_id, case when ra >= rd and ra >= rf then a when rd >= rf then b else c end as ux, case when ra >= rd and ra >= rf then b when rd >= rf then d else e end as uy, case when ra >= rd and ra >= rf then c when rd >= rf then e else f end as uz
        from (select *, round(a, 9) as ra, round(d, 9) as rd, round(f, 9) as rf from r where k = 40)),
    l as (select c.*, round((cx * ux + cy * uy + cz * uz) / sqrt(ux * ux + uy * uy + uz * uz), 9) as along from c join u using (image_id)),
    ends as (select image_id, {', '.join(f'first({a} order by along {way}, f) as {a}{k}' for k, way in ((1, ''), (2, 'desc')) for a in 'xyz')} from l group by image_id)
    select vec_id as image_id, {', '.join(f'coalesce({a}{k}, case when n = 1 then m{a} else 16 end)::double as {a}{k}' for k in (1, 2) for a in 'xyz')} from embeddings i left join m on m.image_id = i.vec_id left join ends e on e.image_id = i.vec_id""")
def endpoints_wide(spark, sf_dir):
    """A threshold that leaves some twenty voxels an image, whose principal axis is unique; few voxels on a grid often have two axes of one length."""
    return masks.endpoints(images(spark, sf_dir), 0.05)


@register("endpoints")
def endpoints(spark, sf_dir):
    return masks.endpoints(images(spark, sf_dir), 0.2)


@register("grad_one_sided", f"""with {VOX}, n as (select *, {', '.join(f'lag(v) over w{a} as l{a}, lead(v) over w{a} as r{a}' for a in 'xyz')} from vox window {', '.join(f'w{a} as (partition by image_id, {", ".join(b for b in "xyz" if b != a)} order by {a})' for a in 'xyz')}),
    g as (select *, {', '.join(f'coalesce(r{a}, v) - coalesce(l{a}, v) as g{a}' for a in 'xyz')} from n) {out('g', 'sqrt(gx * gx + gy * gy + gz * gz + 1e-6)')}""")
def grad_one_sided(spark, sf_dir):
    return rows(masks.one_sided_gradient(images(spark, sf_dir)))


@register("directional_flux", f"""with {VOX}, n as (select *, {', '.join(f'lag(v) over w{a} as l{a}, lead(v) over w{a} as r{a}' for a in 'xyz')} from vox window {', '.join(f'w{a} as (partition by image_id, {", ".join(b for b in "xyz" if b != a)} order by {a})' for a in 'xyz')})
    select image_id, x::int as x, y::int as y, z::int as z, {', '.join(f'round(coalesce(r{a}, v) - coalesce(l{a}, v), 6) + 0.0 as flux_{a}' for a in 'xyz')} from n""")
def directional_flux(spark, sf_dir):
    f = masks.directional_flux(images(spark, sf_dir))
    zipped = F.posexplode(F.arrays_zip("flux_x", "flux_y", "flux_z")).alias("f", "g")
    at = f.select("image_id", zipped).select("image_id", *((F.floor(F.col("f") / 4**i) % 4 + 1).cast("int").alias(a) for i, a in enumerate("xyz")), "g.*")
    return at.select("image_id", "x", "y", "z", *(tidy(F.col(f"flux_{a}")).alias(f"flux_{a}") for a in "xyz"))


@register("mapped_voxels", f"with {VOX} {out('vox', 'v * v * z')}")
def mapped_voxels(spark, sf_dir):
    """A user's own function of whole volumes."""
    return rows(masks.map_voxels(images(spark, sf_dir), lambda v: v * v * np.arange(1, v.shape[0] + 1)[:, None, None]))


# ---- dose ------------------------------------------------------------------------------------------------------
@register("dose_safety", f"""with {VOX} select image_id, x::int as x, y::int as y, z::int as z, round(case when abs(v) <= 0.05 then 0 else 10 / (abs(v) * 2) end, 5) + 0.0 as dose,
    round(case when image_id % 2 = 0 then v else v * 54.2::double end, 5) + 0.0 as activity, round(v * 100, 5) + 0.0 as hu from vox""")
def dose_safety(spark, sf_dir):
    v = volumes.voxel_rows(images(spark, sf_dir))
    units = F.when(F.col("image_id") % 2 == 0, "BQML").otherwise("COUNTS")
    return v.select("image_id", "x", "y", "z", tidy(dose.safe_dose(F.lit(10.0), F.abs("value"), 2.0), 5).alias("dose"), tidy(dose.calibrated(F.col("value"), units, 54.2), 5).alias("activity"), tidy(dose.without_contrast(F.col("value") * 100), 5).alias("hu"))


@register("standardized", f"with {VOX}, st as (select image_id, avg(v) as m, stddev_pop(v) as s from vox group by image_id) {out('vox join st using (image_id)', '(v - m) / (s + 1e-6)', 5)}")
def standardized(spark, sf_dir):
    v = volumes.voxel_rows(images(spark, sf_dir))
    s = v.groupBy("image_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return v.join(s, "image_id").select("image_id", "x", "y", "z", tidy(dose.standardize(F.col("value"), F.col("m"), F.col("s")), 5).alias("value"))


@register("body_masked", f"with {VOX} {out('vox a join vox b on b.image_id = a.image_id + 1 and b.f = a.f', 'a.v * (b.v > 0.1::float)::int').replace('image_id, x::int', 'a.image_id, a.x::int').replace(' y::int', ' a.y::int').replace(' z::int', ' a.z::int')}")
def body_masked(spark, sf_dir):
    p = neighbours(images(spark, sf_dir)).select("image_id", F.col("a.dims").alias("dims"), F.col("a.voxels").alias("v"), F.transform("b.voxels", lambda x: (x > 0.1).cast("int").cast("float")).alias("m"))
    return rows(p.withColumn("voxels", dose.in_body("v", "m")))


PAIR = "pair as (select a.image_id, a.x, a.y, a.z, a.v as p, b.v as q, c.v as body from vox a join vox b on b.image_id = a.image_id + 1 and b.f = a.f join vox c on c.image_id = a.image_id and c.f = 63 - a.f)"


@register("dose_compare", f"""with {VOX}, {PAIR}, tops as (select image_id, quantile_cont(case when p > 0 then p end, 0.99) as tp, quantile_cont(case when q > 0 then q end, 0.99) as tq from pair group by image_id),
    m as (select *, p / tp as np, q / tq as nq from pair join tops using (image_id) where body > -0.2::float and (p > 0 or q > 0)),
    s as (select image_id, count(*) as n_voxels, round(corr(p, q), 5) + 0.0 as pearson, round(covar_pop(p, q) * count(*) / (sqrt(var_pop(p) * var_pop(q)) * count(*) + 1e-8), 5) + 0.0 as ncc, round(avg(abs(np - nq)), 5) + 0.0 as mae, round(avg(p) / avg(q), 3) + 0.0 as ratio, abs(avg(q)) > 0.01 as sure from m group by image_id),
    z0 as (select image_id, z, round(sum(case when p > 0 and body > -0.2::float then p else 0 end), 9) as a from pair group by all), z as (select * from z0 qualify row_number() over (partition by image_id order by a desc, z) = 1)
    select image_id, n_voxels, pearson, ncc, mae, case when sure then ratio end as ratio, z::int as z from s join z using (image_id)""")
def dose_compare(spark, sf_dir):
    """Two volumes inside a body mask, and the slice with the most activity there."""
    df = neighbours(images(spark, sf_dir)).select("image_id", F.col("a.dims").alias("dims"), F.col("a.voxels").alias("p"), F.col("b.voxels").alias("q"))
    df = df.withColumn("body", F.transform(F.reverse("p"), lambda v: (v > -0.2).cast("int").cast("float")))
    done = dose.compared(df, "p", "q", "body").withColumn("voxels", dose.in_body("p", "body"))
    mean = F.aggregate(F.filter(F.arrays_zip("p", "q", "body"), lambda t: (t["body"] != 0) & ((t["p"] > 0) | (t["q"] > 0))), F.lit(0.0), lambda s, t: s + t["q"].cast("double")) / F.col("n_voxels")
    done = masks.busiest_slice(done).withColumn("sure", F.abs(mean) > 0.01)
    return done.select("image_id", "n_voxels", *(tidy(F.col(c), 5).alias(c) for c in ("pearson", "ncc", "mae")), F.when(F.col("sure"), tidy(F.col("ratio"), 3)).alias("ratio"), "z")


@register("dose_eval_cropped", f"""with {VOX}, p as (select a.image_id, a.v * 1e9 * 8.478e-8::double / (2.0 * (1 + 0.0007 * abs(b.v)) + 1e-4) as a, b.v as b from vox a join vox b on b.image_id = a.image_id + 1 and b.f = a.f where a.x in (2, 3) and a.y in (2, 3) and a.z in (2, 3))
    select image_id, round(avg(abs(a - b)), 4) + 0.0 as mae, round(corr(a, b), 5) + 0.0 as pearson from p group by image_id""")
def dose_eval_cropped(spark, sf_dir):
    """The analytical dose in the central cube."""
    p = neighbours(spatial.pad_or_crop(images(spark, sf_dir), (2, 2, 2))).select("image_id", F.explode(F.arrays_zip(F.col("a.voxels").alias("v"), F.col("b.voxels").alias("w"))).alias("p"))
    v, w = F.col("p.v").cast("double"), F.col("p.w").cast("double")
    p = p.select("image_id", dose.analytical_dose(v * 1e9, 1 + 0.0007 * F.abs(w), 2.0).alias("a"), w.alias("b"))
    return dose.agreement(p, "a", "b", ["image_id"]).select("image_id", tidy(F.col("mae"), 4).alias("mae"), tidy(F.col("pearson"), 5).alias("pearson"))


NEXT = "mov as (select image_id - 1 as image_id, x, y, z, v from vox), both_ids as (select distinct a.image_id from vox a join mov b using (image_id))"
ONTO = "select i.image_id, x, y, z, (x - 1 - ((i.image_id + 1) % 3) * 0.5::double) / 1.5::double + 1 as px, (y - 1 + 0.25::double) / 1.5::double + 1 as py, (z - 1) / 1.5::double + 1 as pz from both_ids i, grid"


@register("dose_local_pipeline", f"""with {VOX}, {grid(4, 4, 4)}, {NEXT}, fills as (select image_id, -1000.0::double as fill from both_ids), hum as (select image_id, x, y, z, v * 800 as v from mov), {pulled('ct', ONTO, 'hum')},
    d as (select ct.image_id, ct.x, ct.y, ct.z, a.v * (60000 / (3.7e8::double * exp(-ln(2) * 1800 / 6586.2::double))) * 1e4 as suv, case when ct.v <= 0 then greatest(0.01, 1 + 0.001 * ct.v) else 1 + 0.0007 * ct.v end as rho
        from ct join vox a on a.image_id = ct.image_id and a.x = ct.x and a.y = ct.y and a.z = ct.z)
    {out('d', f'greatest(suv, 0) * 1232.3742::double / greatest(0.01, least(3.0, rho))', 3)}""")
def dose_local_pipeline(spark, sf_dir):
    """CT onto the PET grid, uptake, density, local dose."""
    df = images(spark, sf_dir).withColumn("voxels", F.col("voxels").cast("array<double>"))
    ct = with_offset(df).withColumns({"image_id": F.col("image_id") - 1, "voxels": F.transform("voxels", lambda v: v * 800)})
    hu = spatial.onto(df, ct, "image_id", fill=F.lit(-1000.0), kind="double").select("image_id", F.col("voxels").alias("hu"))
    suv = uptake.suv_factor(F.lit("60"), F.lit("370000000"), F.lit("6586.2"), F.lit("101500"), F.lit("104500"))
    pairs = df.join(hu, "image_id").withColumn("factor", suv * 1e4)
    local = F.zip_with("voxels", "hu", lambda v, h: dose.local_dose(v * F.col("factor"), dose.density(h)))
    return rows(pairs.withColumn("voxels", local), digits=3)


def turn_x(points_of: str) -> str:
    c, s = "cos(radians(60))", "sin(radians(60))"
    return f"select image_id, x, y, z, x as px, {c} * (y - 3) - {s} * (z - 3) + 3 as py, {s} * (y - 3) + {c} * (z - 3) + 3 as pz from {points_of}"


@register("rotate_modalities", f"""with {VOX}, {grid(4, 4, 4)}, {NEXT}, fills as (select image_id, 0.0::double as fill from both_ids), lab as (select image_id, x, y, z, (v > 0)::int::double as v from mov),
    {pulled('a1', ONTO, 'mov')}, {pulled('l1', ONTO, 'lab', 4, 'nearest')}, {corner_fill('a1', 4, 'fa')}, {corner_fill('l1', 4, 'fl')},
    {pulled('a2', turn_x('a1'), 'a1', 4, 'linear', 'fa')}, {pulled('l2', turn_x('l1'), 'l1', 4, 'nearest', 'fl')}
    select a2.image_id, a2.x::int as x, a2.y::int as y, a2.z::int as z, round(a2.v, 5) + 0.0 as value, l2.v::int as mask from a2 join l2 using (image_id, x, y, z)""")
def rotate_modalities(spark, sf_dir):
    """An image and a label onto the grid of a third, the label by nearest neighbours, then all turned by 60 degrees about x."""
    df = images(spark, sf_dir).withColumn("voxels", F.col("voxels").cast("array<double>"))
    moving = with_offset(df).withColumn("image_id", F.col("image_id") - 1)
    label = moving.withColumn("voxels", F.transform("voxels", lambda v: (v > 0).cast("int").cast("double")))
    done = []
    for d, mode in ((moving, "linear"), (label, "nearest")):
        there = spatial.onto(df, d, "image_id", mode, F.lit(0.0), "double")
        done.append(volumes.voxel_rows(spatial.rotate(there, 1, 60, mode, "double")))
    a, m = done
    return a.select("image_id", "x", "y", "z", tidy(F.col("value"), 5).alias("value")).join(m.select("image_id", "x", "y", "z", F.col("value").cast("int").alias("mask")), ["image_id", "x", "y", "z"])


@register("dataset_prep", f"""with {VOX}, {grid(4, 4, 4)}, {NEXT}, fills as (select image_id, 0.0::double as fill from both_ids), air as (select image_id, -1000.0::double as fill from both_ids),
    {pulled('s', ONTO, 'mov')}, {pulled('c', ONTO, 'mov', 4, 'linear', 'air')}
    select s.image_id, s.x::int as x, s.y::int as y, s.z::int as z, round(s.v, 4) + 0.0 as spect, round(c.v, 3) + 0.0 as ct, round(t.v, 5) + 0.0 as target from s join c using (image_id, x, y, z) join vox t using (image_id, x, y, z)""")
def dataset_prep(spark, sf_dir):
    df = images(spark, sf_dir)
    moving = with_offset(df).withColumn("image_id", F.col("image_id") - 1)
    done = dose.dataset(df, moving, moving, moving, kind="double")
    flat = done.select("image_id", "dims", F.posexplode(F.arrays_zip("spect", "ct", "target")).alias("f", "p"))
    at = {"x": F.col("f") % 4 + 1, "y": F.floor(F.col("f") / 4) % 4 + 1, "z": F.floor(F.col("f") / 16) + 1}
    return flat.select("image_id", *(c.cast("int").alias(k) for k, c in at.items()), *(tidy(F.col("p")[c].cast("double"), n).alias(c) for c, n in (("spect", 4), ("ct", 3), ("target", 5))))


@register("multimodal_prep", f"""with {VOX}, {IDS}, {grid(6, 6, 6)}, {corner_fill()}, {pulled('s', spaced(6, '(2.0 / 3)').replace('::double', ''))}, {corner_fill('s', 6, 'fs')}, nxt as (select image_id - 1 as image_id, x, y, z, v from vox), ids2 as (select image_id from ids where image_id in (select image_id from nxt)),
    {pulled('c', spaced(6, '(2.0 / 3)').replace('::double', '').replace('from ids,', 'from ids2,'), 'nxt', 4, 'linear', 'fs')},
    k as (select s.image_id, s.x, s.y, s.z, s.v / max(abs(s.v)) over w as spect, greatest(-1000, least(2000, c.v * 5000)) as hu from s join c using (image_id, x, y, z) window w as (partition by s.image_id)),
    l as (select *, hu - min(hu) over (partition by image_id) as h from k)
    select image_id, x::int as x, y::int as y, z::int as z, round(spect, 4) + 0.0 as spect, round(h / max(h) over (partition by image_id), 3) + 0.0 as ct from l""")
def multimodal_prep(spark, sf_dir):
    df = images(spark, sf_dir)
    ct = df.withColumns({"image_id": F.col("image_id") - 1})
    done = dose.prepared(df, ct, ct, (6, 6, 6), kind="double")
    fine = spatial.resample_to_spacing(df, (2 / 3,) * 3, kind="double")
    hu = spatial.onto(fine, ct, "image_id", kind="double").withColumn("voxels", F.transform("voxels", lambda v: v.cast("double") * 5000)).select("image_id", dose.unit_ct("voxels").alias("ct"))
    flat = done.drop("ct").join(hu, "image_id").select("image_id", F.posexplode(F.arrays_zip("spect", "ct")).alias("f", "p"))
    at = {"x": F.col("f") % 6 + 1, "y": F.floor(F.col("f") / 6) % 6 + 1, "z": F.floor(F.col("f") / 36) + 1}
    return flat.select("image_id", *(c.cast("int").alias(k) for k, c in at.items()), tidy(F.col("p.spect").cast("double"), 4).alias("spect"), tidy(F.col("p.ct").cast("double"), 3).alias("ct"))


STD = "st as (select image_id, avg(v) as m, stddev_pop(v) as s from vox group by image_id), std as (select image_id, x, y, z, (v - m) / (s + 1e-6) as v from vox join st using (image_id))"


@register("voxel_features", f"""with {VOX}, {STD}, peak as (select image_id, quantile_cont(v, 0.95) as top from vox group by image_id), hot as (select image_id, x, y, z from vox join peak using (image_id) where v > top),
    off(o) as (values (-1), (0), (1)), box as (select a.image_id, a.x, a.y, a.z, avg(b.v) as v from std a, off i, off j, off k, std b
        where b.image_id = a.image_id and b.x = greatest(1, least(4, a.x + i.o)) and b.y = greatest(1, least(4, a.y + j.o)) and b.z = greatest(1, least(4, a.z + k.o)) group by all),
    far as (select v.image_id, v.x, v.y, v.z, sqrt(min((v.x - h.x) ** 2 + (v.y - h.y) ** 2 + (v.z - h.z) ** 2)) as d from vox v join hot h using (image_id) group by all)
    select image_id, x::int as x, y::int as y, z::int as z, round(std.v, 4) + 0.0 as spect, round(box.v, 4) + 0.0 as spect_mean, round((d - avg(d) over w) / (stddev_pop(d) over w + 1e-6), 4) + 0.0 as to_peak
    from std join box using (image_id, x, y, z) join far using (image_id, x, y, z) window w as (partition by image_id)""")
def voxel_features(spark, sf_dir):
    done = dose.voxel_features(images(spark, sf_dir), "voxels", "voxels")
    flat = done.select("image_id", F.posexplode(F.arrays_zip("f_spect", "f_spect_mean", "f_to_peak")).alias("f", "p"))
    at = {"x": F.col("f") % 4 + 1, "y": F.floor(F.col("f") / 4) % 4 + 1, "z": F.floor(F.col("f") / 16) + 1}
    return flat.select("image_id", *(c.cast("int").alias(k) for k, c in at.items()), *(tidy(F.col("p")[f"f_{c}"], 4).alias(c) for c in ("spect", "spect_mean", "to_peak")))


@register("ssim_pairs", f"""with {VOX}, taps as (select o, exp(-(o * o) / 4.5::double) / (select sum(exp(-(q * q) / 4.5::double)) from range(-5, 6) r(q)) as w from range(-5, 6) t(o)),
    pair as (select a.image_id, a.x, a.y, a.z, a.v as p, b.v as q from vox a join vox b on b.image_id = a.image_id + 1 and b.f = a.f),
    s as (select c.image_id, c.x, c.y, c.z, sum(i.w * j.w * n.p) as mp, sum(i.w * j.w * n.q) as mq, sum(i.w * j.w * n.p * n.p) as pp, sum(i.w * j.w * n.q * n.q) as qq, sum(i.w * j.w * n.p * n.q) as pq
        from pair c join pair n on n.image_id = c.image_id and n.z = c.z join taps i on i.o = n.x - c.x join taps j on j.o = n.y - c.y group by all)
    select image_id, round(avg((2 * mp * mq + 0.0001::double) * (2 * (pq - mp * mq) + 0.0009::double) / ((mp * mp + mq * mq + 0.0001::double) * (pp - mp * mp + qq - mq * mq + 0.0009::double))), 5) + 0.0 as ssim from s group by image_id""")
def ssim_pairs(spark, sf_dir):
    df = neighbours(images(spark, sf_dir)).select("image_id", F.col("a.dims").alias("dims"), F.col("a.voxels").alias("p"), F.col("b.voxels").alias("q"))
    return df.select("image_id", tidy(dose.ssim(df, "p", "q"), 5).alias("ssim"))


@register("matrix_gradient")
def matrix_gradient(spark, sf_dir):
    """How the sum of squared samples changes with the matrix."""
    m = geometry.affine_matrix(translation=(0.2, 0.1, -0.3), rotate=(0, 0, 10))
    df = images(spark, sf_dir).withColumn("g", F.col("voxels"))
    return spatial.matrix_gradient(df, "g", m, (2, 2, 2)).select("image_id", F.posexplode("d_matrix").alias("k", "d"))


# ---- files and SQL ---------------------------------------------------------------------------------------------
@register("nifti_roundtrip", f"with {VOX} select image_id, x::int as x, y::int as y, z::int as z, round(v, 6) + 0.0 as value, (image_id % 3)::double as ox from vox")
def nifti_roundtrip(spark, sf_dir):
    """Every image to a file of its own and back."""
    path = scratch(spark, "nifti")
    df = images(spark, sf_dir).withColumns({"file": F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".nii.gz")), "origin": F.array((F.col("image_id") % 3).cast("double"), F.lit(2.0), F.lit(-1.0))})
    nifti.write_nifti(df, path if ":" in path else f"file://{path}")
    back = metaimage.read_volumes(spark, path).withColumns({"image_id": F.regexp_extract("file", r"(\d+)", 1).cast("long"), "ox": F.round(F.col("origin")[0], 6) + 0.0})
    return rows(back, "ox").select("image_id", "x", "y", "z", "value", "ox")


@register("sql_functions", f"""with {VOX} select image_id, x::int as x, y::int as y, z::int as z, round(v, 6) + 0.0 as value, round(case when v * 100 <= 0 then greatest(0.01, 1 + 0.001 * (v * 100)) else 1 + 0.0007 * (v * 100) end, 6) + 0.0 as rho from vox""")
def sql_functions(spark, sf_dir):
    """The table function in a lateral join, and a scalar one, in SQL text."""
    sql.register(spark)
    df = images(spark, sf_dir).select("image_id", "voxels", "dims")
    return spark.sql("select image_id, x, y, z, round(double(value), 6) + 0.0D as value, round(hu_density(double(value) * 100), 6) + 0.0D as rho from {df}, lateral mi_voxels(voxels, dims)", df=df)
