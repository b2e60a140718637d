import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import bricks, volumes
from lumenframe.sources import metaimage, nifti, scene, store
from lumenframe.sources import volumes as source
from lumenframe.streaming import landing

SF = "/root/testdata/sf0.001"


def test_nifti_round_trip(spark, tmp_path):
    df = volumes.images_from_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), spacing=(1.5, 2, 0.5), origin=(3, -4, 5)).where("image_id < 20")
    df = df.withColumn("file", F.concat(F.col("image_id").cast("string"), F.when(F.col("image_id") % 2 == 0, ".nii").otherwise(".nii.gz")))
    nifti.write_nifti(df, f"file://{tmp_path}/v")
    got = {r["file"]: r for r in nifti.read_nifti(spark, f"{tmp_path}/v").collect()}
    want = {r["file"]: r for r in df.collect()}
    assert set(got) == set(want)
    for name, r in want.items():
        g = got[name]
        assert list(g["dims"]) == list(r["dims"]) and np.array_equal(np.float32(g["voxels"]), np.float32(r["voxels"]))
        assert np.allclose(g["origin"], r["origin"]) and np.allclose(g["spacing"], r["spacing"]) and np.allclose(g["direction"], r["direction"])
    assert nifti.read_nifti(spark, f"{tmp_path}/v", headers_only=True).where("voxels is not null").count() == 0


def test_store_pushes_its_filters(spark, tmp_path):
    df = volumes.images_from_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).where("image_id < 5").withColumn("metadata", F.create_map(F.lit("k"), F.lit(1)))
    names = store.save_images(df, str(tmp_path / "s"), "ct").collect()
    one = store.load_images(spark, str(tmp_path / "s"), "ct", names[0]["dataset_name"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and one.first()["metadata"] == '{"k":1}' and "EqualTo(dataset_name" in plan and "PartitionFilters: [isnotnull(group" in plan


def test_store_skips_row_groups(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("image_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3)).alias("voxels")).coalesce(1)
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        names = store.save_images(df, str(tmp_path / "s"), "ct").where("image_id = 1234").first()["dataset_name"]
    finally:
        spark.conf.unset("parquet.block.size")
    one = store.load_images(spark, str(tmp_path / "s"), "ct", names)
    assert [r["image_id"] for r in one.collect()] == [1234]
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() < 1000


def test_scene_folds_transforms(spark, tmp_path):
    xml = """<MRML><LinearTransform id="t1" matrixTransformToParent="1 0 0 10 0 1 0 0 0 0 1 0 0 0 0 1" references="transform:t2;"/>
    <LinearTransform id="t2" matrixTransformToParent="1 0 0 0 0 1 0 5 0 0 1 0 0 0 0 1"/><VolumeArchetypeStorage id="s" fileName="a.nrrd"/>
    <Volume id="v" name="CT" spacing="2 2 3" origin="1 2 3" ijkToRASDirections="1 0 0 0 1 0 0 0 1" references="transform:t1;storage:s;"/></MRML>"""
    with zipfile.ZipFile(tmp_path / "x.mrb", "w") as z:
        z.writestr("x/scene.mrml", xml)
    r = scene.read_scenes(spark, str(tmp_path)).first()
    assert (r["name"], r["file"]) == ("CT", "a.nrrd") and list(r["origin"]) == [-11, -7, 3] and list(r["spacing"]) == [2, 2, 3]


def test_streams_equal_batches(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = landing.stream_tables(spark, f"{SF}/events*.parquet", schema)
    q = landing.activity(events).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    assert spark.table("activity").agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0] and spark.table("activity").count() == want.count()


def test_metaimage_round_trip(spark, tmp_path):
    voxels, turn = np.arange(24, dtype=np.float32), [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    for name, packed in (("a.mha", False), ("b.mha", True)):
        (tmp_path / name).write_bytes(metaimage.build([2, 3, 4], voxels, [1, 2, 3], [0.5, 1, 2], turn, packed))
    head = b"NDims = 3\nDimSize = 2 1 1\nElementNumberOfChannels = 2\nElementType = MET_SHORT\nBinaryDataByteOrderMSB = True\nElementDataFile = LOCAL\n"
    (tmp_path / "c.mha").write_bytes(head + np.array([1, 10, 2, 20], ">i2").tobytes())
    got = {r["file"]: r for r in metaimage.with_type(metaimage.read_volumes(spark, str(tmp_path)), "CT").collect()}
    for name in ("a.mha", "b.mha"):
        r = got[name]
        assert list(r["dims"]) == [2, 3, 4] and list(r["voxels"]) == voxels.tolist() and list(r["spacing"]) == [0.5, 1, 2] and list(r["origin"]) == [1, 2, 3]
        assert list(r["direction"]) == turn and (r["image_type"], r["image_subtype"], r["legacy_file_name"]) == ("CT", "CT", name)
    assert got["c.mha"]["channels"] == 2 and list(got["c.mha"]["voxels"]) == [1, 2, 10, 20]
    kinds = [metaimage.with_type(metaimage.read_volumes(spark, str(tmp_path)), "MRI", plain).first()["image_type"] for plain in (False, True)]
    assert kinds == ["MRI", "PET"]


def test_scene_brings_its_voxels(spark, tmp_path):
    xml = '<MRML><VolumeStorage id="s" fileName="a%20b.mha"/><Volume id="v" name="CT" spacing="2 2 3" references="storage:s;"/></MRML>'
    with zipfile.ZipFile(tmp_path / "x.mrb", "w") as z:
        z.writestr("x/scene.mrml", xml)
        z.writestr("x/Data/a b.mha", metaimage.build([2, 1, 1], np.array([5, 6]), [9, 9, 9], [1, 1, 1], list(volumes.IDENTITY)))
    r = scene.read_scenes(spark, str(tmp_path)).first()
    assert list(r["voxels"]) == [5, 6] and list(r["dims"]) == [2, 1, 1] and list(r["spacing"]) == [2, 2, 3] and list(r["origin"]) == [0, 0, 0]


def test_store_restores_metadata(spark, tmp_path):
    df = volumes.images_from_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).where("image_id < 3").withColumn("metadata", F.create_map(F.lit("k"), F.col("image_id")))
    store.save_images(df, str(tmp_path / "s"), "ct")
    back = store.load_images(spark, str(tmp_path / "s"), "ct", metadata={"metadata": "map<string, bigint>"})
    assert {r["image_id"]: r["metadata"] for r in back.collect()} == {i: {"k": i} for i in range(3)}


def phantoms(spark, n=6):
    df = volumes.images_from_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), spacing=(1.5, 2, 0.5), origin=(3, -4, 5)).where(F.col("image_id") < n)
    return df.withColumn("file", F.concat(F.lit("v"), F.col("image_id").cast("string"), F.when(F.col("image_id") % 2 == 0, ".nii").otherwise(".nii.gz")))


def test_volume_scan_reads_what_is_asked(spark, tmp_path):
    df, uri = phantoms(spark), f"file://{tmp_path}/v"
    source.save(df, uri)
    want = {r["file"]: r for r in df.collect()}
    got = {r["file"]: r for r in source.scan(spark, uri).collect()}
    assert set(got) == set(want) and all(np.array_equal(np.float32(got[f]["voxels"]), np.float32(want[f]["voxels"])) for f in want)
    assert not [p for p in os.listdir(tmp_path / "v") if p.startswith("_")]
    # Headers alone: files whose voxels are cut off can still be asked for their shape.
    whole = (tmp_path / "v" / "v0.nii").read_bytes()
    (tmp_path / "v" / "v0.nii").write_bytes(whole[:352])
    heads = source.scan(spark, uri, ["file", "dims", "spacing"])
    assert {(r["file"], tuple(r["dims"])) for r in heads.collect()} == {(f, (4, 4, 4)) for f in want}
    assert "voxels" not in heads._jdf.queryExecution().executedPlan().toString()
    # Files that a filter leaves out aren't opened: this one isn't a volume at all.
    (tmp_path / "v" / "broken.nii").write_bytes(b"nothing")
    few = source.scan(spark, uri, ["file", "voxels"]).where(F.col("file").isin("v1.nii.gz", "v2.nii"))
    assert sorted(r["file"] for r in few.collect()) == ["v1.nii.gz", "v2.nii"] and few.rdd.getNumPartitions() == 2
    assert source.scan(spark, uri, ["file"]).where(F.col("file").startswith("v3")).count() == 1


@pytest.mark.parametrize("name", ["a.nii", "a.nii.gz"])
def test_bricks_from_files(spark, tmp_path, name):
    voxels = np.arange(5 * 6 * 7, dtype=np.float32)
    row = (name, [5, 6, 7], voxels.tolist(), [0.0] * 3, [1.0] * 3, list(volumes.IDENTITY))
    df = spark.createDataFrame([row], "file string, dims array<int>, voxels array<float>, origin array<double>, spacing array<double>, direction array<double>")
    source.save(df, f"file://{tmp_path}/v")
    rows = source.scan(spark, f"file://{tmp_path}/v", brick=(2, 4, 3))
    assert rows.count() == 3 * 2 * 3 and rows.rdd.getNumPartitions() == (1 if name.endswith("gz") else 3)
    assert np.array_equal(bricks.join(rows).first()["voxels"], voxels)
    places = source.scan(spark, f"file://{tmp_path}/v", ["file", "dims", "side", "bx", "by", "bz"], brick=(2, 4, 3))
    assert places.count() == 18


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    from pyspark.sql.functions import udf

    df, uri = phantoms(spark).repartition(3), f"file://{tmp_path}/v"
    source.save(df.where("image_id = 0").withColumn("file", F.lit("old.nii")), uri)

    @udf("string")
    def dies(name):
        if name == "v4.nii":
            raise RuntimeError("lost")
        return name

    with pytest.raises(Exception, match="lost"):
        source.save(df.coalesce(1).sortWithinPartitions("image_id").withColumn("file", dies("file")), uri)
    assert os.listdir(tmp_path / "v") == ["old.nii"]


def test_slopes_that_are_no_numbers(tmp_path):
    data = bytearray(nifti.build([2, 1, 1], np.array([1.0, 2.0]), [0, 0, 0], [1, 1, 1], list(volumes.IDENTITY)))
    for slope, inter, want in ((float("nan"), 0.0, [1, 2]), (0.0, 5.0, [1, 2]), (2.0, 1.0, [3, 5]), (1.0, 3.0, [4, 5]), (2.0, float("nan"), [1, 2])):
        struct.pack_into("<2f", data, 112, slope, inter)
        assert nifti.parse(bytes(data))["voxels"].tolist() == want


def test_cycles_are_numbered_on_a_stream(spark, tmp_path):
    """Days arrive out of order in several files; a last far row moves the watermark past all of them."""
    import datetime

    days = {1: [0, 3, 15, 16, 40], 2: [5], 3: [0, 9, 20, 29, 39]}
    rows = [(p, datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(days=d, hours=h)) for p, ds in days.items() for d in ds for h in (0, 5)]
    order = sorted(rows, key=lambda r: (r[1].day * 7 + r[0]) % 11)
    kind = "user_id long, ts timestamp"
    for i in range(3):
        spark.createDataFrame(order[i::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, datetime.datetime(2024, 6, 1))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, datetime.datetime(2024, 9, 1))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = landing.stream_tables(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, 1)
    q = landing.numbered_cycles(files, late="60 days").writeStream.outputMode("append").format("memory").queryName("numbered").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["patient"], r["day"]): (r["cycle"], r["n"]) for r in spark.table("numbered").collect() if r["patient"] != 9}
    from lumenframe.operators import inventory

    batch = spark.createDataFrame(rows, kind).withColumn("day", F.to_date("ts"))
    want = inventory.assign_cycles(batch, "user_id", "day").groupBy("user_id", "day").agg(F.max("cycle").alias("cycle"), F.count("*").alias("n"))
    assert got == {(r["user_id"], r["day"]): (r["cycle"], r["n"]) for r in want.collect()} and len(got) == 11


def test_saved_answers_and_reports(spark, tmp_path):
    """Series lists are read from saved JSON answers, and result tables are written as CSV with one header, replacing older ones."""
    from lumenframe.operators import inventory

    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "a.json").write_text('[{"SeriesInstanceUID": "1.2", "Modality": "CT", "ImageCount": 40},\n {"SeriesInstanceUID": "1.3", "Modality": "PT", "ImageCount": null}]')
    (tmp_path / "answers" / "b.json").write_text('[{"SeriesInstanceUID": "1.4", "Modality": "CT", "ImageCount": 7, "TotalSizeInBytes": 9}]')
    got = {r["SeriesInstanceUID"]: (r["Modality"], r["ImageCount"], r["TotalSizeInBytes"]) for r in inventory.series_list(spark, str(tmp_path / "answers")).collect()}
    assert got == {"1.2": ("CT", 40, None), "1.3": ("PT", None, None), "1.4": ("CT", 7, 9)}
    for n in (5, 2):
        inventory.write_report(spark.range(n).select("id", F.concat(F.lit("a,"), F.col("id").cast("string")).alias("text")).coalesce(1), str(tmp_path / "report"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "report"))
    assert sorted(map(tuple, back.collect())) == [("0", "a,0"), ("1", "a,1")]


def test_small_files_share_a_frame():
    """A frame a file made many small files slow; a large file is still alone."""
    rows = [{"file": str(i), "voxels": np.zeros(n, np.float32)} for i, n in enumerate([64] * 100 + [20000] + [64] * 5)]
    got = list(nifti.frames(iter(rows), 80000))
    assert [f for frame in got for f in frame["file"]] == [str(i) for i in range(106)] and len(got) <= 4
