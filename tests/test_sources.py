"""Sources, sinks, labels and the stream."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.functions import boxes
from gradus.operators import labels
from gradus.sources import sinks, tables, tarshards
from gradus.streaming import ingest


def test_csv_with_a_mark_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Image ID, Finding \nx1, mass\n x2 ,\n", encoding="utf-8")
    df = tables.resolved(tables.read_csv(spark, str(tmp_path / "a.csv")), {"image_id": ["id"], "finding": []}, ["image_id"])
    assert [(r.image_id, r.finding) for r in df.collect()] == [("x1", "mass"), ("x2", None)]
    with pytest.raises(ValueError):
        tables.resolved(df, {"split": ["fold"]}, ["split"])


def test_csv_casts_what_it_can(spark, tmp_path):
    (tmp_path / "a.csv").write_text("severity,prob\n1,0.5\nx,\n")
    schema = T.StructType([T.StructField("severity", T.IntegerType()), T.StructField("prob", T.DoubleType())])
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), schema).collect()] == [(1, 0.5), (None, None)]


def test_models_by_file_name(spark, tmp_path):
    (tmp_path / "resnet18_s42_degradation_results.csv").write_text("logit\n1.0\n")
    r = tables.read_models(spark, str(tmp_path / "*.csv"), T.StructType([T.StructField("logit", T.DoubleType())])).first()
    assert (r.arch, r.seed, r.logit) == ("resnet18", 42, 1.0)


def test_lists_and_discovery(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a.dcm\n\n# no\n b.dcm \n")
    assert [r.path for r in tables.image_list(spark, str(tmp_path / "l.txt")).collect()] == ["a.dcm", "b.dcm"]
    (tmp_path / "l.tsv").write_text("file\tx\nc.dcm\t1\n")
    assert tables.image_list(spark, str(tmp_path / "l.tsv")).first().path == "c.dcm"
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("d/b.dcm", "d/e/a.DICOM", "d/x.png"):
        (tmp_path / n).write_bytes(b"x")
    found = tables.discover(spark, str(tmp_path / "d")).orderBy("idx").collect()
    assert [(r.idx, r.path.rsplit("/", 1)[-1]) for r in found] == [(0, "b.dcm"), (1, "a.DICOM")]


def test_manifest_needs_its_split(spark):
    df = spark.createDataFrame([("a", "test")], "image_id string, split string")
    assert tables.manifest(df, "test").count() == 1
    with pytest.raises(ValueError):
        tables.manifest(df, "val")


def shard(path, names):
    with tarfile.open(path, "w") as tar:
        for n, body in names:
            info = tarfile.TarInfo(n)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def npy(x):
    b = io.BytesIO()
    np.save(b, x)
    return b.getvalue()


def test_tar_shards(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    shard(tmp_path / "0.tar", [("i1.npy", npy(x)), ("i1.json", json.dumps({"label": 1}).encode()), ("i2.json", b"{}"), ("i2.npy", npy(x)), ("bad.npy", b"no"), ("bad.json", b"{}")])
    shard(tmp_path / "1.tar", [("i3.npy", npy(x))])
    paths = [str(tmp_path / f"{k}.tar") for k in (0, 1)]
    got = {r.image_id: r for r in tarshards.read_shards(spark, paths).collect()}
    assert set(got) == {"i1", "i2", "i3", "bad"} and got["bad"].error and got["i3"].sidecar is None
    assert (np.frombuffer(got["i1"].data, "<f4").reshape(got["i1"].h, got["i1"].w) == x).all()
    assert json.loads(got["i1"].sidecar) == {"label": 1}
    assert tarshards.read_shards(spark, paths, index=True).where("data is null").count() == 4


def test_unions_and_results(spark, tmp_path):
    u = sinks.union_by_name([spark.range(1).toDF("b"), spark.range(1).toDF("a")])
    assert u.columns == ["a", "b"] and u.count() == 2
    df = spark.createDataFrame([(1, "blur", "OK", None), (2, None, "ERROR", "bad")], "image_id long, degradation_type string, processing_status string, error_message string")
    sinks.write_results(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/errors")).first().error_message == "bad"
    assert spark.read.parquet(str(tmp_path / "r/results")).count() == 1
    assert "| a |" in sinks.markdown([(1,)], ["a"])


def test_stream_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.range(100).withColumn("severity", (F.col("id") % 31).cast("int"))
    df.where("id < 50").write.parquet(src)
    ingest.ingest(spark, src, df.schema, out, cp)
    assert ingest.ingested(spark, out).count() == 50
    df.where("id >= 50").write.mode("append").parquet(src)
    ingest.ingest(spark, src, df.schema, out, cp)
    ingest.ingest(spark, src, df.schema, out, cp)
    assert sorted(r.id for r in ingest.ingested(spark, out).collect()) == list(range(100))


def test_birads(spark):
    rows = spark.createDataFrame([("BI-RADS 4",), (" BI-RADS 5 ",), ("unknown",), ("",), (None,)], "t string").select("t", labels.birads(F.col("t")).alias("g"))
    got = rows.select("g", labels.label_at_least(F.col("g"), 4).alias("l")).collect()
    assert [r.g for r in got] == [4, 5, None, None, None] and [r.l for r in got] == [1, 1, 0, 0, 0]


def test_many_to_one_refuses_repeats(spark):
    left = spark.range(3).toDF("k")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    assert labels.many_to_one(left, right.where("v <> 'c'"), "k").where("v is null").count() == 1
    with pytest.raises(Exception, match="repeats"):
        labels.many_to_one(left, right, "k").collect()


def test_index_and_restart(spark):
    df = spark.createDataFrame([(f"p{k:03d}",) for k in range(50)], "path string").repartition(5)
    got = labels.stable_index(df, "path").orderBy("idx").collect()
    assert [(r.idx, r.path) for r in got] == [(k, f"p{k:03d}") for k in range(50)]
    work, done = spark.range(4).toDF("image_id"), spark.createDataFrame([(0,)] * 31 + [(1,)] * 30, "image_id long")
    assert [r.image_id for r in labels.unfinished(work, done, "image_id").orderBy("image_id").collect()] == [1, 2, 3]


def test_box_columns(spark):
    df = spark.createDataFrame([((10, 10, 20, 20),)], "b struct<x1:int,y1:int,x2:int,y2:int>")
    b = df.select(boxes.scaled(F.col("b"), 1.5, F.lit(100), F.lit(100)).alias("s"), boxes.clip(boxes.box(F.lit(200), F.lit(0), F.lit(210), F.lit(5)), F.lit(100), F.lit(100)).alias("c")).first()
    assert tuple(b.s) == (8, 8, 22, 22) and b.c is None


def png_bytes(x, bits, filters):
    import struct
    import zlib

    h, w = x.shape
    raw = x.astype(">u2" if bits == 16 else "u1").view("u1").reshape(h, -1).astype(int)
    step, lines, above = bits // 8, b"", [0] * raw.shape[1]
    for y in range(h):
        f, out = filters[y % len(filters)], []
        for i, v in enumerate(raw[y]):
            a, b, c = (raw[y][i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= min(abs(p - b), abs(p - c)) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, paeth][f]) % 256)
        lines += bytes([f, *out])
        above = raw[y]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def dicom_bytes(x, photometric, implicit=False):
    import struct

    def element(group, tag, kind, value, implicit):
        value += b"\0" * (len(value) % 2)
        if implicit:
            return struct.pack("<HHI", group, tag, len(value)) + value
        if kind in (b"OW", b"SQ"):
            return struct.pack("<HH2sHI", group, tag, kind, 0, len(value)) + value
        return struct.pack("<HH2sH", group, tag, kind, len(value)) + value

    syntax = b"1.2.840.10008.1.2" + (b"" if implicit else b".1")
    body = [(0x8, 0x70, b"LO", b"ACME"), (0x28, 0x4, b"CS", photometric), (0x28, 0x10, b"US", struct.pack("<H", x.shape[0])), (0x28, 0x11, b"US", struct.pack("<H", x.shape[1])), (0x28, 0x30, b"DS", b"0.1\\0.07"), (0x28, 0x100, b"US", b"\x10\0"), (0x28, 0x103, b"US", b"\0\0"), (0x28, 0x1052, b"DS", b"5"), (0x28, 0x1053, b"DS", b"2"), (0x7FE0, 0x10, b"OW", x.astype("<u2").tobytes())]
    return b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", syntax, False) + b"".join(element(*e, implicit) for e in body)


def test_image_files(spark, tmp_path):
    from gradus.sources import images

    x = np.random.default_rng(0).integers(0, 250, (6, 5))
    (tmp_path / "a.png").write_bytes(png_bytes(x, 8, [0, 1, 2, 3, 4]))
    (tmp_path / "b.PNG").write_bytes(png_bytes(x * 200, 16, [4, 3, 2, 1, 0]))
    (tmp_path / "c.dcm").write_bytes(dicom_bytes(x, b"MONOCHROME2"))
    (tmp_path / "d.dicom").write_bytes(dicom_bytes(x, b"MONOCHROME1", implicit=True))
    (tmp_path / "e.npy").write_bytes(npy(x[None].astype(float)))
    (tmp_path / "f.dcm").write_bytes(b"nothing")
    got = {r.image_id: r for r in images.read_images(spark, str(tmp_path)).collect()}
    pixels = {k: np.frombuffer(r.data, "<f4").reshape(r.h, r.w) for k, r in got.items() if r.data is not None}
    assert (pixels["a"] == x).all() and (pixels["b"] == x * 200).all() and (pixels["e"] == x).all()
    assert (pixels["c"] == 2 * x + 5).all() and (pixels["d"] == (2 * x).max() - 2 * x).all()
    assert got["c"].pixel_spacing_mm == 0.07 and got["d"].manufacturer == "ACME" and "DICOM" in got["f"].error


def test_plan_in_sql(spark):
    from gradus.plans import degradation

    degradation.register_udtf(spark)
    assert spark.sql("select t.* from range(2), lateral expand_plan() t").count() == 62
