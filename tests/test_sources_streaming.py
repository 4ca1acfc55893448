import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filewright.sources import catalogue, images
from filewright.streaming import settle


def png(width, height, colour, depth, rows, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (9, 13)).astype(np.uint8)
    w, h, back = images.decode_gray(images.encode_gray(13, 9, gray.tobytes()))
    assert (w, h) == (13, 9) and np.array_equal(back, gray)
    for kind in range(5):
        rgb = rng.integers(0, 256, (4, 5, 3)).astype(int)
        flat, out = rgb.reshape(4, 15), b""
        for y in range(4):
            line = []
            for x in range(15):
                a = flat[y, x - 3] if x >= 3 else 0
                b = flat[y - 1, x] if y else 0
                c = flat[y - 1, x - 3] if y and x >= 3 else 0
                p = a + b - c
                paeth = min((a, b, c), key=lambda v: abs(p - v))
                line.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            out += bytes([kind, *line])
        _, _, got = images.decode_gray(png(5, 4, 2, 8, out))
        assert np.array_equal(got, (rgb @ np.array([299, 587, 114]) + 500) // 1000)


@pytest.mark.parametrize("data", [b"", b"nonsense", images.SIGNATURE, images.encode_gray(3, 3, bytes(9))[:-20], png(2, 2, 0, 3, b"")])
def test_broken_images_have_reasons(spark, data):
    (row,) = spark.createDataFrame([(data,)], "content binary").select(images.gray_of("content").alias("g")).collect()
    assert row.g.width is None and row.g.reason


def test_signatures_and_thumbnails(spark):
    gray = np.tile(np.arange(0, 180, 2, dtype=np.uint8), (40, 1))
    assert images.dhash(gray) == -1 and images.dhash(gray[:, ::-1]) == 0
    assert np.array_equal(images.resize(np.array([[0, 255]], np.uint8), 1, 1), [[128]])
    data = images.encode_gray(90, 40, gray.tobytes())
    rows = spark.createDataFrame([(data,), (b"x",)], "content binary").select(images.png_size(F.col("content")).alias("size"), images.gray_of("content").alias("g"))
    got = rows.select("size", images.dhash_of("g.width", "g.height", "g.gray").alias("h"), images.png_of("g.width", "g.height", "g.gray").alias("p")).collect()
    assert tuple(got[0].size) == (90, 40) and got[0].h == -1 and images.decode_gray(bytes(got[0].p))[2].shape == (40, 90)
    assert got[1].size is None and got[1].h is None and got[1].p is None


def test_catalogue_of_a_folder(spark, tmp_path):
    for name, body in {"a.txt": b"x", "b.part": b"y", "e.txt": b"", ".hid/z.txt": b"z", "Secrets/q.js": b"q", "id_rsa.bak": b"k", "d1/d2/d3/d4/deep.txt": b"d", "d1/ok.PDF": b"p"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    files = catalogue.admitted(catalogue.walk(spark, str(tmp_path)), str(tmp_path))
    got = {r.name: r for r in catalogue.inspected(files, F.current_timestamp()).collect()}
    assert sorted(got) == ["a.txt", "b.part", "ok.PDF"]  # the source lists no empty files
    assert got["ok.PDF"].ext == ".pdf" and got["a.txt"].sha256 and not got["b.part"].sha256 and got["b.part"].partial and got["a.txt"].recent
    assert catalogue.admitted(catalogue.walk(spark, str(tmp_path)), str(tmp_path), max_files=2).count() == 2


def events():
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    return [
        ("grow", 1, at(0), False, at(0)), ("grow", 2, at(1), False, at(1)), ("grow", 2, at(1), False, at(2)), ("grow", 2, at(1), False, at(3)),
        ("quick", 5, at(0), False, at(0)), ("quick", 5, at(0), False, at(0.5)), ("quick", 5, at(0), False, at(1)),
        ("gone", None, None, True, at(0)), ("gone", None, None, True, at(2)), ("back", None, None, True, at(0)), ("back", 3, at(1), False, at(1)), ("back", 3, at(1), False, at(3)),
        ("once", 1, at(0), False, at(0)),
    ]


WANT = [("back", 3, False, 3.0), ("gone", None, True, 2.0), ("grow", 2, False, 2.0), ("quick", 5, False, 1.0)]


def seen(rows):
    return sorted((r.path, r.size, r.gone, (r.settled_at - dt.datetime(2024, 1, 1)).total_seconds()) for r in rows)


def test_settling_in_batch(spark):
    assert seen(settle.settled_batch(spark.createDataFrame(events(), settle.EVENTS)).collect()) == WANT


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[4])
    for n in range(0, len(rows), 4):
        spark.createDataFrame(rows[n : n + 4], settle.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(settle.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = settle.settled(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    assert seen(spark.read.parquet(str(tmp_path / "out")).collect()) == WANT
