"""Image files: which are whole, and a folder of them as a stream."""

import os
import struct
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vecloom import schema
from vecloom.functions import vec
from vecloom.operators import centroids as cen
from vecloom.operators import incremental as inc
from vecloom.sources import images, scan
from vecloom.sources.tables import Store
from vecloom.streaming import arrivals as arr
from vecloom.streaming import uploads as up


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(note: bytes = b"", width: int = 5, height: int = 4) -> bytes:
    """A grey picture; `note` travels in a text chunk."""
    rows = b"".join(b"\0" + bytes((7 * x + 3 * y) % 256 for x in range(width)) for y in range(height))
    packed = zlib.compress(rows)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return images._PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"faces\0" + note) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


def jpeg() -> bytes:
    segment = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xC0, b"\x08\0\x04\0\x05\x01\x01\x11\0") + segment(0xDA, b"\x01\x01\0\0\x3f\0") + b"pixels\xff\0more\xff\xd0even\xff\0more" + b"\xff\xd9"


def test_whole_files():
    bmp = b"BM" + struct.pack("<I", 40) + bytes(34)
    webp = b"RIFF" + struct.pack("<I", 12) + b"WEBPVP8 1234"
    for raw in (png(), png(b"x" * 1000), png() + b"\0\0", jpeg(), jpeg() + b"trailer", bmp, webp):
        assert images.fault(raw) is None


def test_every_cut_shows():
    for raw in (png(b"note"), jpeg()):
        assert all(images.fault(raw[:n]) for n in range(len(raw)))


def test_damage_in_the_middle_shows():
    raw = png(b"note")
    for at in range(8, len(raw) - 12):
        assert images.fault(raw[:at] + bytes([raw[at] ^ 0x55]) + raw[at + 1 :]), at
    short = images._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"too few")) + chunk(b"IEND", b"")
    assert images.fault(short) == "png: pixels are missing"
    assert images.fault(b"<html>") and images.fault(b"") and images.fault(None) and images.fault(b"\xff\xd8\xff\xd9")


def test_broken_images_are_left_out(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    files = {"a.png": png(), "cut.png": png()[:-6], "hit.png": png()[:60] + b"!" + png()[61:], "b.jpg": jpeg(), "text.jpg": b"<html>"}
    for name, raw in files.items():
        (tmp_path / "ann" / name).write_bytes(raw)
    names = lambda df: sorted(os.path.basename(r["image_path"]) for r in df.collect())
    assert names(scan.valid_images(spark, f"file://{tmp_path}", whole=True)) == ["a.png", "b.jpg"]
    assert len(names(scan.valid_images(spark, f"file://{tmp_path}"))) == 5


def detector():
    """Faces are what the note of the picture says: numbers, one face each; `bad` is a file that the model fails on."""

    def run(raw: bytes) -> list[dict]:
        note = raw.split(b"faces\0")[1].split(b"|")[0]
        return [{"bbox": [0.0, 0.0, float(x), 1.0], "landmarks": [[0.0, 0.0]] * 5, "det_score": 0.9} for x in note.split(b",") if x]

    return run


def aligner():
    return lambda raw, box, points: struct.pack("<d", box[2])


def extractor():
    def run(crop: bytes) -> np.ndarray:
        x = struct.unpack("<d", crop)[0]
        return np.array([np.cos(x), np.sin(x), 0.25])

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this file
MODELS = up.Models(detector, aligner, extractor)


def note(angles) -> bytes:
    return b",".join(str(a).encode() for a in angles) + b"|"


def test_a_folder_of_files_decides_like_their_vectors(spark, tmp_path):
    members = spark.createDataFrame([("r", i, i // 3, [float(np.cos(a)), float(np.sin(a)), 0.25]) for i, a in enumerate([0.0, 0.05, 0.1, 2.0, 2.05, 2.1])], "run_label string, face_id long, cluster_label int, vector array<double>")
    members = members.withColumn("vector", vec.l2_normalize(F.col("vector")))
    cents = cen.centroids(members)
    store = Store(spark, f"file://{tmp_path}/store")
    arr.prepare(store, members, cents)
    inbox = tmp_path / "in"
    inbox.mkdir()
    waves = [{"a.png": [0.06], "b.png": [2.03, 0.7], "c.png": []}, {"d.png": [4.0, 4.02], "e.png": ["bad"], "f.png": [0.02]}]
    queue, seq, start = [], 0, int(time.time()) - 1000  # a file source passes over files that are much older than others
    for wave in waves:
        for name, angles in wave.items():
            (inbox / name).write_bytes(png(note(angles)))
        (inbox / f"broken-{len(queue)}.png").write_bytes(png(note([1.0]))[:-20])
        for name in wave:  # one after the other, as they arrive
            os.utime(inbox / name, (start + seq, start + seq))
            for i, a in enumerate(wave[name]):
                if a != "bad":
                    queue.append((seq * 10 + i, name, i, [float(np.cos(a)), float(np.sin(a)), 0.25]))
            seq += 1
        up.start(up.uploads(spark, f"file://{inbox}"), store, f"file://{tmp_path}/check", MODELS, "r", available_now=True).awaitTermination()
    df = spark.createDataFrame([("r", s, f"file:{inbox}/{n}", i, v) for s, n, i, v in queue], "run_label string, seq long, path string, face_index int, vector array<double>")
    df = df.select("run_label", "seq", F.xxhash64("path", "face_index").bitwiseAND(F.lit(2**63 - 1)).alias("face_id"), vec.l2_normalize(F.col("vector")).alias("vector"))
    rows = lambda d: sorted((r["face_id"], r["status"], r["cluster_label"], round(r["distance"], 6)) for r in d.collect())
    want = rows(inc.sequential(df, members, cents, grow=True))
    assert rows(store.read("decisions")) == want and len(want) == 6 and {s for _, s, _, _ in want} >= {"auto_merge", "new_cluster"}
    reasons = {os.path.basename(r["path"]): r["reason"] for r in store.read("rejected").collect()}
    assert set(reasons) == {"broken-0.png", "broken-3.png", "e.png"} and reasons["e.png"].startswith("ValueError")
    again = spark.read.format("binaryFile").load(f"file://{inbox}")
    before = {t: store.read(t).count() for t in ("members", "decisions", "rejected")}
    up.apply_uploads(store, again, 1, MODELS, "r")  # delivered again
    assert {t: store.read(t).count() for t in before} == before
    assert schema.NOISE not in {r["cluster_label"] for r in store.read("members").collect()}
    with pytest.raises(FileNotFoundError):
        store.read("nothing")
