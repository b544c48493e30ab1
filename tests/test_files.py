"""Sniffing, image sizes and the catalogue on hand-made bytes."""

import random
import struct

from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import catalogue as cat
from gridweave.operators import media

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
GIF = b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0" * 10
JPEG = (b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xff\xdb" + struct.pack(">H", 4) + b"ab"
        + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 400) + b"\0" * 12)
LOSSY = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 320 | 0x4000, 240) + b"\0" * 4
LOSSLESS = b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", (100 - 1) | ((50 - 1) << 14)) + b"\0" * 8
EXTENDED = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (1000 - 1).to_bytes(3, "little") + (700 - 1).to_bytes(3, "little") + b"\0" * 4
FILES = [
    ("a.png", PNG, "image/png", (640, 480)), ("b", GIF, "image/gif", (10, 20)), ("c.dat", JPEG, "image/jpeg", (400, 300)),
    ("d", LOSSY, "image/webp", (320, 240)), ("e", LOSSLESS, "image/webp", (100, 50)), ("f", EXTENDED, "image/webp", (1000, 700)),
    ("g.wav", b"RIFF\0\0\0\0WAVEfmt " + b"\xff" * 20, "audio/x-wav", None), ("h.docx", b"PK\x03\x04 rest",
     "application/vnd.openxmlformats-officedocument.wordprocessingml.document", None), ("i.bin", b"PK\x03\x04 rest", "application/zip", None),
    ("j", b"  <!DOCTYPE", "text/plain", None), ("k", b"<!docType HTML><p>", "text/html", None), ("l", b"%PDF-1.4", "application/pdf", None),
    ("m.mp4", b"\xff\x00\xfe", "video/mp4", None), ("n", b"\xff\x00\xfe", "application/octet-stream", None), ("o", b"", "text/plain", None),
    ("p", "é".encode() * 40, "text/plain", None), ("q", b"x" + "é".encode() * 40, "text/plain", None), ("r.png", PNG[:20], "image/png", None),
    ("s", b"{\"a\": 1}", "application/json", None),
]


def test_sniff_and_size(spark):
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, (n, c, _, _) in enumerate(FILES)], "i int, name string, content binary")
    df = df.withColumn("mime", cat.sniff(F.col("content"), F.col("name"))["mime"])
    rows = media.media_metadata(df).orderBy("i").collect()
    for r, (name, _, mime, size) in zip(rows, FILES):
        assert r["mime"] == mime, name
        assert ((r["width"], r["height"]) if r["width"] else None) == size, name
        assert r["status"] == ("ok" if size else "ok_no_dim"), name


def test_jpeg_size_behind_long_segments(spark):
    def segment(marker, n):
        return b"\xff" + bytes([marker]) + struct.pack(">H", n + 2) + b"\xff\xc0\0\x11" * (n // 4) + b"x" * (n % 4)
    jpegs = [JPEG[:2] + b"".join(segment(*x) for x in longs) + JPEG[2:]
             for longs in ([(0xE1, 6000)], [(0xE1, 65_533), (0xE2, 65_533), (0xE2, 40_001), (0xFE, 9)], [(0xED, 4070)])]
    df = spark.createDataFrame([(i, bytearray(c), "image/jpeg") for i, c in enumerate(jpegs)], "i int, content binary, mime string")
    assert [(r.width, r.height, r.status) for r in media.media_metadata(df).orderBy("i").collect()] == [(400, 300, "ok")] * 3
    assert [r.status for r in media.media_metadata(df, head_bytes=5000).orderBy("i").collect()] == ["ok_no_dim", "ok_no_dim", "ok"]


def test_free_ids_fill_gaps(spark):
    rnd = random.Random(1)
    used = sorted(rnd.sample(range(1, 60), 25))
    old = spark.createDataFrame([(f"{u:08x}",) for u in used] + [("not an id",)], "id string")
    new = spark.createDataFrame([(i * 5,) for i in range(40)], "seq bigint")
    got = [r["id"] for r in cat.free_ids(new, "seq", old).orderBy("seq").collect()]
    free = (n for n in range(1, 1000) if n not in used)
    assert got == [f"{next(free):08x}" for _ in range(40)]


def test_absorb_lists_records_and_paths(spark):
    known = cat.register(spark.createDataFrame([(1, bytearray(b"one"), "one.txt")], "seq bigint, content binary, name string"))
    fid = known.first()["id"]
    rows = spark.createDataFrame([(1, fid), (2, f'{{"id": "{fid}", "name": "x"}}'), (3, f'["{fid}", "/tmp/a.png", "other"]'), (4, "/tmp/a.png"),
                                  (5, "plain"), (6, None), (7, '{"path": "/tmp/a.png"}')], "_rid bigint, f string")
    listing = spark.createDataFrame([("file:///tmp/a.png", bytearray(PNG)), ("file:/tmp/unused", bytearray(b"u"))], "path string, content binary")
    done = cat.absorb_output_files(rows, known, listing, "f", "run:9")
    new = done.registered.collect()
    assert len(new) == 1 and new[0]["mime"] == "image/png" and new[0]["id"] != fid and new[0]["source"] == "run:9"
    nid = new[0]["id"]
    assert [r["f"] for r in done.rows.orderBy("_rid").collect()] == [fid, fid, f'["{fid}","{nid}","other"]', nid, "plain", None, nid]


def test_delete_refuses_used_files(spark):
    c = cat.register(spark.createDataFrame([(i, bytearray(b"same" if i < 3 else b"x%d" % i), f"f{i}") for i in range(1, 6)],
                                           "seq bigint, content binary, name string"))
    ids = {r["name"]: r["id"] for r in c.collect()}
    ds = model.as_dataset(spark.createDataFrame([(1, [ids["f1"], ids["f3"]]), (2, [ids["f3"]])], "_rid bigint, F array<string>"))
    wanted = spark.createDataFrame([(ids["f1"], True), (ids["f3"], False), (ids["f4"], False), ("ffffffff", True)], "id string, force boolean")
    out = cat.delete_files(c, wanted, cat.references({"d": ds}))
    assert sorted(r["name"] for r in out["catalogue"].collect()) == ["f2", "f3", "f5"]
    assert [(r["id"], r["uses"]) for r in out["refused"].collect()] == [(ids["f3"], 2)]
    assert out["orphans"].count() == 1  # f4 only: the bytes of f1 live on in f2


def test_view_text_is_cut(spark):
    df = spark.createDataFrame([("text/plain", bytearray(b"abcdef")), ("image/png", bytearray(b"x")), ("application/json", bytearray(b"{}"))], "mime string, content binary")
    assert [r["view"] for r in cat.view_text(df, 4).collect()] == ["abcd\n… [truncated]", None, "{}"]
