"""Sizes from picture headers, against files made by hand."""

import struct

from vitrine.sources import files, pictures


def jpeg(width, height, segments=1, sof=0xC0, cut=None):
    body = b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 2 + n) + b"x" * n for n in range(segments))
    body += bytes([0xFF, sof]) + struct.pack(">HBHH", 17, 8, height, width) + b"\x03" + b"rest"
    return body[:cut]


def test_headers_of_all_formats(spark, tmp_path):
    made = {
        "png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 70000, 3) + b"x", ("png", 70000, 3, None)),
        "gif": (b"GIF87a" + struct.pack("<HH", 65535, 2), ("gif", 65535, 2, None)),
        "bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 640, 480) + b"x", ("bmp", 640, 480, None)),
        "jpeg": (jpeg(800, 600), ("jpeg", 800, 600, None)),
        "progressive": (jpeg(801, 601, 9, 0xC2), ("jpeg", 801, 601, None)),
        "many": (jpeg(5, 6, 63), ("jpeg", 5, 6, None)),
        "too_many": (jpeg(5, 6, 70), ("jpeg", None, None, "no_size")),
        "tables_first": (jpeg(5, 6)[:2] + b"\xff\xc4\x00\x04ab" + jpeg(7, 8)[2:], ("jpeg", 7, 8, None)),
        "cut": (jpeg(5, 6, 1, cut=10), ("jpeg", None, None, "no_size")),
        "cut_png": (b"\x89PNG\r\n\x1a\n\0\0", ("png", None, None, "no_size")),
        "text": (b"hello", (None, None, None, "not_a_picture")),
    }
    for name, (content, _) in made.items():
        (tmp_path / f"{name}.jpg").write_bytes(content)
    got = {r.id: r for r in pictures.picture_info(files.read_picture_files(spark, str(tmp_path))).collect()}
    for name, (content, want) in made.items():
        assert (got[name].format, got[name].width, got[name].height, got[name].fault) == want, name
        assert got[name].length == len(content)
    none = spark.createDataFrame([("/x/none.jpg", 0, b"")], "path string, length long, content binary")
    assert [(r.id, r.fault) for r in pictures.picture_info(none).collect()] == [("none", "empty")]


def test_written_files_read_back(spark, tmp_path):
    rows = [("a", b"one"), ("b", b""), ("c", None), (None, b"lost")]
    df = spark.createDataFrame(rows, "id string, content binary")
    assert pictures.write_picture_files(df, str(tmp_path / "p")) == 3
    back = files.read_picture_files(spark, str(tmp_path / "p")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in back) == [("a.jpg", b"one")]
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["a.jpg", "b.jpg", "c.jpg"]      # empty ones aren't scanned
