"""Picture files: what their headers tell, in DataFrame expressions.

``picture_info`` reads format, width and height of PNG, GIF, BMP and JPEG files from a
``binaryFile`` scan. The contents stay in the JVM, row by row: no Python worker
holds a batch of whole pictures. A JPEG's segments are walked by a fold over at
most ``MOST_SEGMENTS`` of them (a file with more before its frame is told as
``no_size``).

Defined results: other contents are ``not_a_picture``, a picture that ends before
its size ``no_size``, an empty content ``empty``; these rows stay, with the reason
and without a size. (Spark's file scan itself leaves files without a byte out, so
their products are those without a picture.)
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import local_path, ship_package

MOST_SEGMENTS = 64


def _hex(content: Column, at: Column | int, n: int) -> Column:
    place = at if isinstance(at, Column) else F.lit(at)
    return F.hex(F.substring(content, place, F.lit(n)))


def _number(text: Column) -> Column:
    return F.when(text != "", F.conv(text, 16, 10).cast("int"))


def _big(content: Column, at: Column | int, n: int) -> Column:
    text = _hex(content, at, n)
    return F.when(F.length(text) == 2 * n, _number(text))


def _little(content: Column, at: int, n: int) -> Column:
    text = F.concat(*[_hex(content, at + i, 1) for i in range(n - 1, -1, -1)])
    return F.when(F.length(text) == 2 * n, _number(text))


def _jpeg_size(content: Column) -> Column:
    """struct(at, width, height): the frame header's size; ``at`` is 0 where it was found."""
    def step(s: Column, _: Column) -> Column:
        marker, length = _hex(content, s["at"], 2), _big(content, s["at"] + 2, 2)
        frame = marker.rlike("^FFC[0-9A-F]$") & ~marker.isin("FFC4", "FFC8", "FFCC")
        height, width = _big(content, s["at"] + 5, 2), _big(content, s["at"] + 7, 2)
        none = F.lit(None).cast("int")
        return (F.when(s["at"] <= 0, s)
                .when(frame & width.isNotNull() & height.isNotNull(), F.struct(F.lit(0).alias("at"), width.alias("width"), height.alias("height")))
                .when(marker.startswith("FF") & (length >= 2) & ~frame,
                      F.struct((s["at"] + 2 + length).alias("at"), none.alias("width"), none.alias("height")))
                .otherwise(F.struct(F.lit(-1).alias("at"), none.alias("width"), none.alias("height"))))
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SEGMENTS)), start, step)


def picture_info(files: DataFrame) -> DataFrame:
    """(id, length, format, width, height, fault) of each file of a ``binaryFile`` scan; the id is the file's name
    without its ending."""
    content, head = F.col("content"), _hex(F.col("content"), 1, 8)
    kind = (F.when(head == "89504E470D0A1A0A", "png").when(head.rlike("^47494638(37|39)61"), "gif")
            .when(head.startswith("424D"), "bmp").when(head.startswith("FFD8FF"), "jpeg"))
    found = files.select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("id"), "length", content, kind.alias("format"))
    jpeg = F.when(F.col("format") == "jpeg", _jpeg_size(content))
    found = found.withColumn("jpeg", jpeg)
    size = {}
    for name, png, gif, bmp in (("width", 17, 7, 19), ("height", 21, 9, 23)):
        size[name] = (F.when(F.col("format") == "png", _big(content, png, 4)).when(F.col("format") == "gif", _little(content, gif, 2))
                      .when(F.col("format") == "bmp", F.abs(_little(content, bmp, 4))).otherwise(F.col(f"jpeg.{name}")))
    found = found.select("id", "length", "format", size["width"].alias("width"), size["height"].alias("height"))
    whole = F.col("width").isNotNull() & F.col("height").isNotNull()
    fault = (F.when(F.col("length") == 0, "empty").when(F.col("format").isNull(), "not_a_picture").when(~whole, "no_size"))
    return found.select("id", "length", "format", F.when(whole, F.col("width")).alias("width"),
                        F.when(whole, F.col("height")).alias("height"), fault.alias("fault"))


def write_picture_files(pictures: DataFrame, folder: str, ending: str = "jpg") -> int:
    """One file ``{id}.{ending}`` for each row (id, content) in a mounted shared folder; returns how many. A file gets
    its name when it is whole, and a repeated task writes the same."""
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"picture files are written to a mounted folder, not to {folder}")
    ship_package(pictures.sparkSession)
    root = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                attempt = f"{root}/.{uuid.uuid4().hex}"
                with open(attempt, "wb") as out:
                    out.write(content.as_py() or b"")
                os.replace(attempt, f"{root}/{name.as_py()}.{ending}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = pictures.select(F.col("id").cast("string"), F.col("content").cast("binary")).filter("id IS NOT NULL")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
