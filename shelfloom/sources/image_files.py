"""Image files as a source: checked by name, size and head before anything is decoded.

The type is first what the name says, as a server would declare it, and the size is
that of the file system, so files of other types or sizes are not opened: Spark's
``binaryFile`` reader gets the predicates. Of the others only the first bytes are
looked at. Nothing is decoded here.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.functions import images, text

#: Bytes that an image has at least and at most, and the types that are taken.
LEAST_BYTES = 10 * 1024
MOST_BYTES = 4 * 1024 * 1024
SUPPORTED = ("image/jpeg", "image/png", "image/webp")
#: Type by the ending of a name.
ENDINGS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "avif": "image/avif", "svg": "image/svg+xml", "html": "text/html"}
#: Bytes that are looked at.
HEAD = 64 * 1024


def declared(path: Column) -> Column:
    """The type that a name's ending says, in any case; ``application/octet-stream`` for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, ending), F.lit("application/octet-stream"))


def webp_size(content: Column) -> Column:
    """struct(width, height) of a WebP head of any of its three kinds; nulls for others."""
    h = F.hex(F.substring(content, 1, 30))
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    kind, plus = F.substring(h, 25, 8), lambda *at: sum((byte(i) * 256**k for k, i in enumerate(at)), F.lit(0))
    webp = h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250")
    lossy, lossless, extended = webp & (kind == "56503820") & (F.substring(h, 47, 6) == "9D012A"), webp & (kind == "5650384C") & (F.substring(h, 41, 2) == "2F"), webp & (kind == "56503858")
    bits = plus(21, 22, 23, 24).cast("bigint")
    low = lambda *at: plus(*at).bitwiseAND(0x3FFF)
    return F.struct(
        F.when(lossy, low(26, 27)).when(lossless, (bits.bitwiseAND(0x3FFF) + 1).cast("int")).when(extended, plus(24, 25, 26) + 1).alias("width"),
        F.when(lossy, low(28, 29)).when(lossless, (F.shiftrightunsigned(bits, 14).bitwiseAND(0x3FFF) + 1).cast("int")).when(extended, plus(27, 28, 29) + 1).alias("height"),
    )


def scan(spark: SparkSession, path: str, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, mime, width, height, status): one row for each file under a folder; the reader leaves out files without a byte.

    ``mime`` is what the first bytes say (null for none). Status is the first that holds:
    ``UNSUPPORTED_MIME_TYPE_<declared>``, ``FILE_SIZE_EXCEEDS_LIMIT_<bytes>``,
    ``FILE_SIZE_BELOW_MINIMUM_<bytes>``, ``NOT_AN_IMAGE`` (other first bytes than those of
    a supported type), ``CORRUPT_HEADER`` (no sizes above zero), ``VERIFICATION_SUCCESS``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = declared(F.col("path")).isin(*SUPPORTED)
    sized = F.col("length").between(least, most)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shut = files.filter(~(named & sized)).select("path", "length", none("string", "mime"), none("int", "width"), none("int", "height"))
    opened = files.filter(sized).filter(named).select("path", "length", F.substring("content", 1, HEAD).alias("head"))
    # the size of a JPEG is behind markers, the others' at a fixed place
    typed = opened.withColumn("mime", text.mime_by_magic(F.col("head")))
    fixed, webp, jpeg = text.image_dimensions(F.col("head")), webp_size(F.col("head")), images.jpeg_dimensions(F.when(F.col("mime") == "image/jpeg", F.col("head")))
    known = typed.withColumn("_jpeg", jpeg).select("path", "length", "mime", *[F.coalesce(fixed[c], webp[c], F.col(f"_jpeg.{c}")).alias(c) for c in ("width", "height")])
    size = F.col("length").cast("string")
    status = (
        F.when(~named, F.concat(F.lit("UNSUPPORTED_MIME_TYPE_"), declared(F.col("path"))))
        .when(F.col("length") > most, F.concat(F.lit("FILE_SIZE_EXCEEDS_LIMIT_"), size))
        .when(F.col("length") < least, F.concat(F.lit("FILE_SIZE_BELOW_MINIMUM_"), size))
        .when(~F.coalesce(F.col("mime").isin(*SUPPORTED), F.lit(False)), "NOT_AN_IMAGE")
        .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "CORRUPT_HEADER")
        .otherwise("VERIFICATION_SUCCESS")
    )
    return shut.union(known).withColumn("status", status)


def write(df: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """A file for each row, in a folder that ``pyarrow.fs`` opens; (name, length) of what was written.

    A file appears under its name when it is whole, so a task that runs twice leaves
    it once. Rows without a name or content are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, wrote = batch.column("name").to_pylist(), []
            for label, raw in zip(names, batch.column("content").to_pylist(), strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(raw)
                store.move(part, f"{root}/{os.path.basename(label)}")
                wrote.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(wrote, pa.int64())], names=["name", "length"])

    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).filter("name is not null and content is not null")
    return rows.mapInArrow(run, "name string, length bigint")
