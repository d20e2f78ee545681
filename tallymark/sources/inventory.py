"""File inventory, file types and encodings."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension to file type.
FILE_TYPES = {"csv": "csv", "txt": "text", "xml": "xml", "xlsx": "xlsx", "xls": "xls", "docx": "docx", "pdf": "pdf"}

#: Bytes of a file that a task holds at once.
CHUNK = 4 << 20


def file_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    mapping = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, extension), F.lit("unknown"))


def detected_encoding(content: Column, declared: Column | None = None) -> Column:
    """Declared, else byte-order mark, else strict UTF-8, else windows-1252."""
    head = F.hex(F.substring(content, 1, 3))
    found = (
        F.when(head.startswith("FFFE") | head.startswith("FEFF"), "UTF-16").when(head == "EFBBBF", "UTF-8-BOM")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")
    )
    return found if declared is None else F.coalesce(declared, found)


def relative_path(path: Column, root: str) -> Column:
    """Path below the root; the scanned path carries a scheme and may be percent-encoded."""
    scheme, _, rest = root.partition(":")
    # A root in a store is matched by what follows its scheme; a plain path is one of this machine.
    inside = rest.lstrip("/") if rest and len(scheme) > 1 and scheme.isalnum() else Path(root).resolve().as_posix()
    marker = inside.rstrip("/") + "/"
    return F.substring_index(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), marker, -1)


def binary_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).withColumn("source_path", relative_path(F.col("path"), root))


def inventory(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Every file with its size, hash, type and encoding, in path order.

    The listing reads no content; files of no bytes are not listed, as Spark's readers pass over them. Files are dealt to tasks, and each is read once in chunks, so a file
    of any size is hashed in bounded memory. Roots whose file system has no client outside Spark are read by
    Spark's binary reader, which holds a file whole.
    """
    if not _streamable(root):
        return binary_files(spark, root).select(
            F.col("source_path").alias("path"), file_type(F.col("source_path")).alias("file_type"), F.col("length").alias("byte_size"),
            F.sha2("content", 256).alias("sha256"), detected_encoding(F.col("content")).alias("encoding")).orderBy("path")
    listed = binary_files(spark, root).select("path", "source_path", "length").repartition(tasks or max(1, spark.sparkContext.defaultParallelism), "path")
    read = listed.mapInArrow(_hashed, "path string, byte_size long, sha256 string, encoding string")
    return read.select("path", file_type(F.col("path")).alias("file_type"), "byte_size", "sha256", "encoding").orderBy("path")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and place of a path or URI; Spark writes local ones with one slash."""
    scheme, colon, rest = path.partition(":")
    if colon and len(scheme) > 1 and scheme != "file":
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), unquote("/" + rest.lstrip("/") if scheme == "file" else path)


def _streamable(root: str) -> bool:
    try:
        _opened(root)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, place = _opened(path)
            with store.open_input_stream(place) as stream:
                rows.append((source, *digest_of(stream)))
        names = ["path", "byte_size", "sha256", "encoding"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def digest_of(stream: BinaryIO, chunk: int = CHUNK) -> tuple[int, str, str]:
    """(bytes, sha256, encoding) of a stream read in chunks."""
    size, digest, head, decoder = 0, hashlib.sha256(), b"", codecs.getincrementaldecoder("utf-8")()
    valid = True
    while part := stream.read(chunk):
        size, head = size + len(part), (head + part[:3])[:3]  # a read may return fewer bytes than asked for
        digest.update(part)
        if valid:
            valid = _decodes(decoder, part, False)
    valid = valid and _decodes(decoder, b"", True)
    encoding = "UTF-16" if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else "UTF-8-BOM" if head == codecs.BOM_UTF8 else "UTF-8" if valid else "windows-1252"
    return size, digest.hexdigest(), encoding


def _decodes(decoder: codecs.IncrementalDecoder, part: bytes, final: bool) -> bool:
    try:
        decoder.decode(part, final)
        return True
    except UnicodeDecodeError:
        return False


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
