"""Token ids as flat binary files with document offsets, written in parallel and read back by memory maps.

A corpus is a folder of shards. Shard k has three files: ``ids`` holds the ids of its documents one
after the other as unsigned little-endian integers of one width; ``offsets`` holds little-endian 64-bit
integers, the place in the shard of every document's first id and, last, the place behind the
shard; ``names`` is an Arrow file with the documents' own ids. Documents are range-partitioned, so shards
follow each other in ascending order of the document id, and a shard's base, its place in the whole
corpus, is the prefix sum of the ids before it. The manifest, a table of one row a shard, names files
and bases. A task that is run again writes files of new names, and only those of the run that counted
are in the manifest.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallymark.llm.common import chunks, text_bytes
from tallymark.session import materialize, shared_folder

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Bytes of text a shard is made for, and words a task remembers with their ids.
SHARD_BYTES, KEPT = 256 << 20, 200_000
_MARKS = frozenset(b".,;:!?")
#: A mark of punctuation between a letter (ASCII or Latin-1, without the signs × and ÷) or digit and white space.
#: The mark comes first in the pattern, so a text is searched for marks and not tried at every byte.
_AFTER_WORD = re.compile(rb"[.,;:!?](?=[ \t\n\v\f\r])(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Words of small letters (ASCII or Latin-1), which neither the normaliser nor the splitting into pieces changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Bytes of text split into words at once.
CHUNK = 1 << 20
#: Documents of one batch of a reader.
ROWS = 4096


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


class WordEncoder(dict):
    """Ids of whole texts by a vocabulary that folds case, drops white space and never merges across it.

    A text's ids are those of its words between ASCII white space, and one mark of punctuation behind a
    letter or digit is a piece of its own. So the library gets each distinct word without such a mark once,
    or again when it was not met among the last ``KEPT`` new ones. Words of small letters are one piece
    as they are and go straight to the library's merges, all others through its whole pipeline.
    """

    def __init__(self, path: str, width: str) -> None:
        self.tokenizer, self.before = _tokenizer(path), {}
        self.merge, size = self.tokenizer.model.tokenize, np.dtype(width).itemsize
        self.bytes_of = [i.to_bytes(size, "little") for i in range(max(self.tokenizer.get_vocab(True).values()) + 1)]
        self.letters = _byte_letters()
        self.direct = all(self._merged(w) == self._library(w) for w in map(str.encode, _PROBES))

    def _library(self, word: bytes) -> bytes:
        return b"".join([self.bytes_of[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])

    def _merged(self, word: bytes) -> bytes:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
        return b"".join([self.bytes_of[t.id] for t in self.merge(text)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.direct and _LETTERS(word):
                ids = self._merged(word)
            else:
                stem, mark = _stem(word)
                if mark:
                    return self[stem] + self[mark]
                ids = self._library(word)
        self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > KEPT:  # what is still in use comes back from the words before
            self.before = dict(self)
            self.clear()
        find = self.__getitem__
        # A special token's spelling counts as written, so texts that may hold one keep their case.
        return [b"".join(map(find, _AFTER_WORD.sub(rb" \g<0>", t if b"<|" in t else t.lower()).split())) for t in texts]


#: Words by which an encoder finds out whether a vocabulary takes small letters as they are.
_PROBES = ("a", "the", "hello", "straße", "naïveté", "ærøskøbing", "þýðing", "qzxjkvw", "internationalisierung")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """A word without its last mark of punctuation, if that follows a letter or digit, and the mark."""
    if word[-1] in _MARKS and len(word) > 1:
        before = word[-2:-1] if word[-2] < 128 else word[:-1].decode()[-1].encode()
        last = before.decode().lower()
        if last.isalpha() or last.isascii() and last.isdigit():
            return word[:-1], word[-1:]
    return word, b""


def width_of(path: str, end: int = END) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    return "<u2" if max(_tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, n, ids): the ids of every whole text and the end id, as bytes, in the order of the rows."""
    path = path or public_tokenizers.path(VOCABULARY)
    width = width_of(path, end)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    last = np.array([end], width).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, width)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                ids = [i + last for i in encoder.encode(text_bytes(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // int(width[2:]) for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]))


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; executors and the driver see the same files."""
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, shards: int | None = None) -> DataFrame:
    """Write all documents as shards below ``folder`` and return the manifest.

    Null and empty texts consist of the end id. Null document ids come first, rows of one id in the
    order of their texts' hash, repeated rows each. No documents give an empty manifest. Extra columns
    are ignored, whatever they are called. ``folder`` must be one that all executors share; by default
    it is a new one beside the checkpoints. Manifest: shard, n_docs, n_tokens, width, files, base.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    width = width_of(path, end)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    # The texts are moved once, and each task encodes and writes its shard in one pass over them.
    order = ["doc_id", "_hash", "_any"]  # the last only spreads equal rows, whose order does not matter
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_any": F.monotonically_increasing_id()})
    ordered = encoded(keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order), path=path, end=end)
    schema = "shard int, n_docs long, n_tokens long, width string, files string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), out, at, held = _place(folder), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                shard = batch.column(3)[0].as_py()
                name = f"shard-{shard:07d}-{uuid.uuid4().hex}"
                store.create_dir(root, recursive=True)
                ids, offsets, raw = (store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "offsets", "names"))
                out = pa.ipc.new_file(raw, pa.schema([batch.schema.field(0)]))
            lengths = batch.column(1).to_numpy()
            offsets.write((at + np.cumsum(lengths) - lengths).astype("<i8").tobytes())
            for value in batch.column(2):
                ids.write(value.as_buffer())
            out.write_batch(batch.select([0]))
            at, held = at + int(lengths.sum()), held + batch.num_rows
        if out is not None:
            offsets.write(np.array([at], "<i8").tobytes())
            for stream in (out, raw, ids, offsets):
                stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held], pa.int64()), pa.array([at], pa.int64()), pa.array([width]), pa.array([f"{folder}/{name}"])],
                                             names=["shard", "n_docs", "n_tokens", "width", "files"])

    written = materialize(ordered.select("doc_id", "n", "ids", F.spark_partition_id().alias("shard")).mapInArrow(run, schema))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return materialize(written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


class Shard:
    """One shard's files, memory-mapped where they lie on a file system of the machine."""

    def __init__(self, files: str, width: str, base: int = 0) -> None:
        store, root = _place(files)
        local = isinstance(store, fs.LocalFileSystem)
        self.ids, self.starts = (np.memmap(f"{root}.{kind}", np.dtype(t), "r") if local else np.frombuffer(store.open_input_file(f"{root}.{kind}").read(), t)
                                 for kind, t in (("ids", width), ("offsets", "<i8")))
        self.base = base
        self.names = pa.ipc.open_file(pa.memory_map(f"{root}.names") if local else store.open_input_file(f"{root}.names"))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard."""
        return self.ids[self.starts[k]:self.starts[k + 1]]


def read(manifest: DataFrame, ids: bool = False, digest: bool = True) -> DataFrame:
    """One row per document, read from the files of a manifest: doc_id, start, n_tokens, and if asked
    ids_crc32 (of the ids as little-endian 32-bit integers) and the ids themselves."""
    spark = manifest.sparkSession
    first = manifest.select("files").first()
    kind = _name_field(first["files"]) if first else T.LongType()
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())]
                          + [T.StructField("ids_crc32", T.LongType())] * digest + [T.StructField("ids", T.ArrayType(T.LongType()))] * ids)
    if first is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for files, width, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard, at = Shard(files, width, base), 0
                for k in range(shard.names.num_record_batches):
                    names = shard.names.get_batch(k).column(0)
                    for low in range(0, len(names), ROWS):
                        some = names.slice(low, ROWS)
                        starts = np.array(shard.starts[at:at + len(some) + 1])
                        columns = [some, pa.array(shard.base + starts[:-1]), pa.array(np.diff(starts))]
                        texts = range(at, at + len(some))
                        if digest:
                            columns.append(pa.array([zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in texts], pa.int64()))
                        if ids:
                            columns.append(pa.array([shard.document(i).astype(np.int64) for i in texts], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                        at += len(some)

    return manifest.select("files", "width", "base").repartitionByRange(manifest.count(), "files").mapInArrow(run, schema)  # a shard a task


def _name_field(files: str) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type
    store, root = _place(files)
    with store.open_input_file(f"{root}.names") as raw:
        return from_arrow_type(pa.ipc.open_file(raw).schema.field(0).type)
