"""Packing of tokenized documents into sequences of fixed length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import tokens
from tallymark.llm.common import chunks
from tallymark.session import materialize

SEQUENCE = 2048
END = 0
#: Pieces of at least a fifth of a sequence are placed first, longest first; shorter ones follow in
#: an order drawn from their ids, since equal lengths in a row would defeat the rule.
LONG = 5
#: Pieces of one length-balanced group that a task packs on its own.
GROUP = 50_000


def tokenize(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of every text and the end id; a null text has the end id only."""
    encoding = tokens.encoding(path)
    allowed = set(tokens.SPECIAL)
    out = []
    for text in texts:
        ids = np.frombuffer(encoding.encode_to_numpy(text or "", allowed_special=allowed), "<u4") if text else np.zeros(0, "<u4")
        out.append(np.append(ids, np.uint32(END)).astype("<u4"))
    return out


def cut(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces. The remainder comes first, the rest are full."""
    first = length % size
    starts = ([0] if first else []) + list(range(first, length, size))
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [length])]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the ids."""
    path = path or tokens.default_path()
    rows = docs.select(doc_id, text)
    schema = T.StructType([rows.schema[doc_id], T.StructField("piece", T.IntegerType()), *[
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                keys, texts = part.column(0), part.column(1).to_pylist()
                who, number, start, length, crc, ids = [], [], [], [], [], []
                for i, doc in enumerate(tokenize(texts, path)):
                    for k, (s, n) in enumerate(cut(len(doc), size)):
                        who.append(i)
                        number.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(doc[s:s + n].tobytes()))
                        if with_ids:
                            ids.append(doc[s:s + n].astype(np.int32))
                columns = [keys.take(pa.array(who, pa.int64())), pa.array(number, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                                                 names=[doc_id, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, placed in the order given.

    ``open_bins[g]`` counts the open bins whose residual gap is g. An item of length n may start a
    bin (gap size - n) or move a bin of gap g to gap g - n; it takes the move after which the sum of
    squared counts is smallest, ties to the smallest gap. Filled bins count for nothing.
    """
    open_bins = np.zeros(size + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if n >= size:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        # Moving a bin from gap g to g - n changes the sum by 2 * (count[g - n] - count[g]) + 2; into a full bin by 1 - 2 * count[g].
        change = open_bins[:size - n + 1] - open_bins[n:]
        change[0] = -open_bins[n]
        change *= 2
        change[1:] += 2
        change[0] += 1
        change[open_bins[n:] == 0] = np.iinfo(np.int64).max
        change[size - n] = 2 * open_bins[size - n] + 1  # a new bin
        to = int(change.argmin())
        if to == size - n:
            where, made = made, made + 1
        else:
            where = waiting[to + n].pop()
            open_bins[to + n] -= 1
        bins[i], offsets[i] = where, size - n - to
        if to:
            waiting[to].append(where)
            open_bins[to] += 1
    return bins, offsets


def pack(rows: DataFrame, length: str = "length", size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to every row; rows keep all their other columns.

    Full pieces are sequences by themselves and go nowhere. Shorter ones are dealt by a hash of their
    place in the written rows, so that repeated rows spread, into groups of about ``group`` rows, one
    task each. Every group sees the whole mix of lengths; a
    group ends with a few part-filled sequences, which is all that splitting costs. A length over ``size`` or below 1 is an error.
    """
    rows = materialize(rows)
    key = F.xxhash64(F.monotonically_increasing_id())
    whole = rows.where(F.col(length) == size)
    rest = rows.where(F.col(length) != size)
    counted = rest.agg(F.count(F.lit(1)), F.min(length), F.max(length)).first()
    if counted[0] and (counted[1] < 1 or counted[2] > size):
        raise ValueError(f"lengths must lie between 1 and {size}")
    groups = max(1, -(-counted[0] // group))
    schema = T.StructType([*rest.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_key", "_group", "_bin", "offset")]])

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame[length].to_numpy()
        long = lengths * LONG >= size
        frame = frame.iloc[np.lexsort((frame["_key"].to_numpy(), np.where(long, -lengths, 0), ~long))]
        bins, offsets = sum_of_squares(frame[length].to_numpy(), size)
        return frame.assign(_bin=bins, offset=offsets)

    placed = rest.withColumns({"_key": key, "_group": F.pmod(key, F.lit(groups))}).groupBy("_group").applyInPandas(place, schema)
    # Sequences of groups have even numbers, those of whole pieces odd ones.
    numbered = placed.withColumn("sequence_id", 2 * (F.col("_bin") * groups + F.col("_group"))).select(*rows.columns, "sequence_id", "offset")
    single = whole.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return numbered.unionByName(single)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its sequence and place.

    Null and empty texts are one piece that holds the end id. Repeated rows are packed each.
    """
    return pack(pieces(docs, doc_id, text, size, path, with_ids), "length", size)
