"""Byte-level BPE: recursive queries encode the distinct pieces of each task, ordered aggregation decodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymark.llm import tokens
from tallymark.llm.common import chunks

#: Pieces, and runs of ids, after which a worker starts anew; distinct pieces of one recursive query; bytes of text of one round.
KEPT, SLICE, ROUND = 650_000, 50_000, 16 << 20
#: Longer pieces (in bytes) take one contraction per round of the query, so they leave it for a heap.
LONG = 256
#: Ids that one decoding query aggregates.
DECODED = 400_000

_ENCODE = """
WITH RECURSIVE step(w, ids) AS (
  SELECT w, ids FROM words
  UNION ALL
  SELECT step.w, step.ids[:best.b % 1024 - 1] || [(best.b // 1024)::INTEGER] || step.ids[best.b % 1024 + 2:]
  FROM step JOIN (
    SELECT w, min(rank * 1024 + pos) AS b
    FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS pos FROM step) AS pairs
    JOIN merges USING (l, r)
    GROUP BY w
  ) AS best USING (w)
)
SELECT w, arg_min(ids, len(ids)) AS ids FROM step GROUP BY w ORDER BY w
"""

_DECODE = """
SELECT d, string_agg(latin, '' ORDER BY pos) AS latin
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM docs) AS positions JOIN vocabulary USING (id)
GROUP BY d
"""


@lru_cache(maxsize=2)
def _database(path: str) -> tuple[duckdb.DuckDBPyConnection, np.ndarray]:
    """In this worker: the merge table (left id, right id, rank), the vocabulary and each byte's id.

    Merging a pair gives the token of their joined bytes, so its rank is that token's id.
    """
    ranks = tokens.ranks(path)
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    left, right, rank = (pa.array(c, pa.int32()) for c in zip(*rows))
    base = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
    base.register("m", pa.table({"l": left, "r": right, "rank": rank.cast(pa.int64())}))
    base.execute("CREATE TABLE merges AS SELECT * FROM m")
    base.register("v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "latin": [t.decode("latin-1") for t in ranks]}))
    base.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
    return base, np.array([ranks[bytes([b])] for b in range(256)], np.int32)


def _contract(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Leftmost minimum-rank contraction of one long piece with a heap of pairs."""
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
    heapify(heap)
    gone = bytearray(len(ids))
    while heap:
        rank, i, pair = heappop(heap)
        j = after[i]
        if gone[i] or j >= len(ids) or (ids[i], ids[j]) != pair:
            continue
        ids[i], gone[j], after[i] = rank, 1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(ids) and (ids[a], ids[b]) in merges:
                heappush(heap, (merges[ids[a], ids[b]], a, (ids[a], ids[b])))
    return [t for t, dead in zip(ids, gone) if not dead]


@lru_cache(maxsize=1)
def _merges(path: str) -> dict[tuple[int, int], int]:
    return {(a, b): r for a, b, r in _database(path)[0].execute("SELECT l, r, rank FROM merges").fetchall()}


def encode_pieces(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each distinct piece, four bytes each."""
    base, byte_ids = _database(path)
    ranks, out = tokens.ranks(path), [None] * len(words)
    open_ = []
    for k, word in enumerate(words):
        if word in ranks:
            out[k] = ranks[word].to_bytes(4, "little")
        elif len(word) > LONG:
            out[k] = np.array(_contract(byte_ids[np.frombuffer(word, np.uint8)].tolist(), _merges(path)), np.int32).tobytes()
        else:
            open_.append(k)
    for at in range(0, len(open_), SLICE):
        some = open_[at:at + SLICE]
        raw = [words[k] for k in some]
        offsets = np.cumsum([0] + [len(x) for x in raw]).astype(np.int32)
        ids = byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        base.register("words", pa.table({"w": pa.array(range(len(some)), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}))
        found = base.sql(_ENCODE).to_arrow_table().column("ids").combine_chunks()
        for k, ids in zip(some, _slices(found.flatten().to_numpy().tobytes(), 4 * found.value_lengths().to_numpy())):
            out[k] = ids
    return out


def _slices(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0] + ends, ends)]


class _Numbers(dict):
    """Numbers keys in the order they are met."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class _Known:
    """In this worker: numbers of pieces and of runs of ids, and what each stands for. Both start
    anew between batches once they have grown to their bound."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.pieces, self.flat, self.lengths = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.runs, self.decoded = _Numbers(), []

    def encode(self, texts: Iterator[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > KEPT or len(self.runs) > KEPT:
            self.forget()
        find, number = tokens.pieces().findall, self.pieces.__getitem__
        cut = [np.array(list(map(number, find(t))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        new = encode_pieces([p.encode() for p in islice(self.pieces, len(self.lengths), None)], self.path)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(new), np.int32)])
        self.lengths = np.concatenate([self.lengths, np.array([len(x) // 4 for x in new], np.int64)])
        starts = np.cumsum(self.lengths) - self.lengths
        return [self._gathered(starts, c) for c in cut]

    def _gathered(self, starts: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Ids of the numbered pieces one after the other."""
        sizes = self.lengths[cut]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts[cut] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        opens, number = _opens(self.path), self.runs.__getitem__
        cut = [np.array(list(map(number, _runs(ids, opens))), np.int32) if len(ids) else np.zeros(0, np.int32) for ids in lists]
        self.decoded += _decode_runs(list(islice(self.runs, len(self.decoded), None)), self.path)
        known = self.decoded.__getitem__
        return [b"".join(map(known, c.tolist())) for c in cut]


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    return _Known(path)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    return _known(path).encode(texts)


def decode_lists(lists: list[np.ndarray], path: str) -> list[bytes]:
    """Bytes of every list of ids; equal runs of ids are decoded once."""
    return _known(path).decode(lists)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _runs(ids: np.ndarray, opens: np.ndarray) -> list[bytes]:
    """Ids in runs that begin where a token begins with a space or mark, each run as bytes."""
    cuts = (np.flatnonzero(opens[ids[1:]]) + 1) * 4
    return _slices(ids.tobytes(), np.diff(cuts, prepend=0, append=4 * len(ids)))


@lru_cache(maxsize=2)
def _opens(path: str) -> np.ndarray:
    ranks = tokens.ranks(path)
    opens = np.zeros(max(ranks.values()) + 1, bool)
    opens[[r for t, r in ranks.items() if t[0] < 0x80 and not t[:1].isalnum()]] = True
    return opens


def _decode_runs(runs: list[bytes], path: str) -> list[bytes]:
    """Bytes of every run: position rows join the vocabulary and are aggregated in order.

    Decoding is token by token, so a very long run may be taken in parts.
    """
    base, out, most = _database(path)[0], [], 4 * DECODED
    owners, parts = list(range(len(runs))), runs
    if any(len(r) > most for r in runs):
        owners, parts = zip(*((k, r[i:i + most]) for k, r in enumerate(runs) for i in range(0, len(r), most)))
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        offsets = np.r_[0, np.cumsum(sizes[at:stop] // 4)].astype(np.int32)
        ids = pa.array(np.frombuffer(b"".join(parts[at:stop]), np.int32))
        base.register("docs", pa.table({"d": pa.array(range(stop - at), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(offsets), ids)}))
        latin = base.sql(_DECODE + " ORDER BY d").to_arrow_table().column("latin")
        out += _slices("".join(latin.to_pylist()).encode("latin-1"), pc.utf8_length(latin).to_numpy())
        at = stop
    if parts is runs:
        return out
    whole = [[] for _ in runs]
    for k, x in zip(owners, out):
        whole[k].append(x)
    return [b"".join(x) for x in whole]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without special tokens.

    Text is cut by the vocabulary's pattern; every distinct piece of a task is encoded once. Null and
    empty texts have no ids. Repeated rows are encoded each. With ``decoded``, a column of that name
    holds what the ids decode to, from the same pass.
    """
    path = path or tokens.default_path()
    rows = docs.select(doc_id, text)
    more = [T.StructField(decoded, T.BinaryType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, ROUND):
                ids = encode_texts((x.as_py() for x in part.column(1)), path)
                columns = [part.column(0), _lists(ids)] + ([pa.array(decode_lists(ids, path), pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, name, *(f.name for f in more)])

    return rows.mapInArrow(run, T.StructType([rows.schema[doc_id], T.StructField(name, T.ArrayType(T.IntegerType())), *more]))


def decode(rows: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that lists of ids stand for. Null and empty lists give no
    bytes; null ids inside a list are skipped; an id outside the vocabulary is an error."""
    path = path or tokens.default_path()
    rows = rows.select(doc_id, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.array([i for i in x or [] if i is not None], np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decode_lists(lists, path), pa.binary())], names=[doc_id, ids, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())]))
