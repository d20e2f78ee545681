"""Document quality by co-training: a text view and a metadata view teach each other.

Each view has a logistic model. In every round each view labels the unlabelled documents it is surest
of, over the whole table, and the other view learns from them. At the end both are calibrated and
combined on labelled documents that neither has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import chunks, logistic, remainder, text_bytes
from tallymark.llm.quality_rules import text_signals
from tallymark.session import materialize

#: Labelled documents of each class to learn from; rounds; pseudo-labels of a round and view; how sure they must be and their weight.
PER_CLASS, ROUNDS, TAUGHT, SURE, TRUST = 4000, 3, 600, 0.95, 0.5
_LANGS, _SOURCES, _SIZES = 8, 32, 12
_TEXT, _META = 14, _LANGS + _SOURCES + _SIZES
_DIGITS, _UPPER, _MARKS, _VOWELS = b"0123456789", bytes(range(65, 91)), b".,;:!?", b"aeiouAEIOU"


def text_view(text: bytes) -> list[float]:
    """Measures of the whole text alone."""
    n, chars, symbols, dup, repeated, lines = text_signals(text)
    size, words = max(1, len(text)), text.split()
    share = lambda some: (len(text) - len(text.translate(None, some))) / size
    return [np.log1p(n) / 8, min(3.0, chars / max(1, n) / 5), 4 * symbols / max(1, chars), float(symbols > 0), dup / max(1, lines), repeated / max(1, n), min(3.0, n / max(1, lines) / 40),
            len(set(words)) / max(1, n), 4 * share(_DIGITS), 4 * share(_UPPER), 8 * share(_MARKS), share(_VOWELS), min(2.0, max(map(len, words), default=0) / 40), float(n < 50)]


def meta_view(lang: str | None, source: str | None, size: int | None) -> list[float]:
    """What is known of the page besides its text: language, source and stated size, hashed to fixed places."""
    out = [0.0] * _META
    out[crc32((lang or "").encode()) % _LANGS] = 1.0
    out[_LANGS + crc32((source or "").encode()) % _SOURCES] = 1.0
    out[_LANGS + _SOURCES + min(_SIZES - 1, max(0, int(size or 0)).bit_length() * 2 // 3)] = 1.0
    return out


def views(docs: DataFrame, doc_id: str, text: str, lang: str, source: str, size: str) -> DataFrame:
    """(row, doc_id, text_view, meta_view): both views of every document as packed floats."""
    rows = docs.select(doc_id, text, lang, source, size).withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", rows.schema[doc_id].dataType), T.StructField("text_view", T.BinaryType()), T.StructField("meta_view", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                first = [np.array(text_view(t), np.float32).tobytes() for t in text_bytes(part.column(1))]
                other = [np.array(meta_view(*m), np.float32).tobytes() for m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(5), part.column(0), pa.array(first, pa.binary()), pa.array(other, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _unpack(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, width)


def _sure(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))


@dataclass
class CoTrained:
    """Both views' weights and the combination of their calibrated log-odds."""

    text: np.ndarray
    meta: np.ndarray
    both: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = np.stack([text @ self.text[:-1] + self.text[-1], meta @ self.meta[:-1] + self.meta[-1]], 1).clip(-30, 30)
        return _sure(odds, self.both), 1 / (1 + np.exp(-odds[:, 0])), 1 / (1 + np.exp(-odds[:, 1]))


def _surest(pool: DataFrame, text: np.ndarray, meta: np.ndarray, most: dict[int, int]) -> list[tuple[int, int, bytes, bytes]]:
    """(view, label, text_view, meta_view) of the unlabelled documents each view is surest of.

    Equally sure documents (to the hundredth) are taken in the order of a hash, so that copies of one
    text do not fill the places. A task passes on no more than the number asked for of each kind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {(v, y): [] for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, first, other = (batch.column(i).to_pylist() for i in range(3))
            for v, (x, beta) in enumerate(((_unpack(first, _TEXT), text), (_unpack(other, _META), meta))):
                p = _sure(x, beta)
                for y in (0, 1):
                    sure = p if y else 1 - p
                    mine = [(-round(float(sure[i]), 2), crc32(str(rows[i]).encode()), rows[i], first[i], other[i]) for i in np.flatnonzero(sure >= SURE)]
                    held[v, y] = sorted(held[v, y] + mine)[:most[y]]
        out = [(v, y, *r) for (v, y), rows in held.items() for r in rows]
        cols = list(zip(*out)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["view", "label", "sure", "mixed", "row", "text_view", "meta_view"])

    found = materialize(pool.select("row", "text_view", "meta_view").mapInArrow(run, "view int, label int, sure double, mixed long, row long, text_view binary, meta_view binary"))
    out = []
    for v in (0, 1):
        for y in (0, 1):
            kept = found.where((F.col("view") == v) & (F.col("label") == y)).orderBy("sure", "mixed", "row").limit(most[y])
            out += [(v, y, r["text_view"], r["meta_view"]) for r in kept.collect()]
    return out


def fit(seen: DataFrame, labels: DataFrame, quality: str = "quality", label_id: str = "doc_id", per_class: int = PER_CLASS, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on views whose held-out documents have been left out.

    At most ``per_class`` labelled documents of each class are used, the same on every run; a quarter
    of them calibrates. Of several labels of an id the smallest counts. Unlabelled documents take part
    in every round, all of them. With one class or no labels both views give the smoothed share of
    good documents.
    """
    marked = labels.where(F.col(quality).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg((F.min(quality) > 0).cast("int").alias("good"))
    joined = materialize(seen.join(marked, "doc_id", "left"))
    sizes = {r["good"]: r["n"] for r in joined.where("good is not null").groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (sizes.get(1, 0) + 5) / (sum(sizes.values()) + 10)
    flat = float(np.log(share / (1 - share)))
    if len(sizes) < 2:
        return CoTrained(np.zeros(_TEXT + 1), np.zeros(_META + 1), np.array([0.0, 0.0, flat]))
    rows = [r for k in (0, 1) for r in joined.where(F.col("good") == k).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "row").limit(per_class).collect()]
    first, other = _unpack([r["text_view"] for r in rows], _TEXT), _unpack([r["meta_view"] for r in rows], _META)
    y, hold = np.array([r["good"] for r in rows], float), np.array([r["h"] % 4 == 0 for r in rows])
    weight = np.array([sizes[int(v)] / max(1, (y == v).sum()) for v in y])
    weight = weight / weight.mean()
    pool = joined.where("good is null")
    most = {1: max(1, round(TAUGHT * share)), 0: max(1, round(TAUGHT * (1 - share)))}
    lessons: list[tuple[int, int, bytes, bytes]] = []

    def learn(view: int) -> np.ndarray:
        """A view learns from the labels and from what the other view has taught."""
        own, width = (first, _TEXT) if view == 0 else (other, _META)
        mine = [r for r in lessons if r[0] != view]
        x = np.concatenate([own[~hold], _unpack([r[2 + view] for r in mine], width)])
        return logistic(x, np.r_[y[~hold], [r[1] for r in mine]], np.r_[weight[~hold], np.full(len(mine), TRUST)])

    text, meta = learn(0), learn(1)
    for _ in range(rounds):
        lessons += _surest(pool, text, meta, most)
        text, meta = learn(0), learn(1)
    odds = np.stack([first @ text[:-1] + text[-1], other @ meta[:-1] + meta[-1]], 1).clip(-30, 30)
    use = hold if 0 < y[hold].sum() < hold.sum() else ~hold
    return CoTrained(text, meta, logistic(odds[use], y[use], weight[use]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", size: str = "n_chars",
                   quality: str = "quality", threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: better), text_score, meta_score and kept.

    Documents whose id has crc32 modulo 5 equal to 0 teach nothing. Null texts count as empty, null
    metadata as values of their own. Repeated rows are scored each. Extra columns are ignored.
    """
    seen = materialize(views(docs, doc_id, text, lang, source, size))
    model = fit(seen.where(~held_out()), labels, quality, rounds=rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.scores(_unpack(batch.column(1).to_pylist(), _TEXT), _unpack(batch.column(2).to_pylist(), _META))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(f.astype(np.float64)) for f in found]], names=["doc_id", "score", "text_score", "meta_score"])

    schema = T.StructType([seen.schema["doc_id"], *[T.StructField(n, T.DoubleType()) for n in ("score", "text_score", "meta_score")]])
    scored = seen.select("doc_id", "text_view", "meta_view").mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= threshold).alias("kept"))
