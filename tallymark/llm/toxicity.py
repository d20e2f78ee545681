"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels mark whole documents, so tokens are labelled from them: in a toxic document the tokens whose
word or beginning is much commoner in toxic than in other documents are toxic, all others are not.
The field has two states per token, weights for words and beginnings, and transition weights. Its
forward-backward marginals give the spans; their sum, largest value and density, calibrated on
documents the field has not seen, give the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import chunks, free_names, logistic, remainder
from tallymark.session import materialize

#: Labelled documents of each class that the model is fitted on, taken in the order of a hash of their ids.
PER_CLASS = 2500
#: Words and beginnings the field may weigh, and how much commoner in toxic documents they must be.
FEATURES, LIFT, LEAST = 6000, 8.0, 4
BEGINNINGS = (3, 4, 5, 6, 7)
#: What a filter leaves of the documents that are not toxic.
CLEAN = 0.97
SEGMENT = 128
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…*_-"
_TOKEN = re.compile(r"\S+")
_KEPT = 300_000


def word_of(token: str) -> str:
    return token.strip(_EDGE).lower()


def features_of(word: str) -> list[str]:
    """The word itself and its proper beginnings."""
    return ["=" + word] + [word[:n] for n in BEGINNINGS if len(word) > n] if word else []


@dataclass
class Field:
    """Weights of the fitted field and of the calibration; ``weights`` is bounded by FEATURES."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    start: tuple[float, float] = (0.0, 0.0)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0)
    intercept: float = -3.0
    cut: float = 0.5  # the score from which a filter drops a document

    def evidence(self, token: str) -> float | None:
        """What a token's own features add to the toxic state; None if it has none."""
        found = pick(word_of(token), self.weights)
        return sum(self.weights[f] for f in found) if found else None


def pick(word: str, known) -> list[str]:
    """The features of a word that count: itself and its longest known beginning."""
    have = [f for f in features_of(word) if f in known]
    return [f for f in have if f[0] == "="] + [f for f in have if f[0] != "="][-1:]


class Tagger:
    """Marginals of whole texts; tokens without evidence are skipped over in closed form."""

    def __init__(self, model: Field) -> None:
        self.model = model
        self.step = np.exp(np.array(model.move)) * np.exp([0.0, model.bias])  # transition, then a token without evidence
        values, vectors = np.linalg.eig(self.step)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        self.ratio, back = values[1] / values[0], np.linalg.inv(vectors)
        self.main, self.rest = np.outer(vectors[:, 0], back[0]), np.outer(vectors[:, 1], back[1])
        self.seen: dict[str, float] = {}

    def power(self, n: int) -> np.ndarray:
        """step ** n up to a factor."""
        return self.main + self.ratio ** n * self.rest

    def evidence(self, words: list[str]) -> np.ndarray:
        seen, missing = self.seen, self.model.evidence
        if len(seen) > _KEPT:
            seen.clear()
        for w in set(words).difference(seen):
            e = missing(w)
            seen[w] = np.nan if e is None else e
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def marginals(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Positions with evidence, their probability of being toxic, and the sum over all others."""
        n, at = len(evidence), np.flatnonzero(~np.isnan(evidence))
        first = np.exp(self.model.start) * np.exp([0.0, self.model.bias])
        if not n:
            return at, np.zeros(0), 0.0
        toxic = first @ np.ones(2)
        resting = self._resting()
        if not len(at):
            return at, np.zeros(0), n * resting
        boost = np.exp(np.clip(evidence[at], -30, 30))
        ahead, gaps = np.empty((len(at), 2)), np.diff(at, prepend=0)
        now = first / toxic
        for k, gap in enumerate(gaps.tolist()):
            if gap:
                now = now @ self.power(gap)
            now = now * (1.0, boost[k])
            now = now / now.sum()
            ahead[k] = now
        behind = np.empty((len(at), 2))
        after = self.power(n - 1 - at[-1]).sum(1) if n - 1 > at[-1] else np.ones(2)
        for k in range(len(at) - 1, -1, -1):
            behind[k] = after = after / after.sum()
            if k:
                after = self.power(int(gaps[k])) @ (after * (1.0, boost[k]))
        joint = ahead * behind
        return at, joint[:, 1] / joint.sum(1), (n - len(at)) * resting

    def _resting(self) -> float:
        """Probability of the toxic state far from any evidence."""
        return float(self.main[0, 1] * self.main[1, 0] / max(1e-300, self.main[0, 0] * self.main[0, 0] + self.main[0, 1] * self.main[1, 0]))

    def measures(self, evidence: np.ndarray) -> tuple[tuple[float, float, float], np.ndarray, np.ndarray]:
        at, p, _ = self.marginals(evidence)
        total = float(p.sum())
        return (np.log1p(4 * total), float(p.max(initial=0.0)), 10 * total / np.sqrt(len(evidence) + 25.0)), at, p

    def score(self, measures: tuple[float, float, float]) -> float:
        z = self.model.intercept + sum(a * b for a, b in zip(self.model.calibration, measures))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sequences(docs: DataFrame, text: str, known: dict[str, float], toxic: str) -> list[tuple[int, int, list[int], list[str]]]:
    """(toxic, tokens, positions, features joined by a space) of the sampled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out = []
            for value, label in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(toxic)).to_pylist()):
                words = (value or "").split()
                hits = [(i, f) for i, w in enumerate(words) if (f := pick(word_of(w), known))]
                out.append((label, len(words), [i for i, _ in hits], [" ".join(f) for _, f in hits]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.string()))],
                                             names=["toxic", "n", "at", "found"])
    rows = docs.select(text, toxic).mapInArrow(run, "toxic int, n long, at array<long>, found array<string>").collect()
    return [tuple(r) for r in rows]


def _mined(docs: DataFrame, text: str, toxic: str, sizes: tuple[int, int]) -> dict[str, float]:
    """Features much commoner in toxic documents, and the words that begin like them but are not; each with its lift."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for value, label in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(toxic)).to_pylist()):
                found = sorted({f for w in {word_of(t) for t in (value or "").split()} for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["feature", "toxic"])

    lift = (F.col("pos") + 0.5) / (sizes[1] + 1.0) / ((F.col("neg") + 0.5) / (sizes[0] + 1.0))
    counts = materialize(docs.select(text, toxic).mapInArrow(run, "feature string, toxic int").groupBy("feature")
                         .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST).withColumn("lift", lift))
    strong = counts.where((F.col("lift") >= LIFT) & (F.col("pos") >= LEAST)).orderBy(F.desc(F.col("pos") - LIFT * F.col("neg")), "feature").limit(FEATURES // 2).collect()
    known = {r["feature"]: r["lift"] for r in strong}
    begin = [f for f in known if f[0] != "="]
    plain = F.lit(False)
    for n in BEGINNINGS:
        some = [f for f in begin if len(f) == n]
        if some:
            plain = plain | F.substring("feature", 2, n).isin(some)
    if begin:
        exceptions = counts.where(F.col("feature").startswith("=") & (F.col("lift") < LIFT) & plain).orderBy(F.desc("neg"), "feature").limit(FEATURES // 2).collect()
        known |= {r["feature"]: r["lift"] for r in exceptions}
    return known


def fit_field(sequences: list[tuple[int, int, list[int], list[str]]], lifts: dict[str, float], rounds: int = 150) -> Field:
    """Maximum conditional likelihood by gradient ascent over segments of SEGMENT tokens.

    Segments without any evidence are all alike and enter once with their number.
    """
    names = sorted(lifts)
    number = {f: i for i, f in enumerate(names)}
    rows, cols, feats, labels, blank = [], [], [], [], 0
    count = 0
    for toxic, n, at, found in sequences:
        segment = {}
        for i, joined in zip(at, found):
            segment.setdefault(i // SEGMENT, []).append((i % SEGMENT, joined.split(" ")))
        blank += -(-n // SEGMENT) - len(segment)
        for hits in segment.values():
            for col, fs in hits:
                rows.append(count)
                cols.append(col)
                labels.append(int(bool(toxic) and lifts[fs[0]] >= LIFT))
                feats.append([number[fs[0]], number[fs[-1]] if len(fs) > 1 else -1])
            count += 1
    if not count:
        return Field()
    rows, cols, feats, y = np.array(rows), np.array(cols), np.array(feats), np.array(labels, float)
    weight = np.r_[np.ones(count), float(blank)]
    gold = np.zeros((SEGMENT, count + 1))
    gold[cols, rows] = y
    pairs = np.array([[((1 - gold[:-1] if a == 0 else gold[:-1]) * (1 - gold[1:] if b == 0 else gold[1:]) * weight).sum() for b in (0, 1)] for a in (0, 1)])
    params = {"w": np.zeros(len(names) + 1), "b": np.array([-4.0]), "m": np.zeros((2, 2)), "s": np.zeros(2)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    for turn in range(1, rounds + 1):
        emit = np.full((SEGMENT, count + 1), params["b"][0])
        emit[cols, rows] += params["w"][feats[:, 0]] + params["w"][feats[:, 1]]
        marginal, both = _posterior(emit, params["m"], params["s"])
        grad = {"b": np.array([((gold - marginal) * weight).sum()]), "m": pairs - np.array([[(both[a][b] * weight).sum() for b in (0, 1)] for a in (0, 1)]) - 0.1 * params["m"],
                "s": np.array([0.0, ((gold[0] - marginal[0]) * weight).sum()]) - 0.1 * params["s"], "w": -0.02 * params["w"]}
        off = y - marginal[cols, rows]
        np.add.at(grad["w"], feats[:, 0], off)
        np.add.at(grad["w"], feats[:, 1], np.where(feats[:, 1] >= 0, off, 0.0))
        grad["w"][-1] = 0.0
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] + 0.15 * (first[k] / (1 - 0.9 ** turn)) / (np.sqrt(second[k] / (1 - 0.99 ** turn)) + 1e-8)
    return Field(dict(zip(names, params["w"].tolist())), float(params["b"][0]), tuple(params["s"].tolist()), tuple(map(tuple, params["m"].tolist())))


def _posterior(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list]:
    """Forward-backward over all segments at once: P(toxic) per token, and expected transitions per segment."""
    steps, width = emit.shape
    m, boost = np.exp(move), np.exp(np.clip(emit, -30, 30))
    ahead, behind = np.empty((steps, 2, width)), np.empty((steps, 2, width))
    a0, a1 = np.full(width, np.exp(start[0])), np.exp(start[1]) * boost[0]
    for t in range(steps):
        if t:
            a0, a1 = a0 * m[0, 0] + a1 * m[1, 0], (a0 * m[0, 1] + a1 * m[1, 1]) * boost[t]
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        ahead[t] = a0, a1
    b0 = b1 = np.ones(width)
    both = [[np.zeros(width), np.zeros(width)], [np.zeros(width), np.zeros(width)]]
    for t in range(steps - 1, -1, -1):
        behind[t] = b0, b1
        if t:
            e0, e1 = b0, b1 * boost[t]
            joint = [[ahead[t - 1, a] * m[a, b] * (e0, e1)[b] for b in (0, 1)] for a in (0, 1)]
            total = sum(joint[a][b] for a in (0, 1) for b in (0, 1))
            for a in (0, 1):
                for b in (0, 1):
                    both[a][b] += joint[a][b] / total
            b0, b1 = m[0, 0] * e0 + m[0, 1] * e1, m[1, 0] * e0 + m[1, 1] * e1
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
    joint = ahead * behind
    return joint[:, 1] / joint.sum(1), both


def best_cut(scores: np.ndarray, toxic: np.ndarray, clean: float = CLEAN) -> float:
    """Of the cuts that leave at least the share ``clean`` of the other documents below them, the one that
    most toxic documents reach, of equal ones the largest; 0.5 at most. A toxic passage in a long text
    scores low, so a filter spends what it may on the recall."""
    cuts = np.unique(np.append(scores, 0.5))
    kept = np.array([(scores[~toxic] < c).mean() for c in cuts])
    caught = np.array([(scores[toxic] >= c).mean() for c in cuts])
    good = np.flatnonzero(kept >= clean)
    if not len(good):
        return 0.5
    at = good[np.flatnonzero(caught[good] == caught[good].max())[-1]]
    below = cuts[at - 1] if at else 0.0
    return float(min(0.5, (cuts[at] + below) / 2)) if (scores[~toxic] < (cuts[at] + below) / 2).mean() >= clean else float(min(0.5, cuts[at]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = PER_CLASS) -> Field:
    """Fit on at most ``per_class`` labelled documents of each class, the same ones on every run.

    Of several labels of one id the largest counts; null labels and ids do not. Four of five sampled
    documents teach the field, the fifth calibrates the score with the classes' true weights and chooses
    ``cut``, the score from which a filter drops documents (``best_cut``). With
    no toxic or no other example, the model gives every document the smoothed share of toxic ones.
    """
    marked = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.max(toxic) > 0).cast("int").alias("_toxic"))
    known = materialize(docs.select(doc_id).distinct().join(marked, doc_id).withColumn("_h", F.xxhash64(doc_id)))
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    negative, positive = sizes.get(0, 0), sizes.get(1, 0)
    prior = (positive + 0.5) / (positive + negative + 10)
    chosen = [known.where(F.col("_toxic") == k).orderBy("_h", doc_id).limit(per_class) for k in (0, 1)]
    ids = materialize(chosen[0].unionByName(chosen[1]))
    # At most 2 * per_class ids; of repeated rows of an id one text, the smallest, so that the sample stays bounded.
    sample = materialize(docs.select(doc_id, text).join(F.broadcast(ids), doc_id).groupBy(doc_id, "_toxic", "_h").agg(F.min(text).alias(text)))
    teach, hold = sample.where(F.pmod("_h", F.lit(5)) != 0), sample.where(F.pmod("_h", F.lit(5)) == 0)
    counts = {r["_toxic"]: r["n"] for r in teach.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lifts = _mined(teach, text, "_toxic", (counts.get(0, 0), counts.get(1, 0))) if len(counts) == 2 else {}
    model = fit_field(_sequences(teach, text, lifts, "_toxic"), lifts) if lifts else Field()
    model.intercept = float(np.log(prior / (1 - prior)))
    rest = _sequences(hold, text, lifts, "_toxic") if lifts else []
    y = np.array([r[0] for r in rest], float)
    if lifts and 0 < y.sum() < len(y):
        tagger, x = Tagger(model), []
        for _, n, at, found in rest:
            evidence = np.full(n, np.nan)
            evidence[at] = [sum(model.weights[f] for f in joined.split(" ")) for joined in found]
            x.append(tagger.measures(evidence)[0])
        share = {1.0: positive / max(1, y.sum()), 0.0: negative / max(1, (1 - y).sum())}
        w = np.array([share[v] for v in y])
        beta = logistic(np.array(x), y, w / w.mean())
        model.calibration, model.intercept = tuple(beta[:-1].tolist()), float(beta[-1])
        model.cut = best_cut(np.array([tagger.score(m) for m in x]), y > 0)
    return model


def score(docs: DataFrame, model: Field, text: str = "text", threshold: float = 0.5, spans: bool = True) -> DataFrame:
    """Add score (0 to 1), predicted (1 from the threshold on) and toxic_spans (code point offsets).

    Null and empty texts have no tokens and get the score of a text without evidence. All other
    columns pass through; columns with the names of results are replaced.
    """
    docs = free_names(docs, ("score", "predicted", "toxic_spans"))
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: FEATURES weights
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())] + [T.StructField("toxic_spans", span)] * spans)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for part in chunks(batch, text):
                scores, found = [], []
                for value in part.column(part.schema.get_field_index(text)).to_pylist():
                    words = (value or "").split()
                    measures, at, p = tagger.measures(tagger.evidence(words))
                    scores.append(tagger.score(measures))
                    hits = {int(i): float(x) for i, x in zip(at, p) if x >= 0.5} if spans else {}
                    found.append([{"start": m.start(), "end": m.end(), "p": hits[i]} for i, m in enumerate(_TOKEN.finditer(value)) if i in hits] if hits else [])
                extra = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())] + [pa.array(found, span_type)] * spans
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + extra,
                                                 names=[*kept, "score", "predicted", *(["toxic_spans"] * spans)])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))
