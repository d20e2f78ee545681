"""Scores of a small causal self-attention model on subword ids, beside a word-count base score.

The model predicts the next subword from a window of earlier ones (one attention head, relative
positions, a small rectified layer) in two steps: its class, then its place in the class; a place that
several subwords share is divided by their shares of the whole training corpus. Classes come from the
neighbours of every subword in all training documents. Attention starts from a fit on sampled windows;
then the windows of all training documents, or a share that the caller asks for, teach it, in the tasks that hold them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import tokens
from tallymark.llm.common import chunks, remainder, text_bytes
from tallymark.session import materialize

#: A window: so many scored positions, preceded by as many of context.
STRIDE = 16
END = 50256
VOCABULARY = 50257
#: Classes of subwords by context, places in a class (the last one shared), and subwords with an own embedding.
CLASSES, PLACES, OWN = 32, 32, 2048
WIDTH, HIDDEN = 16, 32
#: Windows of the fit that training over all windows starts from, and passes over them.
WINDOWS, PASSES = 24_000, 8
#: Windows of a step and its rate in that pass.
_BATCH, _RATE = 512, 0.003
#: Words whose counts every task holds; all others are joined.
HEAD = 400_000
_SHARE = 0.5
_TILE = 256  # blocks; what a tile holds fits into a core's cache


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents, lower-cased A-Z; the end of every document counts as the null word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for part in chunks(batch, text):
                for t in text_bytes(part.column(0)):
                    counts.update(t.lower().split())
            words = pa.array(list(counts) + [None], pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()) + [batch.num_rows], pa.int64())], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: those from a count on, found from a histogram of counts."""
    words = counts.where(F.col("word").isNotNull())
    level = F.floor(F.log2(F.col("n")) * 8).cast("int")
    held, lowest = 0, None
    for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # 8 levels a doubling
        held += r["words"]
        if held > most:
            break
        lowest = r["level"]
    return words.where(F.lit(False) if lowest is None else level >= lowest)


def prepare(docs: DataFrame, head: dict[bytes, float], ends: int, doc_id: str, text: str, path: str) -> DataFrame:
    """One row per document: the base measures over the end and the head words (given with log10(count + 1)),
    the other words with their number, and the subword ids of the whole lower-cased text as two-byte integers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(head)  # at most HEAD words
    rows = docs.select(doc_id, text, trained(doc_id).alias("trained")).withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([rows.schema[doc_id], rows.schema["trained"], rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("logs", T.DoubleType()), T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, end_log, encode = shared.value.get, float(np.log10(ends + 1)), tokens.encoding(path).encode_to_numpy
        for batch in batches:
            for part in chunks(batch, text):
                number, known, sums, rare, times, ids = [], [], [], [], [], []
                for t in text_bytes(part.column(1)):
                    t = t.lower()
                    words = t.split()
                    found = list(map(log, words))
                    missing = Counter([w for w, x in zip(words, found) if x is None]) if None in found else {}
                    number.append(len(words) + 1)
                    known.append(len(words) - sum(missing.values()) + (ends > 0))
                    sums.append(sum(filter(None, found)) + end_log)
                    rare.append(list(missing))
                    times.append(list(missing.values()))
                    ids.append(encode(t.decode(), allowed_special=set(), disallowed_special=()).astype(np.uint16).tobytes() if t else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(number, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                                                  pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def trained(doc_id: str = "doc_id") -> Column:
    """Whether the model may learn from a document; one without an id is not learned from."""
    return F.coalesce(remainder(doc_id, 7) != 2, F.lit(False))


def _lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of texts in one line: a block of padding, then the end id and the text,
    filled up to whole blocks. Also the scored blocks, which of them open a text, and each one's text."""
    inputs, targets, blocks, opening, owner, at = [], [], [], [], [], 0
    for k, ids in enumerate(texts):
        n = len(ids) + 1
        size = -(-n // STRIDE)
        line, aim = np.full((size + 1) * STRIDE, -1, np.int64), np.full((size + 1) * STRIDE, -1, np.int64)
        line[STRIDE], line[STRIDE + 1:STRIDE + n] = END, ids
        aim[STRIDE:STRIDE + n - 1], aim[STRIDE + n - 1] = ids, END
        inputs.append(line)
        targets.append(aim)
        blocks.append(np.arange(at + 1, at + size + 1))
        opening.append(np.arange(size) == 0)
        owner.append(np.full(size, k))
        at += size + 1
    return tuple(map(np.concatenate, (inputs, targets, blocks, opening, owner)))


@dataclass
class Attention:
    """All parameters; their size does not depend on the corpus."""

    group: np.ndarray  # subword -> row of the embedding
    classes: np.ndarray  # subword -> class
    places: np.ndarray  # subword -> place in its class
    share: np.ndarray  # log share of a subword in its place
    p: dict[str, np.ndarray]

    def score(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        """log10 probability of every text with its end, each subword scored once in its window."""
        out, held, some = [np.zeros(0)], 0, []
        for ids in texts:  # runs of texts, so that working memory is bounded by a run or one text
            some.append(ids)
            held += len(ids) + 2 * STRIDE
            if held > 1 << 16:
                out.append(self._scored(some))
                held, some = 0, []
        if some:
            out.append(self._scored(some))
        return np.concatenate(out) / np.log(10)

    def _scored(self, texts: list[np.ndarray]) -> np.ndarray:
        p = self.p
        inputs, targets, blocks, opening, owner = _lay_out(texts)
        x = p["embed"].take(np.where(inputs < 0, 0, self.group[inputs]), 0)
        # Queries, keys, values, and a one beside the values that adds up the weights of a position.
        qkv = np.ones((len(x), 3 * WIDTH + 1), np.float32)
        np.matmul(x, np.concatenate([p["q"] / np.float32(np.sqrt(WIDTH)), p["k"], p["v"]], 1), out=qkv[:, :-1])
        bias, row, ones = p["bias"] + _CAUSAL, qkv.strides, np.ones(CLASSES, np.float32)
        tile = min(_TILE, len(blocks))
        weights, mixed, odds = (np.empty(shape, np.float32) for shape in ((tile, STRIDE, 2 * STRIDE), (tile, STRIDE, WIDTH + 1), (tile * STRIDE, CLASSES)))
        state, value = np.empty((len(blocks) * STRIDE, WIDTH), np.float32), np.empty(len(blocks) * STRIDE, np.float32)
        aims = targets[(blocks[:, None] * STRIDE + np.arange(STRIDE)).ravel()]
        live = aims >= 0
        aims = np.where(live, aims, 0)
        classes = self.classes[aims]
        for at in range(0, len(blocks), _TILE):
            b, first = blocks[at:at + _TILE], opening[at:at + _TILE]
            # Blocks of one tile lie in order; a window is the block and the one before it.
            low, high = b[0] - 1, b[-1] + 1
            line = qkv[low * STRIDE:high * STRIDE]
            windows = as_strided(line, (high - low - 1, 2 * STRIDE, 3 * WIDTH + 1), (STRIDE * row[0], row[0], row[1]))
            w = windows if len(b) == len(windows) else windows[b - b[0]]
            s = np.matmul(w[:, STRIDE:, :WIDTH], w[:, :, WIDTH:2 * WIDTH].transpose(0, 2, 1), out=weights[:len(b)])
            s += bias
            s[first, :, :STRIDE] = -1e9
            np.exp(s, out=s)
            seen = np.matmul(s, w[:, :, 2 * WIDTH:], out=mixed[:len(b)]).reshape(-1, WIDTH + 1)
            position = (b[:, None] * STRIDE + np.arange(STRIDE)).ravel()
            own = slice(at * STRIDE, at * STRIDE + len(position))
            h = x.take(position, 0, out=state[own])
            h += seen[:, :WIDTH] / seen[:, WIDTH:]
            z = h @ p["w1"]
            z += p["b1"]
            h += np.maximum(z, 0, out=z) @ p["w2"]
            logits = np.matmul(h, p["out"], out=odds[:len(h)])
            logits += p["ob"]
            won = logits[np.arange(len(h)), classes[own]]
            value[own] = won - np.log(np.exp(logits, out=logits) @ ones)
        # The place in the class: positions of one class at a time.
        order = np.argsort(classes.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
        for c, (low, high) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            if low < high:
                some = order[low:high]
                odds = state[some] @ p["inner"][c]
                odds += p["ib"][c]
                won = odds[np.arange(len(some)), self.places[aims[some]]]
                value[some] += won - np.log(np.exp(odds, out=odds).sum(1))
        value = np.where(live, value + self.share[aims], 0.0).astype(np.float64).reshape(-1, STRIDE).sum(1)
        return np.bincount(owner, value, len(texts))


#: Position i of a block sees its own position and all earlier ones of the window.
_CAUSAL = np.where(np.arange(2 * STRIDE)[None, :] <= STRIDE + np.arange(STRIDE)[:, None], 0.0, -1e9).astype(np.float32)


def subword_counts(prepared: DataFrame) -> np.ndarray:
    """Counts of every subword id and the end over all training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                counts += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, 500).to_pylist()), np.uint16), minlength=VOCABULARY)
            counts[END] += batch.num_rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    found = prepared.where("trained").select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(VOCABULARY, np.int64)  # one number for every id of the vocabulary at most
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def sampled_windows(prepared: DataFrame, most: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of at most ``most`` windows, drawn by a hash over all training windows.

    The number of all windows gives the bound of the hash below which about ``most`` of them lie, so
    no task passes on more than its share.
    """
    training = prepared.where("trained").select("row", "ids")
    blocks = F.floor((F.octet_length("ids") / 2 + STRIDE) / STRIDE)  # a block holds STRIDE ids or the end
    count = training.agg(F.coalesce(F.sum(blocks), F.lit(0))).first()[0]
    bound = np.uint64(min(1.0, 1.2 * most / max(1, count)) * ((1 << 64) - 2048))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, lines = [], []
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                mixed = _mixed(row, len(ids.as_buffer()) // 2 // STRIDE + 1)
                chosen = np.flatnonzero(mixed <= bound)
                if chosen.size:
                    inputs, targets, *_ = _lay_out([np.frombuffer(ids.as_buffer(), np.uint16)])
                    for b in chosen.tolist():
                        hashes.append(int(mixed[b] >> np.uint64(1)))
                        lines.append(np.r_[inputs[b * STRIDE:(b + 2) * STRIDE], targets[(b + 1) * STRIDE:(b + 2) * STRIDE]].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(lines, pa.binary())], names=["h", "w"])

    found = training.mapInArrow(run, "h long, w binary").orderBy("h", "w").limit(most).toArrow().column("w").to_pylist()
    flat = np.frombuffer(b"".join(found), "<i4").astype(np.int64).reshape(-1, 3 * STRIDE)
    return flat[:, :2 * STRIDE], flat[:, 2 * STRIDE:]


def _mixed(row: int, blocks: int) -> np.ndarray:
    """A well-mixed number for every block of a row."""
    x = np.uint64(row * 0x9E3779B97F4A7C15 % (1 << 64)) + np.arange(blocks, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def neighbour_counts(prepared: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often every subword of all training documents has each of the 255 most frequent ones, or
    any other, behind it (first 256 columns) and before it."""
    near = np.full(VOCABULARY, 255, np.int64)
    near[np.argsort(-counts, kind="stable")[:255]] = np.arange(255)
    shared = prepared.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, table = shared.value, np.zeros(VOCABULARY * 512, np.uint32)
        end = np.array([END], np.uint16).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # texts in one line, each between two ends
                line = np.frombuffer(b"".join(end + ids + end for ids in batch.column(0).slice(at, 500).to_pylist()), np.uint16).astype(np.int64)
                left, right = line[:-1], line[1:]
                keep = (left != END) | (right != END)
                keep |= _empty(batch.column(0).slice(at, 500), len(keep))
                left, right = left[keep], right[keep]
                np.add.at(table, left * 512 + near[right], np.uint32(1))
                np.add.at(table, right * 512 + 256 + near[left], np.uint32(1))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(table[cells], pa.int64())], names=["cell", "n"])

    found = prepared.where("trained").select("ids").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(VOCABULARY * 512, np.float32)  # of fixed size
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(VOCABULARY, 512)


def _empty(ids: pa.Array, pairs: int) -> np.ndarray:
    """Among the pairs of texts in one line, those of the two ends of an empty text."""
    sizes = np.array([len(x) // 2 + 2 for x in ids.to_pylist()], np.int64)
    out = np.zeros(pairs, bool)
    out[(np.cumsum(sizes) - sizes)[sizes == 2]] = True
    return out


def _contexts(table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place of every subword: k-means over neighbours, then places by frequency."""
    order = np.argsort(-counts, kind="stable")
    classes = np.full(VOCABULARY, CLASSES - 1)  # the last class holds what the corpus shows too rarely
    weight = table.sum(1, dtype=np.float64)
    some = np.flatnonzero(weight >= 4)
    groups = CLASSES - 1
    if len(some) > groups:
        weight = weight[some]
        v = table[some]
        v /= weight[:, None]
        np.sqrt(v, out=v)
        centres = v[np.argsort(-weight, kind="stable")[:groups]]
        for _ in range(12):
            near_by = np.argmax(v @ centres.T, 1)
            for g in range(groups):
                mine = near_by == g
                if mine.any():
                    c = weight[mine].astype(np.float32) @ v[mine]
                    centres[g] = c / max(1e-12, np.linalg.norm(c))
        classes[some] = near_by
    places = np.empty(VOCABULARY, np.int64)
    for g in range(CLASSES):
        mine = order[classes[order] == g]
        places[mine] = np.minimum(np.arange(len(mine)), PLACES - 1)
    return classes, places


def fit(prepared: DataFrame, windows: int = WINDOWS, passes: int = PASSES, seed: int = 1, share: float = 1.0) -> Attention:
    """The model: a start from at most ``windows`` windows, then a pass over ``share`` of all training windows."""
    counts = subword_counts(prepared)
    classes, places = _contexts(neighbour_counts(prepared, counts), counts)
    inputs, targets = sampled_windows(prepared, windows)
    cell = classes * PLACES + places
    total, members = np.bincount(cell, counts, CLASSES * PLACES), np.bincount(cell, minlength=CLASSES * PLACES)
    log_share = np.log((counts + _SHARE) / (total + _SHARE * members)[cell]).astype(np.float32)
    order = np.argsort(-counts, kind="stable")
    group = OWN + classes
    group[order[:OWN]] = np.arange(OWN)
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.1: (r.standard_normal(shape) * scale).astype(np.float32)
    inside = np.where(members > 0, np.log(total + _SHARE * members + 1e-9), -30.0).reshape(CLASSES, PLACES)  # an empty place has no chance
    p = {"embed": draw(OWN + CLASSES, WIDTH, scale=0.5), "q": draw(WIDTH, WIDTH, scale=0.25), "k": draw(WIDTH, WIDTH, scale=0.25), "v": draw(WIDTH, WIDTH), "bias": np.zeros((STRIDE, 2 * STRIDE), np.float32),
         "w1": draw(WIDTH, HIDDEN, scale=0.25), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, WIDTH), "out": draw(WIDTH, CLASSES), "ob": np.log((np.bincount(classes, counts, CLASSES) + 1) / (counts.sum() + CLASSES)).astype(np.float32),
         "inner": np.zeros((CLASSES, WIDTH, PLACES), np.float32), "ib": (inside - inside.max(1, keepdims=True)).astype(np.float32)}
    _train(p, np.where(inputs < 0, -1, group[inputs]), np.where(targets < 0, -1, cell[targets]), passes, r)
    return Attention(group, classes, places, log_share, _taught_by_all(prepared, p, group, cell, seed, share))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _taught_by_all(prepared: DataFrame, start: dict[str, np.ndarray], group: np.ndarray, cell: np.ndarray, seed: int, share: float) -> dict[str, np.ndarray]:
    """Parameters after ``share`` of the windows of all training documents have taught once.

    Each task goes on from the start over its windows; then the changes are averaged by how often a
    task has used what they belong to: an embedding by its subwords, a class's places by the class,
    all else by scored positions. So what only few tasks hold is not thinned out by the others.
    """
    shared = prepared.sparkSession.sparkContext.broadcast((start, group, cell))
    schema = "change binary, uses binary"

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, group, cell = shared.value
        p = {k: v.copy() for k, v in start.items()}
        r, steps, uses = np.random.default_rng(seed), _Adam(p), np.zeros(OWN + 2 * CLASSES + 1)
        for inputs, targets in _shared_windows(batches, share):
            inputs, targets = np.where(inputs < 0, -1, group[inputs]), np.where(targets < 0, -1, cell[targets])
            uses[:OWN + CLASSES] += np.bincount(inputs[inputs >= 0], minlength=OWN + CLASSES)
            uses[OWN + CLASSES:-1] += np.bincount(targets[targets >= 0] // PLACES, minlength=CLASSES)
            mixed = r.permutation(len(inputs))
            for at in range(0, len(mixed), _BATCH):
                some = mixed[at:at + _BATCH]
                steps.step(p, _gradient(p, inputs[some], targets[some]), np.float32(_RATE * min(1.0, (steps.turn + 1) / 20) * len(some) / _BATCH))
        uses[-1] = uses[OWN + CLASSES:-1].sum()
        change = (_flat(p).astype(np.float64) - _flat(start)) * _uses_of(start, uses)
        yield pa.RecordBatch.from_arrays([pa.array([change.tobytes()], pa.binary()), pa.array([uses.tobytes()], pa.binary())], names=["change", "uses"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for pair in zip(*(c.to_pylist() for c in batch.columns)):
                pair = [np.frombuffer(x) for x in pair]
                total = pair if total is None else [a + b for a, b in zip(total, pair)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in total], names=["change", "uses"])

    training = prepared.where("trained").select("row", "ids")
    tasks = training.rdd.getNumPartitions()
    found = training.mapInArrow(teach, schema).repartition(max(1, int(tasks ** 0.5))).mapInArrow(add, schema).toArrow()
    if not found.num_rows:
        return start
    change, uses = (sum(map(np.frombuffer, found.column(k).to_pylist())) for k in ("change", "uses"))
    new, at, out = _flat(start) + change / np.maximum(1, _uses_of(start, uses)), 0, {}
    for k in sorted(start):
        out[k] = new[at:at + start[k].size].reshape(start[k].shape).astype(np.float32)
        at += start[k].size
    return out


def _uses_of(p: dict[str, np.ndarray], uses: np.ndarray) -> np.ndarray:
    """For every parameter how often what it belongs to was used."""
    own = {"embed": uses[:OWN + CLASSES], "inner": uses[OWN + CLASSES:-1], "ib": uses[OWN + CLASSES:-1]}
    return np.concatenate([np.repeat(own[k], p[k].size // len(own[k])) if k in own else np.full(p[k].size, uses[-1]) for k in sorted(p)])


def _shared_windows(batches: Iterator[pa.RecordBatch], share: float, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets of the share of all windows that a hash of text and place chooses, some at a time."""
    bound, held, some = np.uint64((1 << 64) - 1 if share >= 1 else int(share * ((1 << 64) - 2048))), 0, []
    for batch in batches:
        for row, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            chosen = np.flatnonzero(_mixed(row, len(ids.as_buffer()) // 2 // STRIDE + 1) <= bound)
            if len(chosen):
                inputs, targets = _windows([np.frombuffer(ids.as_buffer(), np.uint16)])
                some.append((inputs[chosen], targets[chosen]))
                held += len(chosen)
            if held > most:
                yield tuple(map(np.concatenate, zip(*some)))
                held, some = 0, []
    if some:
        yield tuple(map(np.concatenate, zip(*some)))


def _windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    inputs, targets, blocks, *_ = _lay_out(texts)
    inputs, targets = inputs.reshape(-1, STRIDE), targets.reshape(-1, STRIDE)
    # The block before the first one of a text is padding.
    return np.concatenate([inputs[blocks - 1], inputs[blocks]], 1), targets[blocks]


def _train(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, passes: int, r: np.random.Generator, batch: int = 256) -> None:
    """Adam on the cross-entropy of next classes and places."""
    steps, rounds = _Adam(p), passes * -(-len(inputs) // batch)
    for _ in range(passes):
        mixed = r.permutation(len(inputs))
        for at in range(0, len(mixed), batch):
            turn = steps.turn + 1
            steps.step(p, _gradient(p, inputs[mixed[at:at + batch]], targets[mixed[at:at + batch]]), np.float32(0.01 * min(1.0, turn / 20) * (1 - 0.9 * turn / rounds)))


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.turn = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: np.float32) -> None:
        self.turn += 1
        for name, grad in g.items():
            first, second = self.first[name], self.second[name]
            first *= np.float32(0.9)
            first += np.float32(0.1) * grad
            second *= np.float32(0.99)
            second += np.float32(0.01) * grad * grad
            p[name] -= np.float32(rate / (1 - 0.9 ** self.turn)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.99 ** self.turn))) + np.float32(1e-8))


def _gradient(p: dict[str, np.ndarray], idx: np.ndarray, aim: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of next classes and places, by hand."""
    root = np.float32(1 / np.sqrt(WIDTH))
    n, pad, live = len(idx), idx < 0, aim >= 0
    flat = lambda m: m.reshape(-1, m.shape[-1])
    x = p["embed"].take(np.where(pad, 0, idx), 0)
    last = np.ascontiguousarray(x[:, STRIDE:])
    q, k, v = (flat(last) @ p["q"]).reshape(last.shape), (flat(x) @ p["k"]).reshape(x.shape), (flat(x) @ p["v"]).reshape(x.shape)
    s = q @ k.transpose(0, 2, 1)
    s *= root
    s += p["bias"] + _CAUSAL
    short = np.flatnonzero(pad.any(1) | ~live.all(1))  # windows at the beginning or end of a text
    s[short] += np.where(pad[short], np.float32(-1e9), np.float32(0))[:, None, :]
    s[~live] = 0  # positions after the end
    s -= s.max(2, keepdims=True)
    a = np.exp(s, out=s)
    a /= a.sum(2, keepdims=True)
    h = flat(last + a @ v)
    z = np.maximum(h @ p["w1"] + p["b1"], 0)
    u = h + z @ p["w2"]
    d = u @ p["out"] + p["ob"]
    d -= d.max(1, keepdims=True)
    np.exp(d, out=d)
    d /= d.sum(1, keepdims=True)
    part = np.float32(1 / max(1, live.sum()))
    there = np.flatnonzero(live)
    cell = aim.ravel()[there]
    d[there, cell // PLACES] -= 1
    d *= live.reshape(-1, 1) * part
    g = {"out": u.T @ d, "ob": d.sum(0), "inner": np.zeros_like(p["inner"]), "ib": np.zeros_like(p["ib"])}
    du = d @ p["out"].T
    order = np.argsort((cell // PLACES).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(cell // PLACES, minlength=CLASSES))
    for c, (low, high) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        if low < high:
            at, place = there[order[low:high]], cell[order[low:high]] % PLACES
            own = u[at]
            e = own @ p["inner"][c] + p["ib"][c]
            e -= e.max(1, keepdims=True)
            np.exp(e, out=e)
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(e)), place] -= 1
            e *= part
            g["inner"][c], g["ib"][c] = own.T @ e, e.sum(0)
            du[at] += e @ p["inner"][c].T
    dz = (du @ p["w2"].T) * (z > 0)
    g["w2"], g["w1"], g["b1"] = z.T @ du, h.T @ dz, dz.sum(0)
    dh = (du + dz @ p["w1"].T).reshape(last.shape)
    ds, dv = dh @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dh
    ds -= (ds * a).sum(2, keepdims=True)
    ds *= a
    g["bias"] = np.where(_CAUSAL < 0, np.float32(0), ds.sum(0))
    ds *= root
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    g["q"], g["k"], g["v"] = flat(last).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    dx = (flat(dk) @ p["k"].T + flat(dv) @ p["v"].T).reshape(x.shape)
    dx[:, STRIDE:] += dh + (flat(dq) @ p["q"].T).reshape(last.shape)
    g["embed"] = np.zeros_like(p["embed"])
    real = np.flatnonzero(~pad)
    if len(real):  # rows of one subword next to each other, added up by runs
        rows = idx.ravel()[real].astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        g["embed"][rows[starts]] = np.add.reduceat(flat(dx)[real[order]], starts)
    return g


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, head: int = HEAD, windows: int = WINDOWS, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, n_subwords.

    Null and empty texts consist of their end. Repeated rows are scored each. Without any training
    document all counts are zero and the model is the untrained one. Extra columns are ignored.
    """
    path = path or tokens.default_path()
    counts = materialize(word_counts(docs.where(trained(doc_id)), text))
    n, v, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    top = head_words(counts, head).select("word", F.log10(F.col("n") + 1.0).alias("log")).toArrow()
    top = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    prepared = materialize(prepare(docs, top, ends, doc_id, text, path))
    shared = docs.sparkSession.sparkContext.broadcast(fit(prepared, windows, share=share))

    rare = prepared.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = (rare.join(counts, "word").groupBy("row")
             .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(i.as_buffer(), np.uint16) for i in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(ids), pa.float64()), pa.array([len(i) + 1 for i in ids], pa.int64())], names=[*batch.schema.names[:-1], "score", "n_subwords"])

    kept = prepared.select(doc_id, "trained", "row", "n_tokens", "n_known", "logs", "ids")
    scored = kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("n_subwords", T.LongType())]))
    joined = scored.join(found, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return joined.select(doc_id, "trained", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                         F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_subwords")
