"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import chunks, free_names, text_bytes
from tallymark.llm.components import components
from tallymark.session import materialize

SEED = 42
#: Fingerprints link at so many differing bits. Two halves share them out, so one half has at most
#: one of them: the ball of radius 1 around each half finds every partner.
MAX_BITS = 3
#: Table entries of one half value that a task compares directly; beyond, shared centres link them.
DENSE = 16384
_ROWS = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of one UTF-8 text: lower-cased A-Z, words cut at ASCII white space, shingles with repeats.

    A text of fewer words is one shingle; one without words has fingerprint zero.
    """
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    count = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.dtype("<u8"), count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 255 * 64):  # sums of 255 bits fit into a byte
        bits = np.unpackbits(hashes[at:at + 255 * 64].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "simhash", width: int = 3, keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed long; null text counts as empty. Other columns pass through."""
    docs = free_names(docs, [name])
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                prints = [fingerprint(t, width) for t in text_bytes(part.column(part.schema.get_field_index(text)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(prints, pa.int64())], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def _near(some: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.bitwise_count((some[:, None] ^ table[None, :]).view(np.uint64)) <= MAX_BITS  # of signed numbers it counts the absolute value


def _spanning(table: np.ndarray) -> tuple[list, list, np.ndarray]:
    """Edges that connect table entries as all their links would, and each entry's root (an index)."""
    roots, left = np.arange(len(table)), np.arange(len(table))
    src, dst = [], []
    while left.size:
        root, edge, left = left[0], left[:1], left[1:]
        while edge.size and left.size:
            hit = np.zeros(left.size, bool)
            for at in range(0, edge.size, _ROWS):
                hit |= _near(table[edge[at:at + _ROWS]], table[left]).any(0)
            edge, left = left[hit], left[~hit]
            roots[edge] = root
            src += [table[root]] * edge.size
            dst += table[edge].tolist()
    return src, dst, roots


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the probes of each half value with its table entries; rows come sorted, entries first.

    Yields links that connect what all verified pairs would: a spanning forest of the entries, and
    each probe with one entry of every entry group it is near.
    """
    key, entries, ready = None, [], None
    for batch in batches:
        names = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        keys, flips, prints = names["half"] * 2 + names["side"], names["flipped"], names["simhash"]
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(flips) != 0)) + 1
        src, dst = [], []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            if lo == hi:
                continue
            if keys[lo] != key:
                if key is not None and ready is None:
                    a, b, _ = _spanning(np.concatenate(entries))
                    src += a
                    dst += b
                key, entries, ready = keys[lo], [], None
            if not flips[lo]:
                entries.append(prints[lo:hi].copy())
                continue
            if ready is None:
                rows = np.concatenate(entries)
                a, b, roots = _spanning(rows)
                src += a
                dst += b
                ready = rows, roots
            rows, roots = ready
            for at in range(lo, hi, _ROWS):
                some = prints[at:min(at + _ROWS, hi)]
                who, which = np.nonzero(_near(some, rows))
                if who.size:
                    pairs = np.unique(np.stack([who, roots[which]]), axis=1)
                    src += rows[pairs[1]].tolist()
                    dst += some[pairs[0]].tolist()
        if src:
            yield _links(src, dst)
    if key is not None and ready is None:
        src, dst, _ = _spanning(np.concatenate(entries))
        if src:
            yield _links(src, dst)


def _links(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(src, np.int64)), pa.array(np.array(dst, np.int64))], names=["src", "dst"])


def _masks(most: int) -> list[int]:
    one = [1 << i for i in range(32)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    return [0] + one * (most > 0) + two * (most > 1)


def links(prints: DataFrame, name: str = "simhash", dense: int = DENSE) -> DataFrame:
    """Links (src, dst) that connect distinct fingerprints exactly as all pairs within MAX_BITS would.

    Each half of a fingerprint is a table entry and the centre of a ball of radius 1. A probe meets
    the entries of the half values in its ball, and whole distances are verified. A half value with
    more than ``dense`` entries is linked through shared centres instead: an entry lists the other
    halves within 2 bits of its own, a probe those within 1; all that share a centre which some entry
    has within 1 bit are linked to that entry. Every such link is true, and every true link is
    implied, with rows linear in the entries. Both ways give a spanning set, not all pairs.
    """
    half = {0: F.shiftrightunsigned(F.col(name), 32), 1: F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))}
    side = lambda s: F.transform(F.array(*[F.lit(m) for m in _masks(1)]), lambda m: F.struct(
        F.lit(s).alias("side"), half[s].bitwiseXOR(m).alias("half"), (m != 0).alias("flipped")))
    probes = prints.select(F.col(name).alias("simhash")).select("simhash", F.explode(F.concat(side(0), side(1))).alias("p")).select("simhash", "p.*")
    keys = materialize(prints.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), half[s].alias("half")) for s in half])).alias("p"))
                       .groupBy("p.side", "p.half").agg(F.count(F.lit(1)).alias("entries")))
    met = probes.join(keys, ["side", "half"])
    direct = (met.where(F.col("entries") <= dense).drop("entries")
              .repartition("side", "half").sortWithinPartitions("side", "half", "flipped")
              .mapInArrow(_verified, "src long, dst long"))
    if not keys.where(F.col("entries") > dense).limit(1).count():
        return direct
    crowd = met.where(F.col("entries") > dense).withColumn("other", F.when(F.col("side") == 0, F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("simhash", 32)))
    spread = lambda rows, most: rows.select("side", "half", "flipped", "simhash", F.explode(F.transform(
        F.array(*[F.lit(m) for m in _masks(most)]), lambda m: F.struct(F.col("other").bitwiseXOR(m).alias("centre"), F.bit_count(m).alias("away")))).alias("c")).select("side", "half", "flipped", "simhash", "c.*")
    around = materialize(spread(crowd.where(~F.col("flipped")), 2).unionByName(spread(crowd.where("flipped"), 1)))
    hub = materialize(around.where(~F.col("flipped") & (F.col("away") <= 1)).groupBy("side", "half", "centre").agg(F.min("simhash").alias("src")))
    shared = around.join(hub, ["side", "half", "centre"]).where("src != simhash").select("src", F.col("simhash").alias("dst")).distinct()
    return direct.unionByName(shared)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, simhash (signed long), component_id (smallest doc_id reachable).

    Empty and null texts share fingerprint zero and link like any other. Equal fingerprints are one
    node, so copies are never expanded into pairs. Repeated rows stay repeated. A null id takes no
    part in choosing the smallest id; a group of null ids only has a null component.
    """
    prints = materialize(with_fingerprint(docs.select(doc_id, text), text, width=width, keep_text=False))
    return prints.join(_groups(prints, "simhash", doc_id, dense), "simhash").select(doc_id, "simhash", F.col("component").alias("component_id"))


def _groups(prints: DataFrame, name: str, key: str, dense: int) -> DataFrame:
    """(simhash, component): for every distinct fingerprint the smallest key reachable; written."""
    nodes = materialize(prints.groupBy(F.col(name).alias("simhash")).agg(F.min(key).alias("first")))
    found = materialize(components(links(nodes, dense=dense)))
    linked = nodes.join(found, nodes["simhash"] == found["node"]).select("simhash", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    moved = linked.select("simhash", "root").join(smallest, "root").select("simhash", "component")
    return materialize(nodes.join(moved, "simhash", "left").select("simhash", F.coalesce("component", "first").alias("component")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, dense: int = DENSE) -> DataFrame:
    """Of every near-duplicate group the row with the smallest id (null last), all columns kept.

    Rows are told apart by what they hold, so a repeated id with another text is a row of its own,
    and of rows equal in every column one stays. All empty texts are one group.
    """
    named = docs.withColumns({"_id": F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")), "_content": F.xxhash64(*docs.columns)})
    prints = materialize(with_fingerprint(named.select("_id", "_content", text), text, "_print", width, keep_text=False))
    grouped = prints.join(_groups(prints, "_print", "_id", dense).withColumnRenamed("simhash", "_print"), "_print")
    winners = grouped.groupBy("component").agg(F.min(F.struct("_id", "_content")).alias("w")).select("w._id", "w._content")
    copies = materialize(prints.join(winners, ["_id", "_content"], "left_semi").groupBy("_id", "_content").agg(F.count(F.lit(1)).alias("_copies")))
    kept = named.join(copies, ["_id", "_content"])
    once = kept.where(F.col("_copies") == 1).select(docs.columns)
    return once.unionByName(kept.where(F.col("_copies") > 1).select(docs.columns).dropDuplicates())
