"""Binary token files against the tokenizers library, document by document."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
HARD = [None, "", " \n\t", "don't CAN'T we'll 12345 x1y2", "Ünïcode Wörter 中文 🙂 hier", "a b c\u0085d\x1ce", "é ́ x̧́y ΣΑΣ İi ǅ", "<|endoftext|> x<|startoftext|>y <|endoftext|>",
        "x" * 5000, "word, word. 12, 3? é, É; İ, ß. x.. y., 'tis it's, don't. …, \"a\", a-b; ́, ё: ǆ! 中文, ²,", "<|ENDOFTEXT|>, Word, <|endoftext|>, A", "U+FB01 ﬁ, ŉ, Ⅷ, ½, ʰ, ١,", "...!!! ... ?!", "\x00\x01 \x0b\x0c\r", "  lead and trail  ", "​﻿ zero"]


def expected(texts):
    """(start, n, crc) of texts in order."""
    out, at = [], 0
    for t in texts:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def found(df):
    return [tuple(r) for r in df.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


@pytest.mark.parametrize("shards", [1, 5, None])
def test_files_hold_every_text_in_order(spark, tmp_path, shards):
    r = random.Random(1)
    rows = [(i * 3, t) for i, t in enumerate(HARD)] + [(1000 - i, " ".join(r.choice(["alpha", "Beta", "γάμμα", "42", "don't", "naïve"]) for _ in range(r.randint(0, 300)))) for i in range(80)]
    r.shuffle(rows)
    given = frame(spark, rows).withColumns({n: F.lit("taken") for n in ("shard", "ids", "n", "_hash", "base", "offset")})
    manifest = token_files.write(given, f"file://{tmp_path}/corpus", shards=shards)
    ordered = sorted(rows)
    assert found(token_files.read(manifest)) == [(i, *e) for (i, _), e in zip(ordered, expected([t for _, t in ordered]))]
    ids = {r["doc_id"]: r["ids"] for r in token_files.read(manifest, ids=True).collect()}
    assert ids == {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}


def test_the_format_itself(spark, tmp_path):
    rows = [(i, f"document number {i} of some") for i in range(40)]
    manifest = token_files.write(frame(spark, rows), str(tmp_path / "corpus"), shards=4).orderBy("shard").collect()
    at, flat = 0, []
    for m in manifest:
        place = m["files"].removeprefix("file://")
        ids, offsets = np.fromfile(place + ".ids", m["width"]), np.fromfile(place + ".offsets", "<i8")
        assert m["base"] == at and offsets[0] == 0 and offsets[-1] == len(ids) == m["n_tokens"] and len(offsets) == m["n_docs"] + 1 and (np.diff(offsets) > 0).all()
        at += len(ids)
        flat += ids.tolist()
        shard = token_files.Shard(m["files"], m["width"])
        assert isinstance(shard.ids, np.memmap) and shard.document(0).tolist() == ids[:offsets[1] - offsets[0]].tolist()
    assert flat == [i for _, t in rows for i in LIBRARY.encode(t, add_special_tokens=False).ids + [1]]
    assert len(os.listdir(tmp_path / "corpus")) == 3 * len(manifest)


def test_ties_nulls_repeated_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, "one"), (None, "no id"), (1, "one"), (1, "other text"), (None, None), (2, "two")] + [(7, "hot row")] * 300
    df = frame(spark, rows).repartition(3)
    got = found(token_files.read(token_files.write(df, str(tmp_path / "a"), shards=5)))
    assert [g[0] for g in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    single = {(i, e[1], e[2]) for i, t in rows for e in expected([t])}
    assert {(g[0], g[2], g[3]) for g in got} == single and len(got) == len(rows)
    sizes = [r["n_docs"] for r in token_files.write(df, str(tmp_path / "a2"), shards=5).collect()]
    assert max(sizes) < 200  # one row repeated over most of the table does not fill one shard
    empty = token_files.write(frame(spark, []), str(tmp_path / "b"))
    assert empty.count() == 0 and token_files.read(empty).columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and token_files.read(empty).count() == 0


def test_long_texts_pass_in_chunks_and_words_are_forgotten(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(900_000))  # over one chunk of text
    rows = [(1, "short"), (2, long), (3, "x" * 300_000)]
    assert found(token_files.read(token_files.write(frame(spark, rows), str(tmp_path / "c")))) == [(i, *e) for (i, _), e in zip(rows, expected([t for _, t in rows]))]
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    monkeypatch.setattr(token_files, "KEPT", 1)
    for t in (b"several words here", b"and others there", b"several words here"):
        assert np.frombuffer(encoder.encode([t])[0], "<u2").tolist() == LIBRARY.encode(t.decode(), add_special_tokens=False).ids


def test_string_ids_and_four_bytes(spark, tmp_path):
    df = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none")], "doc_id string, text string")
    assert [x[0] for x in found(token_files.read(token_files.write(df, str(tmp_path / "d"), shards=2)))] == [None, "a", "b"]
    assert token_files.write(df, str(tmp_path / "e"), end=70_000).first()["width"] == "<u4"


def test_a_word_of_small_letters_is_merged_once_and_skips_the_pipeline(monkeypatch):
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "<u2")
    encoder.encode([b"marks, ."])
    merged, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda word: merged.append(word) or merge(word))
    monkeypatch.setattr(encoder, "_library", lambda word: pytest.fail(f"{word} took the long way"))
    text = "straße naïveté, Word word. ÿþð hello, straße"
    want = np.array(LIBRARY.encode(text.lower(), add_special_tokens=False).ids, "<u2").tobytes()
    assert encoder.encode([text.lower().encode()]) == [want] and len(merged) == 5
    monkeypatch.setattr(token_files, "KEPT", 1)
    for _ in range(3):  # what was met among the last words is not merged again
        assert encoder.encode([text.lower().encode()]) == [want] and len(merged) == 5
