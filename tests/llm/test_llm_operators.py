"""Each training-data operator against brute force, round trips or held-out accuracy, and at its edges."""

import hashlib
import json
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import bpe, chat, cotrain, html_extract, html_pages, lm, packing, quality_rules, queries, simhash, tokens, topk, toxicity
from tallymark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, "Ünïcode Wörter 中文 🙂 hier"), (6, "Ünïcode Wörter 中文 🙂 hier"), (7, "x" * 5000), (None, "no id at all here"), (8, prose(1, 3000)), (9, "a b c d")]


# --- 1

def plain_print(text):
    ws = words(lowered(text))
    if not ws:
        return 0
    grams = [" ".join(ws)] if len(ws) < 3 else [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(ids, prints):
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    found = {}
    for i in range(len(ids)):
        found.setdefault(top(i), []).append(ids[i])
    return [min(found[top(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("dense", [16384, 2])
def test_near_duplicates_match_all_pairs(spark, dense, monkeypatch):
    r, base = random.Random(3), random.Random(5).getrandbits(64)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(150):  # a crowd around one value and chains that leave it
        x = r.choice(prints[60:] or [base])
        for _ in range(r.choice([1, 2, 3, 3, 5])):
            x ^= 1 << r.randrange(64)
        prints.append(x)
    prints += prints[:20]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in set(signed)], "simhash long")
    edges = simhash.links(nodes, dense=dense)
    roots = dict(tuple(r) for r in components(edges).collect())
    assert [roots.get(x, x) for x in signed] == plain_groups(signed, prints)


def test_fingerprints_and_components_of_documents(spark):
    rows = EDGES + [(20 + i, prose(i % 7, 40) + (" tail" if i > 10 else "")) for i in range(20)]
    found = simhash.near_duplicates(docs(spark, rows).withColumn("simhash", F.lit("taken"))).collect()
    assert len(found) == len(rows)
    known = [(i, t) for i, t in rows if i is not None]
    expected = dict(zip([i for i, _ in known], plain_groups([i for i, _ in known], [plain_print(t) for _, t in known])))
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]]
            assert r["simhash"] & (1 << 64) - 1 == plain_print(dict(known)[r["doc_id"]])


def test_one_row_of_each_group_stays(spark):
    text = prose(2, 80)
    rows = [(1, text), (2, text), (1, text), (3, prose(9, 80)), (4, None), (5, ""), (None, prose(11, 50))]
    kept = simhash.keep_one(docs(spark, rows).withColumn("extra", F.lit(1)))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4] and "extra" in kept.columns


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert set(found) == set(range(201)) | set(range(1000, 1300)) and {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1300)} == {1000}


# --- 2

def test_toxicity_learns_words_and_beginnings_and_marks_spans(spark):
    r, rows, labels = random.Random(4), [], []
    for i in range(900):
        text, bad = prose(1000 + i, r.randint(20, 80)), i % 6 == 0
        if bad:
            ws = text.split()
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(["Vermin!", "zorgling", "zorg" + r.choice(["a", "ix", "uma", "et"])]))
            text = " ".join(ws)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    table = docs(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table.where(~toxicity.held_out()), marks)
    found = toxicity.score(table.withColumn("score", F.lit("old")), model).where(toxicity.held_out()).collect()
    assert len(found) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 6 == 0) for r in found]) > 0.97
    spans = [r["text"][s["start"]:s["end"]] for r in found for s in r["toxic_spans"]]
    assert spans and np.mean(["ermin" in s or s.startswith("zorg") for s in spans]) > 0.95


def test_marginals_skip_plain_tokens_exactly():
    model = toxicity.Field({"=bad": 5.0, "ba": 1.0}, -2.5, (0.0, 0.3), ((0.2, -0.5), (0.1, 0.9)))
    tagger = toxicity.Tagger(model)
    e = np.full(40, np.nan)
    e[[0, 7, 8, 39]] = [1.0, 6.0, -2.0, 3.0]
    at, p, _ = tagger.marginals(e)
    boost = np.exp(np.nan_to_num(e) + model.bias)
    m, n = np.exp(np.array(model.move)), len(e)
    ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
    ahead[0] = np.exp(model.start) * [1, boost[0]]
    for t in range(1, n):
        ahead[t] = ahead[t - 1] @ m * [1, boost[t]]
    for t in range(n - 2, -1, -1):
        behind[t] = m @ (behind[t + 1] * [1, boost[t + 1]])
    joint = ahead * behind
    np.testing.assert_allclose(p, (joint[:, 1] / joint.sum(1))[at], rtol=1e-9)


def test_toxicity_without_labels_rejects_nothing(spark):
    table = docs(spark, EDGES)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(table, toxicity.fit(table, none)).collect()
    assert len(found) == len(EDGES) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(docs(spark, []), toxicity.Field()).count() == 0


# --- 3

def test_bpe_equals_the_library_and_decodes(spark):
    r = random.Random(6)
    strange = ["".join(r.choice("abc éü中文 \n\t''s12!?🙂\x00<|endoftext|>") for _ in range(r.randint(0, 70))) for _ in range(300)]
    rows = EDGES + [(100 + i, t) for i, t in enumerate(strange + ["ab" * 400, "é" * 700, " " * 999])]
    library = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=tokens.ranks(tokens.default_path()), special_tokens={})
    encoded = bpe.encode(docs(spark, rows))
    found = bpe.decode(encoded).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found) == want
    both = bpe.encode(docs(spark, rows), decoded="decoded").collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in both) == want


def test_decoding_of_null_and_partial_lists(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, None, 73])], "doc_id int, ids array<int>")
    vocabulary = {r: t for t, r in tokens.ranks(tokens.default_path()).items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(rows).collect()} == {1: b"", 2: b"", 3: vocabulary[72] + vocabulary[73]}


# --- 4

@pytest.mark.parametrize("block", [4096, 5])
def test_top_k_equals_sorting_everything(spark, block):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(160)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (320, [1.0, 2.0]), (340, [9e3, -9e3, 1.0, 0.0, 2.5, 3.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, score int")
    got = sorted(tuple(x) for x in topk.top_k(table, F.col("vec_id") % 20 == 0, 20, block=block).collect())
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") == 0).collect()) == [(0, 1, 1, 64 * 128)]


# --- 5

def test_extraction_of_unseen_labelled_pages():
    model, wrong, total = html_extract.fit(), 0, 0
    for page in html_pages.labelled_pages(150, seed=901):
        tree = html_extract.parse(page)
        p, _ = model.marginals(tree)
        y = html_extract.gold(tree)
        wrong, total = wrong + sum((p[n] >= 0.5) != y[n] for n, _ in tree.blocks), total + len(tree.blocks)
    assert wrong / total < 0.03


def test_tree_marginals_equal_enumeration():
    tree = html_extract.parse("<body><div class=ad>x</div><article><p>Some text.<p>More</article></body>")
    model = html_extract.Model({f: 0.37 * (i - 3) for i, f in enumerate(sorted({f for fs in html_extract.features(tree) for f in fs}))}, ((0.4, -0.9), (0.2, 0.8)))
    unary = [sum(model.weights[f] for f in fs) for fs in html_extract.features(tree)]
    n, mass, total = len(unary), np.zeros(len(unary)), 0.0
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        w = np.exp(sum(u for u, k in zip(unary, y) if k) + sum(model.tie[y[tree.parent[i]]][y[i]] for i in range(1, n)))
        total, mass = total + w, mass + w * np.array(y)
    np.testing.assert_allclose(model.marginals(tree)[0], mass / total, rtol=1e-9)


def test_extraction_of_broken_and_odd_pages(spark):
    page = ('<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>x</p> -->'
            '<article><h1>The &amp; title</h1><p>First <b>bold&nbsp;text</b>\n  goes<br>on here.<p>Second one is longer and ends.<div class="ad">Buy now and save.</div></article>'
            '<div id="comments"><p>Nice article, thanks a lot.</p></div><form><p>Search here</p></form><footer>&copy; me</footer>')
    table = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<"), (5, "u", "<p"), (6, "u", "<!--"), (7, "u", "<script>never closed")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table.withColumn("text", F.lit(0))).collect()}
    assert got[1] == "The & title\n\nFirst bold text goes on here.\n\nSecond one is longer and ends."
    assert got[2] == got[3] == got[6] == got[7] == ""
    assert html_extract.extract(table.limit(0)).count() == 0


# --- 6

def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = EDGES + [(50 + i, prose(i, n)) for i, n in enumerate([1500, 3, 900, 40, 2000, 77, 5000] * 4)] + [(99, "see <|endoftext|> here")]
    found = packing.pack_documents(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in found) // 2048) + 2


def test_sum_of_squares_follows_its_rule():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 41, 400)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    gaps = {}
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        def after(g):
            count = Counter(g)
            return sum(c * c for k, c in count.items() if k)
        options = [after([*gaps.values(), 40 - n])] + [after([*[v for k, v in gaps.items() if k != k2], gaps[k2] - n]) for k2 in gaps if gaps[k2] >= n]
        assert o == 40 - gaps.get(b, 40)
        gaps[b] = gaps.get(b, 40) - n
        assert after(gaps.values()) == min(options)


def test_packing_of_nothing_and_bad_lengths(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length long"))


# --- 7

def test_base_measures_match_plain_loops(spark):
    rows = EDGES + [(30, "a b c a b c a b c\n\na b c a b c a b c\n x | y # z"), (31, "l\nl\n l\nl\n\n\n"), (32, prose(3, 60) + " " + prose(3, 60))]
    found = quality_rules.quality_verdicts(docs(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        ws, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        many = {w for w, c in Counter(windows).items() if c > 1}
        covered = {k + d for k, w in enumerate(windows) if w in many for d in range(3)}
        n = len(ws)
        want[i, n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_limits_adapt_to_the_group_and_sketches_merge(spark):
    def doc(i, marks, lang, source):
        ws = prose(i, 80).split()
        return (i, " ".join(w + "#" * (k < marks) for k, w in enumerate(ws)), lang, source, 1)
    rows = [doc(i, 0, "en", "clean") for i in range(150)] + [doc(1000 + i, 20 + i % 9, "en", "code") for i in range(150)] + [doc(5000, 25, "en", "clean"), doc(5001, 25, "en", "code"), doc(5002, 25, None, None), doc(5003, 0, None, None)]
    table = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(table).collect()}
    assert kept[0] and kept[1000] and not kept[5000] and kept[5001]
    signals = quality_rules.with_signals(table, keep_text=False)
    whole = quality_rules.sketch(signals).groupBy("lang_key", "source_key", "rule", "bucket").agg(F.sum("n").alias("n"))
    parts = quality_rules.sketch(signals.where("doc_id % 2 = 0")).unionByName(quality_rules.sketch(signals.where("doc_id % 2 = 1"))).groupBy("lang_key", "source_key", "rule", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert quality_rules.quality_rules(table.limit(0)).count() == 0


# --- 8

def test_rotation_renders_every_view(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"), (2, 0, None, "x"), (None, None, "ann", "y"), (3, 0, "system", "alone")]
    found = chat.rotate(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, start int")).collect()
    views = {}
    for r in sorted(found, key=lambda r: r["position"]):
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    whole = "".join(r["rendered"] for r in views[1, "bob"])
    assert whole == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" + "<|im_start|>user name=ann\nBye<|im_end|>\n" * 2)
    for view in views.values():
        whole = "".join(r["rendered"] for r in view)
        for k, r in enumerate(view):
            assert r["position"] == k and whole[r["start"]:r["start"] + r["length"]] == r["rendered"]
            if r["shown"] == "assistant":
                assert whole[r["target_start"]:r["target_end"]].endswith("<|im_end|>") and r["name"] is None
            else:
                assert r["target_start"] is None
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 9

def test_cotraining_beats_the_majority_and_handles_edges(spark):
    r, rows, labels = random.Random(5), [], []
    for i in range(700):
        bad = i % 4 == 0
        text = prose(i, 90)
        rows.append((i, " ".join(w + "***" for w in text.split()) if bad else text, "en", "junk" if bad and i % 3 else "site", 500))
        if i % 2 or bad:
            labels.append((i, int(not bad), 0))
    table = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = cotrain.quality_scores(table, marks, rounds=2).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 700 and np.mean([r["kept"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97
    edge = cotrain.quality_scores(docs(spark, EDGES), marks.limit(0)).collect()
    assert len(edge) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edge)


# --- 10

def test_base_scores_match_counting(spark):
    rows = EDGES + [(40 + i, prose(i % 9, 30 + i)) for i in range(40)]
    found = lm.scores(docs(spark, rows), head=20, windows=200).collect()
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter()
    for i, t in rows:
        if learned(i):
            counts.update(words(lowered(t)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(lowered(t)), None]), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in [*words(lowered(t)), None]), 4)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] < 0 for r in found)


def test_windows_score_each_subword_once_and_probabilities_sum_to_one():
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, lm.VOCABULARY)
    classes = r.integers(0, lm.CLASSES, lm.VOCABULARY)
    places = r.integers(0, lm.PLACES, lm.VOCABULARY)
    cell = classes * lm.PLACES + places
    total, members = np.bincount(cell, counts, lm.CLASSES * lm.PLACES), np.bincount(cell, minlength=lm.CLASSES * lm.PLACES)
    share = np.log((counts + 0.5) / (total + 0.5 * members)[cell]).astype(np.float32)
    np.testing.assert_allclose(np.bincount(cell, np.exp(share), lm.CLASSES * lm.PLACES), 1, rtol=1e-3)
    shapes = {"embed": (lm.OWN + lm.CLASSES, lm.WIDTH), "q": (lm.WIDTH, lm.WIDTH), "k": (lm.WIDTH, lm.WIDTH), "v": (lm.WIDTH, lm.WIDTH), "bias": (lm.STRIDE, 2 * lm.STRIDE), "w1": (lm.WIDTH, lm.HIDDEN), "b1": (lm.HIDDEN,), "w2": (lm.HIDDEN, lm.WIDTH), "out": (lm.WIDTH, lm.CLASSES), "ob": (lm.CLASSES,), "inner": (lm.CLASSES, lm.WIDTH, lm.PLACES), "ib": (lm.CLASSES, lm.PLACES)}
    p = {k: (r.standard_normal(s) * 0.4).astype(np.float32) for k, s in shapes.items()}
    model = lm.Attention(r.integers(0, lm.OWN + lm.CLASSES, lm.VOCABULARY), classes, places, share, p)
    texts = [r.integers(0, 50000, n) for n in (0, 1, 15, 16, 17, 70)]

    def plain(ids):
        line, aim, score = [lm.END, *ids], [*ids, lm.END], 0.0
        for t in range(len(line)):
            low = max(0, (t // lm.STRIDE - 1) * lm.STRIDE)
            x = p["embed"][model.group[np.array(line[low:t + 1])]].astype(float)
            slot = t % lm.STRIDE
            s = (x[-1] @ p["q"]) @ (x @ p["k"]).T / np.sqrt(lm.WIDTH) + p["bias"][slot][[lm.STRIDE + slot - (t - j) for j in range(low, t + 1)]]
            a = np.exp(s - s.max())
            h = x[-1] + (a / a.sum()) @ (x @ p["v"])
            u = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
            c = classes[aim[t]]
            for e, won in ((u @ p["out"] + p["ob"], c), (u @ p["inner"][c] + p["ib"][c], places[aim[t]])):
                score += e[won] - np.log(np.exp(e).sum())
            score += share[aim[t]]
        return score / np.log(10)
    np.testing.assert_allclose(model.score(texts), [plain(t) for t in texts], rtol=1e-3)


def test_every_training_window_teaches(spark):
    r = np.random.default_rng(5)
    line = ["stone", "river", "cloud", "apple", "house", "light", "green", "table"]
    rows = [(i, " ".join(line[(at + j) % 8] for j in range(1000))) for i, at in enumerate(r.integers(0, 8, 1000).tolist())]
    # One word follows from the one before; eight windows alone cannot teach that.
    found = lm.scores(docs(spark, rows), windows=8).where(~F.col("trained")).agg(F.sum("score") / F.sum("n_subwords")).first()[0]
    assert found > -0.8


def test_neighbours_are_counted_over_all_training_texts(spark):
    rows = [(i, t) for i, t in enumerate([prose(k, 12) for k in range(30)] + ["", None, "one"])]
    prepared = lm.prepare(docs(spark, rows), {}, 1, "doc_id", "text", tokens.default_path())
    counts = lm.subword_counts(prepared)
    near = {w: k for k, w in enumerate(np.argsort(-counts, kind="stable")[:255].tolist())}
    want = Counter()
    for row in prepared.where("trained").collect():
        line = [lm.END, *np.frombuffer(row["ids"], np.uint16).tolist(), lm.END]
        for a, b in zip(line, line[1:]):
            want[a, near.get(b, 255)] += 1
            want[b, 256 + near.get(a, 255)] += 1
    table = lm.neighbour_counts(prepared, counts)
    assert {(int(a), int(b)): int(table[a, b]) for a, b in zip(*np.nonzero(table))} == want


# --- pipeline and registration

def test_near_duplicate_stage_links_all_pairs_of_five_word_similarity(spark):
    r = random.Random(4)
    rows = list(EDGES)
    for k in range(40):
        text = prose(500 + k, 150).split()
        rows.append((1000 + 10 * k, " ".join(text)))
        for copy in range(1, 6):  # one to five changed words
            changed = list(text)
            for at in r.sample(range(len(text)), copy):
                changed[at] = f"other{r.randrange(10 ** 6)}"
            rows.append((1000 + 10 * k + copy, " ".join(changed)))

    def grams(text):
        w = words(lowered(text))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for (i, _), g in zip(rows, group):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(best.values())


def test_stages_work_on_edges_and_keep_the_columns(spark, tmp_path):
    rows = EDGES + [(100 + i, prose(i, 120)) for i in range(30)] + [(200 + i, prose(0, 120)) for i in range(5)]
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.materialize(stage(spark, table, str(tmp_path)))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = sorted(r["doc_id"] for r in table.collect() if r["doc_id"] is not None)
    assert [i for i in kept if i >= 100] == list(range(100, 130))  # clean ones stay, copies of 100 go
    last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} >= set(range(100, 130))


def test_registered_queries_run_over_the_small_tables(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, SMALL).count() > 0, name
