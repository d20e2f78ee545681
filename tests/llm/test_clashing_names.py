"""Columns of the caller whose names the stages use themselves, and columns that cannot be compared."""

import random

from pyspark.sql import functions as F

from tallymark.llm import lm, near_copies, quality_rules


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_keep_any_columns(spark):
    text = prose(1, 200)
    given = docs(spark, [(1, text), (2, text + " tail"), (3, prose(2, 100)), (3, prose(2, 100)), (4, None)])
    given = given.withColumns({"_id": F.lit("mine"), "_copies": F.lit(9), "_content": F.lit("c"), "_row": F.lit("r"), "_text": F.lit("t"), "map": F.create_map(F.lit("a"), "doc_id")})
    kept = near_copies.keep_one(given)
    assert kept.columns == given.columns
    assert sorted((r["doc_id"], r["_id"], r["_copies"], r["map"]["a"]) for r in kept.collect()) == [(i, "mine", 9, i) for i in (1, 3, 4)]


def test_near_copies_keep_rows_of_one_id_that_are_null_in_other_columns(spark):
    text = prose(3, 120)
    given = spark.createDataFrame([(5, text, None), (5, None, text), (6, text, "en")], "doc_id long, text string, lang string")
    kept = near_copies.keep_one(given).collect()
    assert sorted((r["doc_id"], r["text"] is None) for r in kept) == [(5, False), (5, True)]


def test_quality_rules_keep_columns_named_like_limits(spark):
    given = docs(spark, [(i, prose(i, 80)) for i in range(20)]).withColumns({"most_mean_word": F.lit(-1), "total": F.lit("x")})
    found = quality_rules.quality_rules(given)
    assert set(given.columns) <= set(found.columns) and {r["most_mean_word"] for r in found.collect()} == {-1} and found.where("kept").count() > 0


def test_scores_of_no_documents(spark):
    assert lm.scores(docs(spark, [])).count() == 0


def test_breaks_and_marks_count_in_the_score(spark):
    rows = [(i, prose(i, 60)) for i in range(40)] + [(100, "one two three. four"), (101, "one\n\ntwo  three . four")]
    found = {r["doc_id"]: (r["n_subwords"], r["score"]) for r in lm.scores(docs(spark, rows), windows=50).collect()}
    assert found[100] != found[101]
