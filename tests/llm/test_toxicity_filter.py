"""The filter of the toxicity stage: its cut, held-out labels, and a toxic passage inside a long clean text."""

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_the_cut_catches_most_of_what_the_clean_share_allows():
    scores, toxic = np.array([0.01, 0.02, 0.03, 0.9, 0.04, 0.3, 0.8]), np.array([0, 0, 0, 0, 1, 1, 1], bool)
    assert 0.03 < toxicity.best_cut(scores, toxic, clean=0.75) <= 0.04
    assert toxicity.best_cut(scores, toxic, clean=1.0) == 0.5 and toxicity.best_cut(np.array([0.2, 0.6]), np.array([False, True])) <= 0.5


def test_held_out_labels_and_one_passage_in_a_long_text(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs.where(~toxicity.held_out()), labels)
    known = toxicity.score(docs.where(toxicity.held_out()).select("doc_id", "text", "n_chars"), model, threshold=model.cut).join(
        labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    bad, good = known[known.toxic == 1], known[known.toxic == 0]
    assert bad.predicted.mean() >= 0.92 and (good.predicted == 0).mean() >= 0.95
    long = " ".join(good[good.score < 0.01].text.iloc[:40])
    rows = []
    for text, spans in zip(bad.text, bad.toxic_spans):
        if len(spans):
            at = spans[0]["start"]
            rows.append((len(rows), long[:len(long) // 2] + " " + text[max(0, at - 60):spans[-1]["end"] + 60][:400] + " " + long[len(long) // 2:]))
    rows.append((-1, long))
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model, threshold=model.cut, spans=False).collect()}
    planted = [v for k, v in found.items() if k >= 0]
    assert len(planted) > 50 and sum(planted) / len(planted) >= 0.9 and found[-1] == 0
