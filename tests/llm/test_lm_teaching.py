"""The language-model query teaches with the windows of all training documents."""

import inspect

from tallymark.llm import lm, queries


def test_every_window_of_the_query_teaches(spark, monkeypatch, tmp_path):
    asked = {}

    def scores(*args, **named):
        call = inspect.signature(original).bind(*args, **named)
        call.apply_defaults()
        asked.update(call.arguments)
        raise InterruptedError

    original = lm.scores
    monkeypatch.setattr(lm, "scores", scores)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        queries.op10_lm(spark, str(tmp_path))
    except InterruptedError:
        pass
    assert asked["share"] == 1.0
