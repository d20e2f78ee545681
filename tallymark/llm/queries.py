"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, centroids, chat, conversations, cotrain, html_extract, lm, packing, quality_rules, simhash, token_files, topk, toxicity
from tallymark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs.where(~toxicity.held_out()), table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode(table(spark, folder, "documents"), decoded="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html_extract.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def op9_cotrain(spark: SparkSession, folder: str) -> DataFrame:
    return cotrain.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    found = lm.scores(table(spark, folder, "documents"))
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, folder, "documents")))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.audited(rows, conversations.damage(rows))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_digest(F.col("centroid")).alias("centroid_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_bpe, op4_topk, op5_html, op6_packing, op7_quality_rules, op8_chat, op9_cotrain, op10_lm, op11_token_files, op12_conversations, op13_centroids)}
_LIMITS = " UNION ALL ".join(f"""
        SELECT {level} AS level, {lang} AS lang_key, {source} AS source_key, rule, max(total) AS total,
               min(value) FILTER (WHERE upto >= ceil(0.5::DOUBLE * total)) AS mid, min(value) FILTER (WHERE upto >= ceil(0.1::DOUBLE * total)) AS low FROM (
          SELECT *, sum(n) OVER (PARTITION BY {keys} rule ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys} rule) AS total,
                 coalesce(2 * pow(1.02::DOUBLE, bucket) / (1.02::DOUBLE + 1), 0) AS value FROM (
            SELECT {columns} rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""
    for level, lang, source, keys, columns in ((1, "lang_key", "source_key", "lang_key, source_key,", "lang_key, source_key,"), (2, "lang_key", "NULL", "lang_key,", "lang_key,"), (3, "NULL", "NULL", "", "")))
_CUT = "mid + spreads * (mid - low) + slack"

ORACLES: dict[str, str] = {
    "op12_conversations": conversations.ORACLE,
    "op13_centroids": centroids.ORACLE,
    "op7_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS lang_key, coalesce('=' || source, '') AS source_key, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        g AS (SELECT row, i, count(*) OVER (PARTITION BY row, ws[i], ws[i + 1], ws[i + 2]) AS times FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        rep AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times > 1) GROUP BY row),
        m AS (SELECT w.row, doc_id, lang_key, source_key, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN rep USING (row)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        rules(rule, spreads, slack) AS (VALUES {", ".join(f"('{r}', {k}::DOUBLE, {s}::DOUBLE)" for r, (_, _, k, s) in quality_rules.RULES.items())}),
        v AS (SELECT row, lang_key, source_key, base_failed, rule, top::DOUBLE AS top, bottom::DOUBLE AS bottom FROM (
          {" UNION ALL ".join(f"SELECT row, lang_key, source_key, base_failed, '{r}' AS rule, {t} AS top, {u} AS bottom FROM b" for r, (t, u, _, _) in quality_rules.RULES.items())})),
        sketch AS (SELECT lang_key, source_key, rule, CASE WHEN share >= 1e-4 THEN ceil(round(ln(share) / ln(1.02::DOUBLE), 9)) END AS bucket, count(*) AS n FROM (
          SELECT *, coalesce(top / nullif(bottom, 0), 0) AS share FROM v WHERE NOT base_failed) GROUP BY ALL),
        limits AS ({_LIMITS}),
        cuts AS (SELECT limits.*, {_CUT} AS most FROM limits JOIN rules USING (rule)),
        verdict AS (SELECT v.row, bool_and(coalesce(top <= bottom * CASE WHEN o.total >= 100 THEN o.most WHEN o.total IS NULL THEN NULL WHEN l.total >= 100 THEN l.most ELSE a.most END, FALSE)) AS within FROM v
          LEFT JOIN cuts o ON o.level = 1 AND o.rule = v.rule AND o.lang_key = v.lang_key AND o.source_key = v.source_key LEFT JOIN cuts l ON l.level = 2 AND l.rule = v.rule AND l.lang_key = v.lang_key LEFT JOIN cuts a ON a.level = 3 AND a.rule = v.rule GROUP BY v.row)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM b JOIN verdict USING (row)
    """,
    "op4_topk": """
        WITH whole AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
    """,
    "op8_chat": """
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
        people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
        seen AS (
          SELECT s.*, p.perspective, CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS shown
          FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        headed AS (
          SELECT *, '<|im_start|>' || shown || CASE WHEN shown = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head,
                 replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS tail FROM seen),
        placed AS (
          SELECT *, head || tail AS rendered, length(head || tail) AS length, row_number() OVER o - 1 AS position,
                 CAST(coalesce(sum(length(head || tail)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
          FROM headed WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
        SELECT conv_id, perspective, position, shown, CASE WHEN shown = 'user' THEN speaker END AS name, rendered, start, length,
               CASE WHEN shown = 'assistant' THEN start + length(head) END AS target_start,
               CASE WHEN shown = 'assistant' THEN start + length - 1 END AS target_end
        FROM placed
    """,
}
