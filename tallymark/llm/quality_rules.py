"""Quality rules whose thresholds adapt to each language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm.common import chunks, free_names, text_bytes
from tallymark.session import materialize

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_signals(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of one UTF-8 text.

    An empty text has zeros everywhere.
    """
    words = text.split()  # bytes are cut at ASCII white space only
    letters = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(letters.translate(None, _CONTINUATION)),
        len(letters) - len(letters.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Relative width of a sketch bucket, and the value below which a share counts as zero.
GAMMA, SMALLEST = 1.02, 1e-4
#: share: (numerator, denominator, spreads above the median, slack). The slack keeps a group whose
#: members all show the same value (often zero) from rejecting everything a hair above it.
RULES = {
    "symbol_share": ("n_symbols", "word_chars", 3.0, 0.01),
    "repeat_share": ("n_repeat_words", "n_words", 3.0, 0.3),
    "dup_line_share": ("n_dup_lines", "n_lines", 3.0, 0.35),
    "mean_word": ("word_chars", "n_words", 6.0, 1.5),
}
#: Groups up to which their limits are sent to every task; more are joined by a shuffle.
SENT = 50_000
#: Documents below which a group borrows its language's thresholds, and a language those of all.
MIN_GROUP = 100


def with_signals(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the base measures of every whole text; null text counts as empty.

    Columns of the same names are replaced; all other columns pass through untouched.
    """
    docs = free_names(docs, SIGNALS)
    if not keep_text:
        kept = [c for c in docs.columns if c != text]
    else:
        kept = docs.columns
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in SIGNALS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                texts = text_bytes(part.column(part.schema.get_field_index(text)))
                columns = list(zip(*map(text_signals, texts)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(c, pa.int64()) for c in columns],
                    names=[*kept, *SIGNALS])

    return docs.mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _group(column: str) -> Column:
    """A key that is never null and keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _shares() -> Column:
    """The rules' values as rows (rule, value)."""
    return F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0)).alias("value"))
        for name, (top, bottom, _, _) in RULES.items()])).alias("share")


def sketch(signals: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable quantile sketches: counts per logarithmic bucket, for each language and source.

    Counts of equal buckets add up in any order, so partial sketches of tasks, days or clusters
    merge exactly; a quantile read from them is within 1 % of the true value. Rows: lang_key,
    source_key, rule, bucket (null: zero), n. Documents that fail the base rules take no part.
    """
    bucket = F.when(F.col("share.value") >= SMALLEST, F.ceil(F.round(F.log(F.col("share.value")) / F.log(F.lit(GAMMA)), 9)))
    return (
        signals.where(~base_failed())
        .select(_group(lang).alias("lang_key"), _group(source).alias("source_key"), _shares())
        .groupBy("lang_key", "source_key", F.col("share.rule").alias("rule"), bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketches: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Upper limit of every rule per language and source, read from merged sketches.

    A limit is the median plus so many times the distance from the tenth percentile to the median,
    plus a slack. The lower half sets the spread, so junk of up to half of a group cannot widen it.
    Groups of fewer than ``min_group`` documents take the limits of their language, languages of
    fewer those of all documents. One row per group: lang_key, source_key, and a column per rule.
    """
    def limits(keys: list[str]) -> DataFrame:
        merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "rule")  # at most one row per bucket of the sketch
        upto = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = merged.select(*keys, "rule", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"),
                               F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0)).alias("value"))
        at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("value")))
        read = placed.groupBy(*keys, "rule").agg(at(0.5).alias("mid"), at(0.1).alias("low"), F.max("total").alias("total"))
        cut = F.lit(None).cast("double")
        for name, (_, _, spreads, slack) in RULES.items():
            cut = F.when(F.col("rule") == name, F.col("mid") + spreads * (F.col("mid") - F.col("low")) + slack).otherwise(cut)
        return read.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("rule") == n, cut)).alias(n) for n in RULES])

    own, by_lang, all_docs = limits(["lang_key", "source_key"]), limits(["lang_key"]), limits([])
    wide = own.alias("o").join(by_lang.alias("l"), "lang_key", "left").join(F.broadcast(all_docs.alias("a")), F.lit(True), "left")  # one row
    chosen = lambda n: F.when(F.col("o.total") >= min_group, F.col(f"o.{n}")).when(F.col("l.total") >= min_group, F.col(f"l.{n}")).otherwise(F.col(f"a.{n}"))
    return wide.select("lang_key", F.col("o.source_key").alias("source_key"), *[chosen(n).alias(f"most_{n}") for n in RULES])


def judged(signals: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join every document with its group's limits: adds base_failed and kept.

    ``limits`` is written already. Its rows are counted, so that documents need not move for the
    usual few groups.
    """
    limits = F.broadcast(limits) if limits.count() <= SENT else limits
    keyed = signals.withColumns({"lang_key": _group(lang), "source_key": _group(source), "base_failed": base_failed()})
    within = ~F.col("base_failed")
    for name, (top, bottom, _, _) in RULES.items():
        within = within & (F.col(top) <= F.col(f"m.most_{name}") * F.col(bottom))
    joined = keyed.alias("d").join(limits.alias("m"), ["lang_key", "source_key"], "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in signals.columns], "base_failed", F.coalesce(within, F.lit(False)).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """All columns of ``docs`` plus the signals, base_failed and kept.

    Null text: no words, fails the base rules. Null language or source: a group of its own.
    Repeated rows are judged each. Columns with the names of results are replaced. The signals are
    computed twice (once for the sketches, without moving any text) rather than written with the texts.
    """
    docs = free_names(docs, ("base_failed", "kept", "lang_key", "source_key"))
    narrow = with_signals(docs.select(text, lang, source), text, keep_text=False)
    return judged(with_signals(docs, text), materialize(thresholds(sketch(narrow, lang, source), min_group)), lang, source)


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                     min_group: int = MIN_GROUP) -> DataFrame:
    """Like ``quality_rules`` without the texts: they are read once, and only measures move on."""
    signals = materialize(with_signals(docs.select(doc_id, text, lang, source), text, keep_text=False))
    return judged(signals, materialize(thresholds(sketch(signals, lang, source), min_group)), lang, source)
