"""Quality rules with adaptive thresholds per language and source.

One pass over the texts counts each document's statistics in numpy. Each rule's
measure, an integer, then goes into a mergeable quantile sketch per (language,
source): a log-linear histogram, whose buckets are found by integer arithmetic
(values below 32 exactly, beyond that 16 buckets an octave, so a quantile is off
by at most 1/16 of its value). Sketches of parts add up by bucket, so groups are
summed with partial aggregation, whatever share of the rows one of them holds,
and the sketches of a language or of all rows are sums of smaller ones. A
group's fence is q75 + max(FACTOR x (q75 - q25), slack); documents join their
group's fences and go if a measure lies beyond. Groups under MIN_DOCS rows use
their language's sketch, or that of all rows.

Edge cases: a null text has no words; a null language or source is a group of
its own; ids may repeat or be null, each row is judged by itself; an empty table
gives an empty one; other columns of the input pass through or are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, chunks, lean, small_batches, window_hashes, word_hashes, word_spans

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
FACTOR, MIN_DOCS = 3, 50
#: Rule: measure (per 1000 words or characters, from the statistics) and least distance of its fence from q75.
RULES = {
    "symbols": ("1000 * n_symbols div n_words", 200),
    "dup_lines": ("1000 * n_dup_lines div n_words", 60),
    "marks": ("1000 * n_marks div n_words", 200),
    "capitals": ("1000 * n_capitals div word_chars", 300),
    "word_length": ("100 * word_chars div n_words", 600),
    "repeats": ("1000 * n_repeat_words div n_words", 200),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"
_SPLIT_LINES = re.compile("\n")


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def text_statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    for a, b in chunks(texts):
        buf, starts, ends, first = word_spans(texts[a:b])
        words = word_hashes(buf, starts, ends)
        runs = window_hashes(words, WINDOW)
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        marks = [inside & ((buf & 0xC0) != 0x80), _SYMBOL[buf], (buf == 33) | (buf == 63), (buf >= 65) & (buf <= 90)]
        text_start = np.append(starts, len(buf))[first]  # marks stand in words, so words bound them
        sums = [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in marks]
        rows = out[a:b]
        rows[:, 0] = np.diff(first)
        for column, total in zip((1, 2, 5, 6), sums, strict=True):
            rows[:, column] = np.diff(total[text_start])
        for i in range(b - a):
            s, e = first[i], first[i + 1]
            if text := texts[a + i]:
                rows[i, 3] = _dup_lines(text)
            if e - s > WINDOW:
                own = runs[s : e - WINDOW + 1]
                _, back, count = np.unique(own, return_inverse=True, return_counts=True)
                if count.max() > 1:
                    cover = np.zeros(e - s + 1, np.int64)
                    at = np.flatnonzero(count[back] > 1)
                    cover[at] += 1
                    np.add.at(cover, at + WINDOW, -1)
                    rows[i, 4] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out


def _counted(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs as k0, k1 ... and STATS. The text goes to Python once, also where it is kept."""
    columns = keep if text_col in keep else [*keep, text_col]  # the text goes to Python once, also where it is kept
    texts = columns.index(text_col)
    source = small_batches(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))
    schema = source.select([f"k{i}" for i in range(len(keep))]).schema
    for name in STATS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_statistics(batch.column(texts).to_pylist())
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(stats[:, j]) for j in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(cols, names=[f"k{i}" for i in range(len(keep))] + STATS)

    return source.mapInArrow(lean(run), schema)


def statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs plus STATS; the text itself is carried on only where `keep` names it."""
    keep = keep or []
    return _counted(docs, text_col, keep).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The sketch bucket of a non-negative integer, in order of value: 32 exact ones, then 16 an octave."""
    shift = F.greatest(F.char_length(F.bin(value)) - 5, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", value, shift)).cast("long")


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.floor(number / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", number - shift * 16 + 1, shift) - 1


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q25 and q75 (bucket tops) per group and rule of a sketch (keys, rule, bucket, n). A group has at most some 900 buckets a rule, so its array is bounded."""
    groups = sketch.groupBy(*keys, "rule").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("docs"))

    def at(percent: int) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit"))
        found = F.aggregate(
            "b",
            zero,
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["hit"], F.when(100 * (a["seen"] + x["n"]) >= percent * F.col("docs"), x["bucket"])).alias("hit")),
        )
        return bucket_top(found["hit"])

    return groups.select(*keys, "rule", "docs", at(25).alias("q25"), at(75).alias("q75"))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, bucket, n): the mergeable sketches of every rule's measure, over rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), bucket(F.col(name)).alias("bucket")) for name in RULES])
    rows = measured.where(~F.col("base_failed")).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.rule", "x.bucket")
    return rows.groupBy(*keys, "rule", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): a fence for each rule, from the group's own sketch or the first larger one with MIN_DOCS rows."""
    by_lang = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(by_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("lr"), F.col("docs").alias("ldocs"), F.col("q25").alias("l25"), F.col("q75").alias("l75"))
    every = _quantiles(by_all, []).select(F.col("rule").alias("ar"), F.col("q25").alias("a25"), F.col("q75").alias("a75"))
    rows = own.join(lang, (F.col("lang").eqNullSafe(F.col("l"))) & (F.col("rule") == F.col("lr"))).join(every, F.col("rule") == F.col("ar"))

    def pick(q: str) -> Column:
        return F.when(F.col("docs") >= MIN_DOCS, F.col(f"q{q}")).when(F.col("ldocs") >= MIN_DOCS, F.col(f"l{q}")).otherwise(F.col(f"a{q}"))

    slack = F.lit(None).cast("long")
    for name, (_, least) in RULES.items():
        slack = F.when(F.col("rule") == name, F.lit(least).cast("long")).otherwise(slack)
    fence = pick("75") + F.greatest(F.lit(FACTOR) * (pick("75") - pick("25")), slack)
    return rows.groupBy("lang", "source").pivot("rule", list(RULES)).agg(F.max(fence))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, lang, source, STATS, base_failed, kept. The statistics are written once to the shared folder, so texts are read once."""
    work = Workspace(docs.sparkSession, "quality-rules")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = work.keep(statistics(named, "text", ["doc_id", "lang", "source"]), "statistics")
    measured = stats.withColumn("base_failed", base_failed())
    for name, (measure, _) in RULES.items():
        measured = measured.withColumn(name, F.expr(f"CASE WHEN n_words > 0 THEN {measure} ELSE 0 END"))
    limits = fences(sketches(measured, ["lang", "source"]))
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(name).alias(f"__{name}") for name in RULES])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    beyond = F.lit(False)
    for name in RULES:
        beyond = beyond | F.coalesce(F.col(name) > F.col(f"__{name}"), F.lit(False))
    return joined.select("doc_id", "lang", "source", *STATS, "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"))


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns.

    Fences come from one pass over the statistics; the second pass recounts a
    text's statistics beside the row instead of joining by id, so ids may
    repeat or be null and no text is shuffled unless the fences, a row per
    (language, source), outgrow Spark's own size check for broadcasting.
    """
    work = Workspace(docs.sparkSession, "quality-filter")
    named = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = statistics(named, "text", ["lang", "source"]).withColumn("base_failed", base_failed())
    for name, (measure, _) in RULES.items():
        stats = stats.withColumn(name, F.expr(f"CASE WHEN n_words > 0 THEN {measure} ELSE 0 END"))
    limits = work.keep(fences(work.keep(sketches(stats, ["lang", "source"]), "sketch")), "fences")
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(name).alias(f"__{name}") for name in RULES])
    names = docs.columns
    counted = _counted(docs, text_col, names).withColumn("__failed", base_failed())
    lang, source = (F.col(f"k{names.index(c)}") for c in (lang_col, source_col))
    joined = counted.join(limits, lang.eqNullSafe(F.col("__lang")) & source.eqNullSafe(F.col("__source")), "left")
    good = ~F.col("__failed")
    for name, (measure, _) in RULES.items():
        good = good & ~F.coalesce(F.expr(f"CASE WHEN n_words > 0 THEN {measure} ELSE 0 END") > F.col(f"__{name}"), F.lit(False))
    return joined.where(good).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
