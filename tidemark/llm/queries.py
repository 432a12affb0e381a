"""The registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, embeddings, jaccard, langid, licenses, mixing, pieces, quality_rules, rule_ensemble, toxicity
from tidemark.llm.common import held_out

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels").where(~held), "quality")
    scored = rule_ensemble.classify(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weight for every source, one epoch in all."""
    return mixing.mix(table(spark, sf_dir, "documents"), epochs=1.0, seed=7)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


CONTROL_CASE = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', 'assistant') role, '{CONTROL_CASE}' text FROM range(0, 2, 1, 1)")
    read = chat.read_chats(chat.format_chats(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256(lines).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        sha256(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held), "toxic", copies_once=True)
    rows = toxicity.scored(docs, model, ["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    found = langid.identify(docs, langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(table(spark, sf_dir, "documents"), piece_model(), digests_only=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_quality": op1_quality, "op3_jaccard": op3_jaccard, "op5_embeddings": op5_embeddings, "op6_licenses": op6_licenses, "op7_toxicity": op7_toxicity, "op8_language": op8_language, "op2_mix": op2_mix, "op4_chat": op4_chat, "op9_pieces": op9_pieces, "op10_quality_rules": op10_quality_rules}

_OP2_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS ident FROM documents
), sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM docs GROUP BY source
), totals AS (
  SELECT sum(size) AS total, count(*) AS sources FROM sizes WHERE size > 0
), rates AS (
  SELECT source, 1.0 / sources * total / size AS rate, greatest(CAST(ceil(1.0 / sources * total / size / {mixing.MEAN_PART}) AS INTEGER), 1) AS parts
  FROM sizes, totals WHERE size > 0
), terms AS (
  SELECT source, rate / parts AS mean, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k + 1 < {mixing.TERMS}
), draws AS (
  SELECT d.doc_id, d.ident, d.source, d.text, d.lang, d.n_chars, j.part,
    CAST(CAST('0x' || substr(md5('7:' || d.ident || ':' || CAST(j.part AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
  JOIN (SELECT unnest(range(0, 1000)) AS part) j ON j.part < r.parts
), counted AS (
  SELECT w.doc_id, w.ident, w.source, w.text, w.lang, w.n_chars, w.part, count(t.k) AS n
  FROM draws w LEFT JOIN terms t ON w.source IS NOT DISTINCT FROM t.source AND t.c <= w.u
  GROUP BY ALL
), totalled AS (
  SELECT doc_id, ident, source, text, lang, n_chars, sum(n) AS n FROM counted GROUP BY doc_id, ident, source, text, lang, n_chars
), numbers AS (
  SELECT unnest(range(0, 10000)) AS mix_copy
)
SELECT doc_id, text, lang, source, n_chars, CAST(mix_copy AS INTEGER) AS mix_copy, md5('7:' || ident || ':' || CAST(mix_copy AS VARCHAR) || ':order') AS mix_key
FROM totalled JOIN numbers ON mix_copy < n
"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_OP4_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_CASE}'
), marked AS (
  SELECT *, {_ESC.format("text")} AS escaped, replace({_ESC.format("role")}, chr(10), '<\n>') AS escaped_role,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN prev = role THEN {len(chat.SEP)} ELSE {len(chat.START) + len(chat.END) + 2} + length(escaped_role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def _op10_sql() -> str:
    measures = ", ".join(f"CASE WHEN n_words > 0 THEN {m.replace(' div ', ' // ')} ELSE 0 END AS m_{name}" for name, (m, _) in quality_rules.RULES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, m_{name} AS v FROM measured WHERE NOT base_failed" for name in quality_rules.RULES)
    slack = " ".join(f"WHEN '{name}' THEN {least}" for name, (_, least) in quality_rules.RULES.items())
    beyond = " OR ".join(f"(rule = '{name}' AND m_{name} > fence)" for name in quality_rules.RULES)
    shift = "greatest(length(bin(v)) - 5, 0)"

    def quantiles(keys: str, as_of: str) -> str:
        part = f"PARTITION BY {keys}rule"
        return f"""SELECT {keys}rule, max(total) AS docs, min(CASE WHEN 100 * seen >= 25 * total THEN top END) AS q25, min(CASE WHEN 100 * seen >= 75 * total THEN top END) AS q75
          FROM (SELECT {keys}rule, top, sum(n) OVER ({part} ORDER BY top) AS seen, sum(n) OVER ({part}) AS total FROM
            (SELECT {keys}rule, top, count(*) AS n FROM tops GROUP BY {keys}rule, top)) GROUP BY {keys}rule"""

    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), numbered AS (
  SELECT doc_id, len(words) AS n, words, unnest(range(1, len(words) - {quality_rules.WINDOW - 2})) AS i FROM split WHERE len(words) >= {quality_rules.WINDOW}
), windows AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + {quality_rules.WINDOW - 1}], ' ') AS w FROM numbered
), repeated AS (
  SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + {quality_rules.WINDOW})) AS p FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, sum(n - 1) AS d FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), stats AS (
  SELECT s.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^!?]', '', 'g')) AS BIGINT) AS n_marks, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM split s LEFT JOIN lines l ON s.doc_id = l.doc_id LEFT JOIN repeats p ON s.doc_id = p.doc_id
), measured AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {measures} FROM stats
), long AS ({long}
), tops AS (
  SELECT lang, source, rule, CASE WHEN v < 32 THEN v ELSE ((v >> {shift}) + 1) * CAST(pow(2, {shift}) AS BIGINT) - 1 END AS top FROM long
), own AS ({quantiles("lang, source, ", "own")}
), by_lang AS ({quantiles("lang, ", "lang")}
), by_all AS ({quantiles("", "all")}
), picked AS (
  SELECT o.lang, o.source, o.rule,
    CASE WHEN o.docs >= {quality_rules.MIN_DOCS} THEN o.q25 WHEN l.docs >= {quality_rules.MIN_DOCS} THEN l.q25 ELSE a.q25 END AS q25,
    CASE WHEN o.docs >= {quality_rules.MIN_DOCS} THEN o.q75 WHEN l.docs >= {quality_rules.MIN_DOCS} THEN l.q75 ELSE a.q75 END AS q75
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN by_all a ON o.rule = a.rule
), fences AS (
  SELECT lang, source, rule, q75 + greatest({quality_rules.FACTOR} * (q75 - q25), CASE rule {slack} END) AS fence FROM picked
), beyond AS (
  SELECT DISTINCT doc_id FROM measured m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source WHERE {beyond}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM measured
"""


ORACLE_SQL = {"op2_mix": _OP2_SQL, "op4_chat": _OP4_SQL, "op10_quality_rules": _op10_sql()}
