"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target weight x total size / source size.
Each document draws its number of copies from a Poisson distribution of that
mean, by inverting the distribution at a uniform number hashed from the seed
and the document id, so that a rerun or another partitioning draws the same.
Copies are exploded and shuffled globally by a hash of (seed, id, copy): the one
shuffle that texts go through.

Edge cases: a null id hashes as ''; rows with equal ids draw equally; an empty or
null text has size 0 but is drawn by its source's rate; a null source is a source
of its own; a source without weight, or whose texts are all empty, gives no row; an
empty table gives an empty one; mix_* columns of the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

#: Poisson draws of a larger mean are sums of draws of at most this mean each.
MEAN_PART = 16.0
#: Up to so many sources their rates are broadcast (a few hundred bytes each); beyond, the join is salted by document.
MAX_BROADCAST, SALTS = 10_000, 64
#: Inverse terms: beyond MEAN_PART + 64 the remaining probability is below 2**-60.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): size in code points. `weights` gives target shares (default: equal); a source without a weight, or of size 0, has rate 0. A null source counts as a source of its own, named by the key None."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("size"))
    # one partial row per source after aggregation: a small table, totalled without a window over documents
    totals = sizes.where("size > 0").agg(F.sum("size").alias("total"), F.count("*").alias("sources"))
    if weights is None:
        weight = F.lit(1.0) / F.col("sources")
    else:
        whole = float(sum(weights.values()))
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(w / whole)).otherwise(weight)
    rate = F.when(F.col("size") > 0, F.lit(float(epochs)) * weight * F.col("total") / F.col("size")).otherwise(F.lit(0.0))
    return sizes.join(F.broadcast(totals), how="cross").select("source", "size", rate.alias("rate"))  # totals is one row


def _inverse(mean: Column, u: Column) -> Column:
    """The Poisson quantile of u: the number of partial sums of the distribution that are <= u."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["k"] + F.when(acc["c"] <= u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    parts = F.greatest(F.ceil(rate / F.lit(MEAN_PART)).cast("int"), F.lit(1))
    draws = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: _inverse(rate / parts, uniform(F.lit(seed), doc_id, j)))
    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, each row repeated as drawn, plus mix_copy (0-based) and mix_key (the hash it is shuffled by).

    Rows are dealt to partitions by mix_key and sorted by it inside them, so
    neighbours in the output are unrelated and a hot source spreads evenly.
    The rates, a row per source, are computed first and written to the shared
    folder; documents meet them where they are.
    """
    work = Workspace(docs.sparkSession, "mixing")
    drawn = work.keep(rates(docs, source_col, text_col, weights, epochs).where("rate > 0").select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), "rates")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.drop("mix_copy", "mix_key")
    names = rows.columns
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    if drawn.count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(drawn), same)
    else:
        salted = drawn.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__at", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__at") == F.col("__salt")))
    rows = rows.withColumn("__n", copies(ident, F.col("__rate"), seed)).where("__n > 0")
    rows = rows.select(*names, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("mix_copy"))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), ident, F.col("mix_copy").cast("string"), F.lit("order")).cast("binary")))
    return rows.repartition("mix_key").sortWithinPartitions("mix_key")


def expected_counts(rate: float, n: int) -> float:
    """The mean number of rows that n documents of one rate give, for checks."""
    return rate * n if math.isfinite(rate) else 0.0
