"""Exact length histogram of encoded documents, and what it answers for every context limit.

One row per length that occurs is a lossless summary for all questions about lengths. Lengths are summed
from the longest down in two steps, within ranges of lengths and over the ranges, so no task sees the whole
histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinsewell.functions.names import col

from .bpe import lengths
from .tables import keep

RANGE = 1024  # lengths of one range


def length_histogram(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many rows have that many tokens. Null and empty texts have none; an empty
    table gives no rows."""
    return lengths(docs.select(col(text).alias("text")), ranks, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram:

    docs_at_least, tokens_at_least: documents of L tokens or more, and their tokens;
    docs_below, tokens_below: the others;
    truncated_tokens: all tokens that are left if every document is cut to L;
    quantile: the share of documents of at most L tokens, so that a quantile q is the least L with
    quantile >= q;
    tokens_total.
    """
    part = F.floor(F.col("n_tokens") / RANGE).alias("part")
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens"))
    histogram = keep(histogram)  # small, and read twice
    ranges = histogram.groupBy(part).agg(F.sum("n_docs").alias("docs"), tokens.alias("tokens"))
    # A row per RANGE lengths: as many as the longest document has thousands of tokens.
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select(
        "part",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(every).alias("docs_total"),
        F.sum("tokens").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).join(ranges, "part")
    rows = rows.withColumns(
        {
            "docs_at_least": F.col("docs_above") + F.sum("n_docs").over(within),
            "tokens_at_least": F.col("tokens_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within),
        }
    )
    below = F.col("docs_total") - F.col("docs_at_least")
    tokens_below = F.col("tokens_total") - F.col("tokens_at_least")
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        below.alias("docs_below"),
        tokens_below.alias("tokens_below"),
        (tokens_below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((below + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        "tokens_total",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, tokens_total, truncated_tokens, docs_cut for limits that need not occur as lengths.

    The documents above a limit are those of the next length that occurs; beyond the longest there are none.
    An empty histogram gives zeros.
    """
    limits = sorted(set(limits))
    facts = F.struct("n_tokens", "docs_at_least", "tokens_below")
    answers = [
        F.struct(F.lit(n).cast("long").alias("limit"), F.min(F.when(F.col("n_tokens") > n, facts)).alias("next"))
        for n in limits
    ]
    total = F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens_total")
    rows = sums.agg(total, F.array(*answers).alias("answers")).select("tokens_total", F.explode("answers").alias("a"))
    kept = F.col("a.next.tokens_below") + F.col("a.next.docs_at_least") * F.col("a.limit")
    return rows.select(
        F.col("a.limit").alias("context_limit"),
        "tokens_total",
        F.coalesce(kept, F.col("tokens_total")).alias("truncated_tokens"),
        F.coalesce(F.col("a.next.docs_at_least"), F.lit(0)).alias("docs_cut"),
    )
