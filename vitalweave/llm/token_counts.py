"""Exact length histogram of a corpus: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalweave.functions.groups import running_total

#: Lengths of a bucket of the running sums.
BUCKET = 256


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs: n_tokens and n_docs. Null lengths count as 0."""
    value = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long"))
    return lengths.select(value.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each occurring length as the context limit, exact figures over all documents.

    docs_up_to and tokens_up_to: documents of no more tokens and their tokens;
    docs_over: documents cut at that limit; truncated_tokens: all tokens when each
    document is cut there; quantile: the share of documents that fit. A limit between two
    lengths a < L has the documents of a, and truncated_tokens(a) + (L - a) * docs_over(a).

    Only the histogram is shuffled. Sums run inside buckets of lengths, each of which
    starts with the totals of the buckets before it. An empty table has no rows.
    """
    one = histogram.withColumn("_all", F.lit(1)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    order, slot = [F.col("n_tokens")], F.floor(F.col("n_tokens") / bucket)
    docs = running_total(one, ["_all"], order, F.col("n_docs"), slot, "docs_up_to")
    both = running_total(docs, ["_all"], order, F.col("_tokens"), slot, "tokens_up_to")
    joined = both.withColumn("_docs", one.agg(F.sum("n_docs")).scalar())
    over = F.col("_docs") - F.col("docs_up_to")
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        over.alias("docs_over"),
        (F.col("tokens_up_to") + over * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("docs_up_to") / F.col("_docs")).alias("quantile"),
    )


def figures_at(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """docs_up_to, tokens_up_to, docs_over and truncated_tokens at each of a short list of context limits.

    A limit that no length reaches or passes gives zeros; an empty histogram gives no rows.
    """
    asked = histogram.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])))
    fits = F.col("n_tokens") <= F.col("limit")
    nothing = F.lit(0).cast("long")
    return asked.groupBy("limit").agg(
        F.sum(F.when(fits, F.col("n_docs")).otherwise(nothing)).alias("docs_up_to"),
        F.sum(F.when(fits, F.col("n_docs") * F.col("n_tokens")).otherwise(nothing)).alias("tokens_up_to"),
        F.sum(F.when(fits, nothing).otherwise(F.col("n_docs"))).alias("docs_over"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("truncated_tokens"),
    )
