"""Tokens, cost, and the metrics of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.numbers import rounded
from claimloom.functions.text import tokens


def message_usage(messages: DataFrame) -> DataFrame:
    """Tokens of each call from messages(conv_id, turn, role, text).

    The last assistant message is the output, all else is input.  Both are sums and maxima,
    so a call with very many messages is added up before the shuffle.
    """
    chars = F.coalesce(F.length("text").cast("bigint"), F.lit(0))
    assistant = F.col("role") == "assistant"
    totals = messages.groupBy("conv_id").agg(
        F.sum(chars).alias("total_chars"),
        F.coalesce(F.max_by(F.when(assistant, chars), F.when(assistant, F.col("turn"))), F.lit(0)).alias("output_chars"),
    )
    given = F.col("total_chars") - F.col("output_chars")
    return totals.select(
        "conv_id",
        tokens(given).alias("input_tokens"),
        tokens(F.col("output_chars")).alias("output_tokens"),
        "total_chars",
        given.alias("input_chars"),
        "output_chars",
    )


def with_prices(df: DataFrame, model: str = "model", prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``in_price`` and ``out_price`` per million tokens.

    Exact name first, then the name without provider prefixes, then the first listed model
    the name contains, then the default.  The list is short and fixed, so this is one
    expression and not a join.
    """
    prices = prices or fixed.PRICES
    name = F.col(model)
    short = name
    for prefix in fixed.PRICED_PREFIXES:
        short = F.replace(short, F.lit(prefix), F.lit(""))
    listed = list(prices)
    priced = F.when(name.isin(listed), name).when(short.isin(listed), short)
    for key in listed:
        priced = priced.when(F.contains(name, F.lit(key)), F.lit(key))
    priced = priced.otherwise(fixed.DEFAULT_PRICED_MODEL)

    def price(position: int) -> Column:
        table = F.create_map(*[F.lit(x) for key in listed for x in (key, float(prices[key][position]))])
        return F.element_at(table, F.col("priced_as"))

    return df.withColumn("priced_as", priced).withColumns({"in_price": price(0), "out_price": price(1)})


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Cost under the prices of ``with_prices``."""
    return input_tokens / F.lit(1e6) * F.col("in_price") + output_tokens / F.lit(1e6) * F.col("out_price")


def with_cost(df: DataFrame, model: str = "model") -> DataFrame:
    """Add ``total_tokens`` and ``cost`` to rows with model, input_tokens and output_tokens."""
    return (
        with_prices(df, model)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens")))
        .drop("priced_as", "in_price", "out_price")
    )


def measured_or_estimated(df: DataFrame, prompt_chars: str, response_chars: str) -> DataFrame:
    """Fill input_tokens and output_tokens from text lengths where no input was measured.

    Lengths, and not the texts, are what has to be brought together for this.
    """
    measured = F.coalesce(F.col("input_tokens"), F.lit(0)) > 0

    def estimate(chars: str) -> Column:
        return tokens(F.coalesce(F.col(chars).cast("bigint"), F.lit(0)))

    return df.withColumn("_measured", measured).withColumns(
        {
            "input_tokens": F.when(F.col("_measured"), F.col("input_tokens")).otherwise(estimate(prompt_chars)),
            "output_tokens": F.when(F.col("_measured"), F.col("output_tokens")).otherwise(estimate(response_chars)),
        }
    ).drop("_measured")


def batch_totals(file_metrics: DataFrame, model: str | None = None) -> DataFrame:
    """One row over file_metrics(doc_id, status, input_tokens, output_tokens, cost).

    Failed files count as failed and add nothing else; a file stopped before prediction is
    successful and has no tokens.  Averages are over successful files, or one if none is.
    """
    done = F.col("status") != "failed"
    spent = F.coalesce("cost", F.lit(0.0))

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(F.when(done, column)), F.lit(0))

    totals = file_metrics.agg(
        F.count("*").alias("total_files"),
        F.count_if(done).alias("successful"),
        F.count_if(~done).alias("failed"),
        total(F.coalesce("input_tokens", F.lit(0))).alias("total_input_tokens"),
        total(F.coalesce("output_tokens", F.lit(0))).alias("total_output_tokens"),
        F.coalesce(F.sum(F.when(done, spent)), F.lit(0.0)).alias("_cost"),
    )
    tokens_all = F.col("total_input_tokens") + F.col("total_output_tokens")
    files = F.greatest("successful", F.lit(1))
    return totals.select(
        "total_files",
        "successful",
        "failed",
        "total_input_tokens",
        "total_output_tokens",
        tokens_all.alias("total_tokens"),
        rounded(F.col("_cost"), 4).alias("total_cost_usd"),
        rounded(tokens_all / files, 2).alias("average_tokens_per_file"),
        rounded(F.col("_cost") / files, 4).alias("average_cost_per_file"),
        *([F.lit(model).alias("model")] if model else []),
    )


def stage_summary(stage_log: DataFrame, digits: int = 1) -> DataFrame:
    """Last duration of each stage and its share of the document's total.

    stage_log(doc_id, stage, ts, duration) -> (doc_id, stage, duration, percent).  The
    window runs over one row per stage, after the log has been reduced to that.
    """
    last = stage_log.groupBy("doc_id", "stage").agg(F.max_by("duration", "ts").alias("duration"))
    total = F.sum("duration").over(W.partitionBy("doc_id"))
    return last.select(
        "doc_id",
        "stage",
        "duration",
        F.when(total > 0, rounded(F.col("duration") / total * 100, digits)).otherwise(F.lit(0.0)).alias("percent"),
    )
