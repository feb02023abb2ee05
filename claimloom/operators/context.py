"""The text a predictor sees, and reports about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.text import first_lines, strip


def full_context(mail: Column, tables: Column, sheets: Column) -> Column:
    """Cleaned mail, tables and sheets under their headings."""
    return strip(
        F.concat(
            F.coalesce(mail, F.lit("")),
            F.lit("\n\n=== EXTRACTED TABLES ===\n"),
            F.coalesce(tables, F.lit("")),
            F.lit("\n\n=== EXTRACTED XLSX ===\n"),
            F.coalesce(sheets, F.lit("")),
        )
    )


def context_chars(mail: Column, table_chars: Column, sheets_chars: Column) -> Column:
    """Length of ``full_context``, given only the lengths of the tables and of the sheets less trailing blanks."""
    nothing = F.lit("")
    # A bar in place of the sheets keeps the heading before it whole.
    headed = F.length(full_context(mail, nothing, F.lit("|"))).cast("bigint") - 1
    bare = F.length(full_context(mail, nothing, nothing)).cast("bigint")
    sheets = F.coalesce(sheets_chars, F.lit(0))
    return F.coalesce(table_chars, F.lit(0)) + F.when(sheets > 0, headed + sheets).otherwise(bare)


def or_placeholder(text: Column, placeholder: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(placeholder))


def model_inputs(mail: Column, tables: Column, sheets: Column) -> list[Column]:
    """The three inputs of a prediction: whole mail, and the first lines of the rest."""
    limit, suffix = fixed.CONTEXT_LINES, fixed.CONTEXT_SUFFIX
    return [
        F.coalesce(mail, F.lit("")).alias("email_text"),
        first_lines(or_placeholder(tables, fixed.NO_TABLE_DATA), limit, suffix).alias("table_data"),
        first_lines(or_placeholder(sheets, fixed.NO_XLSX_DATA), limit, suffix).alias("xlsx_data"),
    ]


def evaluation_inputs(mail: Column, tables: Column, sheets: Column) -> list[Column]:
    """The inputs of a labelled example; a missing table or sheet gets its placeholder.

    An empty table or sheet stays empty here, unlike in ``model_inputs``.
    """
    lines, suffix = fixed.EVALUATION_LINES, fixed.EVALUATION_SUFFIX
    tables = F.coalesce(tables, F.lit(fixed.NO_TABLE_DATA))
    sheets = F.coalesce(sheets, F.lit(fixed.NO_XLSX_DATA))
    return [
        first_lines(mail, lines["email_text"], suffix).alias("email_text"),
        first_lines(tables, lines["table_data"], suffix).alias("table_data"),
        first_lines(sheets, lines["xlsx_data"], suffix).alias("xlsx_data"),
    ]


def input_sizes(inputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters of each input."""
    return inputs.select(
        key,
        *[
            F.length(c).cast("bigint").alias(f"{c}_chars")
            for c in ("email_text", "table_data", "xlsx_data")
        ],
    )


def demonstration_profile(demos: DataFrame, text: str = "email_text") -> DataFrame:
    """Number and input size of the demonstrations, and whether there are any: one row."""
    return demos.agg(
        F.count("*").alias("num_demos"),
        F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0)).alias("input_chars"),
        (F.count("*") > 0).alias("few_shot"),
    )


def previews(inputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The beginning of each input for reports, and whether it was cut."""
    columns = [F.col(key)]
    for name, chars in fixed.PREVIEW_CHARS.items():
        columns += [
            F.left(name, F.lit(chars)).alias(f"{name}_preview"),
            (F.length(name) > chars).alias(f"{name}_cut"),
        ]
    return inputs.select(*columns)


def demonstration_previews(demos: DataFrame) -> DataFrame:
    """The beginning of each demonstration for reports; missing values read "N/A"."""
    missing = F.lit("N/A")
    return demos.select(
        F.left(F.coalesce("email_text", missing), F.lit(fixed.DEMO_INPUT_PREVIEW)).alias("email_text"),
        F.left(F.coalesce("reasoning", missing), F.lit(fixed.DEMO_REASONING_PREVIEW)).alias("reasoning"),
        F.coalesce("scheme_type", missing).alias("scheme_type"),
        F.coalesce("scheme_subtype", missing).alias("scheme_subtype"),
    )


def first_rows(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each key for reports.

    The rank is limited within each partition before the shuffle, so a hot key moves no
    more rows than any other.
    """
    rank = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit)


def removal_report(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first ten removed paragraphs of each document, over ``clean.with_paragraphs``."""
    removed = F.filter(
        F.col("paragraphs"), lambda p: p["class"].isin("header", "footer", "disclaimer")
    )
    return paragraphs.select(key, F.posexplode(F.slice(removed, 1, fixed.REPORTED_REMOVALS))).select(
        key,
        (F.col("pos") + 1).cast("bigint").alias("item_no"),
        F.left(F.col("col.class"), F.lit(20)).alias("category"),
        F.left(F.col("col.text"), F.lit(60)).alias("text_preview"),
    )
