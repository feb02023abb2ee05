"""Ordered text assembly from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One cell of text.  Far above any document, and well inside what a row can hold.
CELL_CHARS = 64 * 1024 * 1024

# What has become of a text, beside it: a NULL text alone does not say.
WHOLE, OVERSIZED, FAILED = "whole", "oversized", "failed"


def split_by_size(
    parts: DataFrame,
    keys: list[str],
    text: str,
    max_chars: int = CELL_CHARS,
    chars: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Parts of the keys whose text fits one cell, and the keys that are too large.

    Returns (fitting parts, oversized(keys, n_parts, n_chars)).  The sizes are counts added
    up before the shuffle, so a hot key is found without being gathered.  There can be no
    more oversized keys than total size / ``max_chars``: that bounds the broadcast.
    ``chars`` names a column with the length of the text, which spares reading the text.
    """
    length = F.length(text) if chars is None else F.col(chars)
    size = F.coalesce(length.cast("bigint"), F.lit(0)) + F.lit(1)
    oversized = (
        # Said outright, so that both uses of the sizes share one shuffle.
        parts.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("n_parts"), F.sum(size).alias("n_chars"))
        .where(F.col("n_chars") > max_chars)
    )
    return parts.join(F.broadcast(oversized.select(*keys)), keys, "left_anti"), oversized


def assemble(
    parts: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    separator: str,
    max_chars: int = CELL_CHARS,
    chars: str | None = None,
) -> DataFrame:
    """Join the parts of each key in order: keys, ``text``, ``n_parts``, ``n_chars``, ``text_state``.

    A key whose text would not fit one cell is not gathered: it is ``oversized`` with NULL text
    here, and ``parts`` still holds it whole, row by row.
    """
    fitting, oversized = split_by_size(parts, keys, text, max_chars, chars)
    return joined_parts(fitting, keys, order, text, separator).unionByName(without_text(oversized, keys))


def joined_parts(fitting: DataFrame, keys: list[str], order: list[str], text: str, separator: str) -> DataFrame:
    """``assemble`` for parts known to fit."""
    return (
        fitting.groupBy(*keys)
        .agg(
            F.count("*").alias("n_parts"),
            F.sort_array(F.collect_list(F.struct(*order, text))).alias("_parts"),
        )
        .select(
            *keys,
            F.array_join(F.transform("_parts", lambda p: p[text]), separator).alias("text"),
            "n_parts",
        )
        .withColumns({"n_chars": F.length("text").cast("bigint"), "text_state": F.lit(WHOLE)})
    )


def without_text(oversized: DataFrame, keys: list[str]) -> DataFrame:
    return oversized.select(
        *keys, F.lit(None).cast("string").alias("text"), "n_parts", "n_chars", F.lit(OVERSIZED).alias("text_state")
    )
