"""Page layout: exclusion zones, page text, document text and its fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.assemble import CELL_CHARS, FAILED, OVERSIZED, WHOLE, assemble, joined_parts, split_by_size, without_text
from claimloom.functions.text import strip
from claimloom.session import durable


def zones(table_boxes: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Areas whose text is left out: table boxes, and a band at the head and foot of a page.

    table_boxes(doc_id, page, x0, top, x1, bottom), page_sizes(doc_id, page, width, height).
    """
    nothing, band = F.lit(0.0), F.lit(float(fixed.PAGE_BAND))
    box = ["doc_id", "page", "x0", "top", "x1", "bottom"]
    header = page_sizes.select(
        "doc_id", "page",
        nothing.alias("x0"), nothing.alias("top"), F.col("width").alias("x1"), band.alias("bottom"),
    )
    footer = page_sizes.select(
        "doc_id", "page",
        nothing.alias("x0"), (F.col("height") - band).alias("top"),
        F.col("width").alias("x1"), F.col("height").alias("bottom"),
    )
    return table_boxes.select(*box).unionByName(header).unionByName(footer)


def outside_zones(elements: DataFrame, zone_table: DataFrame) -> DataFrame:
    """Elements whose top left corner lies in no zone of their page, edges included.

    Only characters, lines and rectangles are ever left out.  The page keys make it a hash
    or merge join; equal zones are compared once, and a page with very many elements is a
    skewed left side, which adaptive execution splits.
    """
    x = F.coalesce(F.col("e.x0"), F.lit(0.0))
    if "y0" in elements.columns:
        y = F.coalesce(F.col("e.top"), F.col("e.y0"), F.lit(0.0))
    else:
        y = F.coalesce(F.col("e.top"), F.lit(0.0))
    inside = (
        (F.col("e.doc_id") == F.col("z.doc_id"))
        & (F.col("e.page") == F.col("z.page"))
        & F.col("e.object_type").isin(fixed.ZONED_OBJECT_TYPES)
        & x.between(F.col("z.x0"), F.col("z.x1"))
        & y.between(F.col("z.top"), F.col("z.bottom"))
    )
    distinct_zones = zone_table.select("doc_id", "page", "x0", "top", "x1", "bottom").distinct()
    return elements.alias("e").join(distinct_zones.alias("z"), inside, "left_anti")


def page_texts(elements: DataFrame, zone_table: DataFrame | None = None, max_chars: int = CELL_CHARS) -> DataFrame:
    """Text of each page in the order of its elements: pages(doc_id, page, text, n_chars).

    With ``zone_table`` the elements in its zones are left out.  Pages are sized before
    that, on the plain elements, so one too large to gather does not reach the join; its
    text is NULL, its ``n_chars`` tells ``documents`` so, and ``outside_zones`` lists its elements.
    """
    keys = ["doc_id", "page"]
    spoken = elements.where(F.col("text").isNotNull())
    fitting, oversized = split_by_size(spoken, keys, "text", max_chars)
    kept = fitting if zone_table is None else outside_zones(fitting, zone_table)
    return (
        joined_parts(kept, keys, ["seq"], "text", " ")
        .unionByName(without_text(oversized, keys))
        .select("doc_id", "page", "text", "n_chars")
    )


def _marked(pages: DataFrame, marker: str, filled: Column) -> DataFrame:
    head = F.concat(F.lit("\n--- Page "), F.col("page").cast("string"), F.lit(f"{marker} ---\n"))
    # A stored length sizes the documents without reading their text a second time.
    length = F.col("n_chars") if "n_chars" in pages.columns else F.length("text")
    return pages.where(filled).select(
        "doc_id",
        "page",
        F.concat(head, F.lit("\n"), F.col("text")).alias("part"),
        (length + F.length(head) + 1).alias("part_chars"),
    )


def documents(
    pages: DataFrame, page_counts: DataFrame | None = None, ocr: bool = False, max_chars: int = CELL_CHARS
) -> DataFrame:
    """Join page texts under their markers: docs(doc_id, raw_text, num_pages, text_state).

    A document whose text does not fit one cell is ``oversized``, with NULL text; all others are
    ``whole``, also with empty text.  Empty pages have no text but count.  Recognised text counts as empty when blank.
    ``pages`` may bring the length of its texts as ``n_chars``.
    ``page_counts(doc_id, num_pages)`` adds documents and pages that yielded no row.
    """
    if ocr:
        filled = strip(F.coalesce(F.col("text"), F.lit(""))) != ""
    else:
        filled = F.col("n_chars") > 0 if "n_chars" in pages.columns else F.coalesce(F.col("text"), F.lit("")) != ""
    parts = _marked(pages, " (OCR)" if ocr else "", filled)
    joined = assemble(parts, ["doc_id"], ["page"], "part", "\n", max_chars, "part_chars")
    counts = page_counts
    if counts is None:
        counts = pages.groupBy("doc_id").agg(F.count("*").alias("num_pages"))
    return counts.join(joined, "doc_id", "left").select(
        "doc_id",
        # No part at all is an empty text.
        F.when(F.col("n_parts").isNull(), "").otherwise(F.col("text")).alias("raw_text"),
        F.col("num_pages").cast("bigint").alias("num_pages"),
        F.coalesce("text_state", F.lit(WHOLE)).alias("text_state"),
    )


def with_fallback(primary: DataFrame, recognised: DataFrame) -> DataFrame:
    """Choose between extracted and recognised text, each docs(doc_id, raw_text, num_pages[, text_state]).

    A NULL or absent text is a failed extraction, unless its state is ``oversized``.  Extracted
    text of more than 100 characters is kept; else recognised text wins even if it is shorter,
    unless it failed.  An oversized text is long enough and never replaced.  ``text_state`` tells
    what became of the chosen text, and ``error`` why there is none.
    """

    def state(side: str, table: DataFrame) -> Column:
        plain = F.when(F.col(f"{side}.raw_text").isNotNull(), WHOLE).otherwise(FAILED)
        if "text_state" not in table.columns:
            return plain
        return F.when(F.col(f"{side}.text_state") == OVERSIZED, OVERSIZED).otherwise(plain)

    p, r = F.col("p.raw_text"), F.col("r.raw_text")
    p_state, r_state = state("p", primary), state("r", recognised)
    enough = (F.length(strip(p)) > fixed.MINIMUM_TEXT) | (p_state == OVERSIZED)
    use_primary = F.coalesce(enough, F.lit(False)) | (r_state == FAILED)
    chosen = F.when(use_primary, p_state).otherwise(r_state)
    return (
        primary.alias("p")
        .join(recognised.alias("r"), "doc_id", "full_outer")
        .select(
            "doc_id",
            F.when(use_primary, p).otherwise(r).alias("raw_text"),
            F.when(use_primary, F.col("p.num_pages")).otherwise(F.col("r.num_pages")).alias("num_pages"),
            chosen.alias("text_state"),
            F.when(chosen == FAILED, F.lit("All extraction methods failed")).when(chosen == OVERSIZED, F.lit(fixed.OVERSIZED_TEXT)).alias("error"),
        )
    )


def extracted(
    elements: DataFrame, zone_table: DataFrame, page_counts: DataFrame, recognised_pages: DataFrame, max_chars: int = CELL_CHARS
) -> DataFrame:
    """Documents from page elements: docs(doc_id, raw_text, num_pages, text_state, error), as a batch wants them.

    ``page_counts(doc_id, num_pages)`` names the documents that could be opened; the others, and
    those with little text, get their recognised pages ``(doc_id, page, text)``.
    """
    # Sizes, oversized documents and texts would each assemble the pages again; written down, the first two read lengths only.
    pages = durable(page_texts(elements, zone_table, max_chars))
    primary = documents(pages, page_counts, max_chars=max_chars)
    return with_fallback(primary, documents(recognised_pages, ocr=True, max_chars=max_chars))
