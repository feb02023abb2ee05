"""Mail cleaning: block removal, paragraph classes, cleaned text and its statistics.

Everything works inside the row, so cleaning needs no shuffle and runs on streams too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.normalise import normalise
from claimloom.functions.numbers import rounded
from claimloom.functions.text import (
    SPACE_CLASS,
    any_of,
    cased,
    contains_any,
    filled_lines,
    has_email,
    let,
    paragraphs,
    strip,
    uncased,
    without_emails,
)

# Protected patterns that begin with digits, and a form that finds a match in exactly the
# same texts without trying every split of a long run of digits.
DIGIT_FORMS = {
    r"\d+\s*(units?|pieces?|kgs?|grams?|litres?|tons?)": r"\d\s*(unit|piece|kg|gram|litre|ton)",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}": r"\d[/-]\d{1,2}[/-]\d{2}",
    r"\d{1,2}:\d{2}\s*(?:AM|PM)": r"\d:\d{2}\s*(?:AM|PM)",
    r"\d+\.?\d*\s*%": r"\d\.?\s*%",
}
if not DIGIT_FORMS.keys() <= set(fixed.PROTECTED_PATTERNS):
    raise ValueError("a digit form belongs to no protected pattern")


def _is_word(pattern: str) -> bool:
    return pattern.startswith(r"\b") and pattern.endswith(r"\b")


def word_search(patterns: list[str]) -> str:
    """One pattern for many ``\\b(one|two)\\b``, branching on the first letter.

    Java tries alternatives one by one; this leaves a handful for each word.
    """
    by_letter: dict[str, list[str]] = {}
    for pattern in patterns:
        body = pattern[2:-2]
        for word in body[1:-1].split("|") if body.startswith("(") else [body]:
            by_letter.setdefault(word[0], []).append(word[1:])
    branches = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    # The letter is tested before the boundary, which costs more and fails less often.
    return rf"(?=[{''.join(by_letter)}])\b(?:{branches})\b"


PROTECTED_WORDS = cased(word_search([p for p in fixed.PROTECTED_PATTERNS if _is_word(p)]))
# Every other protected pattern needs a digit.
PROTECTED_NUMBERS = cased(any_of([DIGIT_FORMS.get(p, p) for p in fixed.PROTECTED_PATTERNS if not _is_word(p)]))

# Forms of other patterns that find a match in exactly the same texts in linear time.  Each
# rests on one remark: where the first occurrence of a beginning does not lead to the end
# that is wanted, no later one does, so a search may settle on the first for good.
_LOCAL = "[a-z0-9._%+-]"
_MAIL_LINK, _QUOTED, _PAGE_COUNT, _UNSUBSCRIBE, _PREFERENCES = fixed.FOOTER_PATTERNS
_HEADER_LINE, _, _, _, _, _STAMP = fixed.HEADER_PATTERNS
_FORWARDED = r"-\s*Forwarded message\s*-"
# The "on" may stand before the "wrote" in its line, or end a line above.
_WROTE = r"(?m:^)(?>.*?On[^\S\n]).*wrote\s*:|On[^\S\n]*+\n\s*+.*wrote\s*:"
# One attempt for each run of address characters: at its start, if that is a word boundary,
# or else if a boundary lies within.  Of the ends an address may have, the first is best.
_ADDRESS_TIME = (
    rf"^(?>.*?(?<!{_LOCAL})(?:\b{_LOCAL}++|[a-z0-9_]++[.%+-]{_LOCAL}*+|[.%+-]++[a-z0-9_]{_LOCAL}*+)"
    r"@[a-z0-9.-]+?\.[a-z]{2,}?\b).*?(?:AM|PM|at|on)"
)
_BRACKETED = rf"""^\s*(?:["']?[\w\s.-]++["']?\s*)?<{_LOCAL}++@[a-z0-9.-]+\.[a-z]{{2,}}>"""
_ON_BEHALF = r"(?m:^)(?>.*?on behalf of the ).* group"
_PHRASES = [p for p in fixed.BOILERPLATE_PATTERNS if ".*" not in p]

TABLE, PROTECTED_TEXT, HEADER, FOOTER_TEXT, DISCLAIMER, BODY = (
    "table", "protected", "header", "footer", "disclaimer", "body",
)


# --- blocks of address lines ----------------------------------------------------------


def _drop_blocks(lines: Column, start: str, continues) -> Column:
    """Remove each line that starts a block and the continuations that follow it.

    A line is dropped if the nearest line at or before it that is not a continuation is a
    start.  The classes of all lines form one string, in which a single pattern marks the
    dropped ones, so the work stays linear in the number of lines.
    Returns struct<lines, starts>.
    """

    def classify(line: Column) -> Column:
        return let(
            strip(line),
            lambda s: F.when(s.rlike(uncased(start)), "H").when(continues(s), "C").otherwise("N"),
        )

    classes = F.array_join(F.transform(lines, classify), "")

    def keep(letters: Column) -> Column:
        marks = F.split(F.regexp_replace(letters, r"H|(?!^)\GC", "_"), "")
        kept = F.array_compact(F.zip_with(lines, marks, lambda line, m: F.when(m != "_", line)))
        starts = F.length(letters) - F.length(F.replace(letters, F.lit("H"), F.lit("")))
        return F.struct(kept.alias("lines"), starts.cast("bigint").alias("starts"))

    return let(classes, keep)


def _blocks_removed(text: Column, start: str, continues) -> Column:
    """struct<text, starts>; text without such a line is not taken apart."""
    space = rf"[{SPACE_CLASS}&&[^\n]]*"
    present = text.rlike(r"(?imdU)^" + space + start.lstrip("^"))
    cut = let(
        F.split(text, "\n"),
        lambda lines: let(
            _drop_blocks(lines, start, continues),
            lambda r: F.struct(F.array_join(r["lines"], "\n").alias("text"), r["starts"].alias("starts")),
        ),
    )
    return F.when(present, cut).otherwise(
        F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("starts"))
    )


def without_cc_blocks(text: Column) -> Column:
    """Cc lines with their continuations removed: struct<text, starts>."""
    return _blocks_removed(
        text,
        fixed.CC_LINE,
        lambda line: F.endswith(line, F.lit(",")) | F.endswith(line, F.lit(";")) | has_email(line),
    )


def without_address_blocks(text: Column) -> Column:
    """From and To lines with their continuations removed: struct<text, starts>."""
    return _blocks_removed(
        text,
        fixed.ADDRESS_LINE,
        lambda line: F.endswith(line, F.lit(","))
        | F.endswith(line, F.lit(";"))
        | F.contains(line, F.lit("<"))
        | F.contains(line, F.lit(">"))
        | has_email(line),
    )


# --- disclaimer blocks ----------------------------------------------------------------


def _occurs(marker: str) -> str:
    """Pattern for a text with this marker, by the first occurrence of each of its parts."""
    return r"(?isU)\A" + "".join(f"(?>.*?{part})" for part in marker.split(".*?"))


def without_disclaimer_blocks(
    text: Column,
    markers: list[str] = fixed.BLOCK_MARKERS,
    endings: list[str] = fixed.BLOCK_ENDINGS,
) -> Column:
    """Cut up to ten disclaimer blocks: struct<text, blocks, more>.

    Each round takes the first marker in list order that occurs.  The block ends after the
    first ending in list order found behind the marker's start, and on to the end of that
    sentence if it is near; without an ending it reaches to the end of the text.
    """
    openings = list(dict.fromkeys(m.split(".*?")[0].lower() for m in markers))
    endings = [uncased(e) for e in endings]
    any_marker = any_of([_occurs(m) for m in markers])

    def present(body: Column) -> Column:
        return contains_any(F.lower(body), openings) & body.rlike(any_marker)

    def before(body: Column, marker: str) -> Column:
        # Only the start of a marker matters, and that is the first place its words begin.
        return F.when(body.rlike(_occurs(marker)), F.split(body, uncased(marker.split(".*?")[0]), 2)[0])

    def behind(block: Column, ending: str) -> Column:
        return let(F.split(block, ending, 2), lambda parts: F.when(F.size(parts) == 2, parts[1]))

    def past_sentence(rest: Column) -> Column:
        near = F.substring(rest, 1, fixed.SENTENCE_REACH)
        return let(
            F.length(F.regexp_extract(near, r"^[^.\n]*+[.\n]", 0)),
            lambda n: F.substring(rest, n + F.lit(1), F.length(rest)),
        )

    def cut(body: Column) -> Column:
        return let(
            F.coalesce(*[before(body, m) for m in markers]),
            lambda head: let(
                F.substring(body, F.length(head) + F.lit(1), F.length(body)),
                lambda block: F.concat(
                    head,
                    let(
                        F.coalesce(*[behind(block, e) for e in endings], F.lit("")),
                        past_sentence,
                    ),
                ),
            ),
        )

    def state(body: Column, blocks: Column, more: bool) -> Column:
        return F.struct(body.alias("text"), blocks.alias("blocks"), F.lit(more).alias("more"))

    def one_round(s: Column, _: Column) -> Column:
        return (
            F.when(~s["more"], s)
            .when(present(s["text"]), state(cut(s["text"]), s["blocks"] + F.lit(1), True))
            .otherwise(state(s["text"], s["blocks"], False))
        )

    none = F.lit(0).cast("bigint")
    rounds = F.sequence(F.lit(1), F.lit(fixed.BLOCK_ROUNDS))
    return F.when(present(text), F.aggregate(rounds, state(text, none, True), one_round)).otherwise(
        state(text, none, False)
    )


# --- paragraph tests ------------------------------------------------------------------


def is_table(paragraph: Column) -> Column:
    """Two lines with two pipes, or half of several lines aligned by spaces or tabs."""

    def test(lines: Column) -> Column:
        piped = F.size(F.filter(lines, lambda line: line.rlike(r"\|[^|]*\|")))
        aligned = F.size(
            F.filter(
                lines,
                lambda line: F.contains(line, F.lit("\t"))
                | line.rlike(cased(rf"\w{{2}}{SPACE_CLASS}{{3,}}\w{{2}}")),
            )
        )
        return (piped >= 2) | ((F.size(lines) > 1) & (aligned * 2 >= F.size(lines)))

    return F.contains(paragraph, F.lit("\n")) & let(filled_lines(paragraph), test)


def is_protected(paragraph: Column) -> Column:
    """Business words, amounts, dates or ids outside e-mail addresses."""
    return let(
        without_emails(paragraph),
        lambda p: p.rlike(PROTECTED_WORDS) | (p.rlike(r"(?U)\d") & p.rlike(PROTECTED_NUMBERS)),
    )


# The tests below look for plain words first, in lower case: that costs little, and only
# the few paragraphs that hold them go through a pattern.  Each takes the paragraph and its
# lower case, which they share.


def _header_line(line: Column) -> Column:
    return line.rlike(uncased(any_of([_HEADER_LINE, _STAMP]))) | (
        F.contains(line, F.lit("@")) & line.rlike(uncased(any_of([_ADDRESS_TIME, _BRACKETED])))
    )


def _header(paragraph: Column, low: Column) -> Column:
    thread = (F.contains(low, F.lit("forwarded message")) & paragraph.rlike(uncased(_FORWARDED))) | (
        F.contains(low, F.lit("wrote")) & low.rlike(cased(r"wrote\s*:")) & paragraph.rlike(uncased(_WROTE))
    )

    def several(lines: Column) -> Column:
        headers = F.size(F.filter(lines, _header_line))
        metadata = F.exists(lines, lambda line: line.rlike(uncased(fixed.METADATA_LINE)))
        return F.when(F.size(lines) == 1, headers == 1).otherwise(
            (F.size(lines) > 0) & ((headers * 2 >= F.size(lines)) | (metadata & (F.size(lines) < 5)))
        )

    return thread | F.when(
        F.contains(paragraph, F.lit("\n")), let(filled_lines(paragraph), several)
    ).otherwise(let(strip(paragraph), lambda line: (line != "") & _header_line(line)))


def _footer(paragraph: Column, low: Column) -> Column:
    return (
        paragraph.rlike(cased(_PAGE_COUNT))
        | contains_any(low, ["[quoted text hidden]", _UNSUBSCRIBE, _PREFERENCES])
        | (F.contains(low, F.lit("mail.google.com")) & paragraph.rlike(uncased(_MAIL_LINK)))
    )


def _words_in(low: Column) -> Column:
    words = F.array(*[F.lit(w) for w in fixed.DISCLAIMER_KEYWORDS])
    return F.filter(words, lambda w: F.contains(low, w))


def _disclaimer(paragraph: Column, low: Column) -> Column:
    return (
        (F.size(_words_in(low)) >= fixed.DISCLAIMER_KEYWORD_MINIMUM)
        | contains_any(low, _PHRASES)
        | (F.contains(low, F.lit("on behalf of the ")) & paragraph.rlike(uncased(_ON_BEHALF)))
    )


def is_header(paragraph: Column) -> Column:
    """Thread starts, or mostly mail header lines."""
    return let(F.lower(paragraph), lambda low: _header(paragraph, low))


def is_footer(paragraph: Column) -> Column:
    """Mail links, hidden quotes, page counts and subscription notes."""
    return let(F.lower(paragraph), lambda low: _footer(paragraph, low))


def is_disclaimer(paragraph: Column) -> Column:
    """Three disclaimer keywords, or one phrase that says it all."""
    return let(F.lower(paragraph), lambda low: _disclaimer(paragraph, low))


def disclaimer_words(paragraph: Column) -> Column:
    """The distinct disclaimer keywords in a paragraph, in list order."""
    return let(F.lower(paragraph), _words_in)


def paragraph_class(paragraph: Column) -> Column:
    """The class that decides a paragraph's fate; the first that applies."""

    def cleanable(low: Column) -> Column:
        return (
            F.when(_header(paragraph, low), HEADER)
            .when(_footer(paragraph, low), FOOTER_TEXT)
            .when(_disclaimer(paragraph, low), DISCLAIMER)
            .otherwise(BODY)
        )

    return (
        F.when(is_table(paragraph), TABLE)
        .when(is_protected(paragraph), PROTECTED_TEXT)
        .otherwise(let(F.lower(paragraph), cleanable))
    )


# --- whole texts ----------------------------------------------------------------------


def with_blocks_removed(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``prepared_text`` and the number of cc, address and disclaimer blocks removed."""
    return (
        # Step by step, so that no step's expression is repeated inside the next.
        df.withColumn("_normal", normalise(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_cc", without_cc_blocks(F.col("_normal")))
        .withColumn("_address", without_address_blocks(F.col("_cc.text")))
        .withColumn("_block", without_disclaimer_blocks(F.col("_address.text")))
        .withColumn("prepared_text", F.col("_block.text"))
        .withColumn("cc_blocks", F.col("_cc.starts"))
        .withColumn("address_blocks", F.col("_address.starts"))
        .withColumn("disclaimer_blocks", F.col("_block.blocks"))
        .drop("_normal", "_cc", "_address", "_block")
    )


def with_paragraphs(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``with_blocks_removed`` plus ``paragraphs``: array<struct<text, class>>."""
    return with_blocks_removed(df, text).withColumn(
        "paragraphs",
        F.transform(
            paragraphs(F.col("prepared_text")),
            lambda p: F.struct(p.alias("text"), paragraph_class(p).alias("class")),
        ),
    )


def _joined(classified: Column, *class_groups: list[str]) -> Column:
    def members(classes: list[str]) -> Column:
        return F.filter(classified, lambda p: p["class"].isin(classes))

    return F.array_join(
        F.transform(F.concat(*[members(g) for g in class_groups]), lambda p: p["text"]), "\n\n"
    )


def clean(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``with_paragraphs`` plus ``cleaned_text``: protected paragraphs first, then the rest."""
    return with_paragraphs(df, text).withColumn(
        "cleaned_text", _joined(F.col("paragraphs"), [TABLE, PROTECTED_TEXT], [BODY])
    )


def clean_headers(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Standalone cc, header and footer cleaning, in the original order, with counters."""
    return (
        df.withColumn("_cc", without_cc_blocks(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(
            "_paragraphs",
            F.transform(
                paragraphs(F.col("_cc.text")),
                lambda p: F.struct(
                    p.alias("text"),
                    F.when(is_header(p), HEADER).when(is_footer(p), FOOTER_TEXT).otherwise(BODY).alias("class"),
                ),
            ),
        )
        .withColumn("cleaned_text", _joined(F.col("_paragraphs"), [BODY]))
        .withColumn("cc_blocks_removed", F.col("_cc.starts"))
        .withColumn("headers_removed", count_class(F.col("_paragraphs"), HEADER))
        .withColumn("footers_removed", count_class(F.col("_paragraphs"), FOOTER_TEXT))
        .withColumn("paragraphs_removed", F.col("headers_removed") + F.col("footers_removed"))
        .drop("_cc", "_paragraphs")
    )


def clean_disclaimers(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Standalone disclaimer cleaning, in the original order, with counters."""
    return (
        df.withColumn(
            "_block",
            without_disclaimer_blocks(
                F.coalesce(F.col(text), F.lit("")),
                fixed.STANDALONE_BLOCK_MARKERS,
                fixed.STANDALONE_BLOCK_ENDINGS,
            ),
        )
        .withColumn(
            "_paragraphs",
            F.transform(
                paragraphs(F.col("_block.text")),
                lambda p: F.struct(
                    p.alias("text"),
                    F.when(is_disclaimer(p), DISCLAIMER).otherwise(BODY).alias("class"),
                ),
            ),
        )
        .withColumn("cleaned_text", _joined(F.col("_paragraphs"), [BODY]))
        .withColumn("disclaimer_blocks_removed", F.col("_block.blocks"))
        .withColumn("disclaimers_removed", count_class(F.col("_paragraphs"), DISCLAIMER))
        .drop("_block", "_paragraphs")
    )


# --- statistics -----------------------------------------------------------------------


def count_class(classified: Column, *classes: str) -> Column:
    return F.size(F.filter(classified, lambda p: p["class"].isin(list(classes)))).cast("bigint")


def reduction_percent(original: Column, cleaned: Column, digits: int) -> Column:
    """Share of characters removed, 0 for an empty original."""
    share = (original - cleaned) / original * F.lit(100.0)
    return F.when(original > 0, rounded(share, digits)).otherwise(F.lit(0.0))


def size_statistics(original: Column, cleaned: Column) -> list[Column]:
    """Lengths in characters, and what cleaning took away."""
    before = F.coalesce(F.length(original), F.lit(0)).cast("bigint")
    after = F.coalesce(F.length(cleaned), F.lit(0)).cast("bigint")
    return [
        before.alias("original_length"),
        after.alias("cleaned_length"),
        (before - after).alias("reduction_chars"),
        reduction_percent(before, after, 2).alias("reduction_percent"),
    ]


def audit_columns() -> list[Column]:
    """Counts over the columns of ``with_paragraphs``.

    The four totals keep their long-standing meaning, in which ``retained`` is taken before
    the disclaimer test; the counts per class are exact.
    """
    p = F.col("paragraphs")
    blocks = F.col("cc_blocks") + F.col("address_blocks") + F.col("disclaimer_blocks")
    return [
        F.col("cc_blocks"),
        F.col("address_blocks"),
        F.col("disclaimer_blocks"),
        count_class(p, HEADER).alias("header_paragraphs"),
        count_class(p, FOOTER_TEXT).alias("footer_paragraphs"),
        count_class(p, DISCLAIMER).alias("disclaimer_paragraphs"),
        count_class(p, BODY).alias("body_paragraphs"),
        (blocks + count_class(p, HEADER, FOOTER_TEXT, DISCLAIMER)).alias("removed"),
        count_class(p, TABLE, PROTECTED_TEXT, BODY, DISCLAIMER).alias("retained"),
        count_class(p, PROTECTED_TEXT).alias("protected"),
        count_class(p, TABLE).alias("tables_protected"),
    ]


def audit_counts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``audit_columns`` of each document over ``with_paragraphs``."""
    return df.select(key, *audit_columns())


def keyword_report(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per paragraph removed for its density of disclaimer keywords."""
    hits = F.posexplode(
        F.filter(
            F.transform(
                F.filter(F.col("paragraphs"), lambda p: p["class"] == DISCLAIMER),
                lambda p: F.struct(
                    F.substring(p["text"], 1, 100).alias("preview"),
                    disclaimer_words(p["text"]).alias("words"),
                ),
            ),
            lambda h: F.size(h["words"]) >= fixed.DISCLAIMER_KEYWORD_MINIMUM,
        )
    )
    return df.select(key, hits.alias("hit_no", "hit")).select(
        key,
        F.col("hit_no").cast("bigint").alias("hit_no"),
        F.col("hit.preview").alias("text_preview"),
        F.sort_array("hit.words").alias("keywords_found"),
        F.size("hit.words").cast("bigint").alias("keyword_count"),
    )
