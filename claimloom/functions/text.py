"""Text expressions with Python string semantics, built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.fixed_values import EMAIL_ADDRESS

# The characters Python treats as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Java's Unicode \s leaves out the four separators that Python includes.
SPACE_CLASS = r"[\s\x1c-\x1f]"
BLANK_LINE = rf"(?U)\n{SPACE_CLASS}*\n"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def cased(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, and "." stops only at a line feed."""
    return "(?dU)" + pattern


def uncased(pattern: str) -> str:
    """As ``cased``, ignoring case."""
    return "(?idU)" + pattern


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Lower case without any white space: the key of the exact lookups."""
    return F.lower(F.regexp_replace(text, rf"(?U){SPACE_CLASS}+", ""))


def contains_any(text: Column, words: list[str]) -> Column:
    """Substring test for a short fixed list."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def has_email(text: Column) -> Column:
    # One character before the sign is enough to know, and keeps the search linear.
    return F.contains(text, F.lit("@")) & text.rlike(uncased(EMAIL_ADDRESS.replace("+@", "@", 1)))


def without_emails(text: Column) -> Column:
    # A match can only start where a run of address characters starts or where the match
    # before it ended; saying so keeps long runs without the sign linear.
    local = "[a-z0-9._%+-]"
    pattern = rf"(?:\G|(?<!{local})){EMAIL_ADDRESS.replace('+@', '++@', 1)}"
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, uncased(pattern), "")).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Non-empty stripped parts between blank lines."""
    return F.filter(F.transform(F.split(text, BLANK_LINE), strip), lambda p: p != "")


def filled_lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def first_lines(text: Column, limit: int, suffix: str) -> Column:
    """Keep ``limit`` lines and append ``suffix`` if there are more.

    Lines end as in Python's ``splitlines``: many kinds of break, and a final break opens
    no further line.  Only the lines that are kept are split off.
    """
    return let(
        F.split(text, LINE_BREAK, limit + 1),
        lambda parts: F.when(
            (F.size(parts) > limit) & (F.element_at(parts, -1) != ""),
            F.concat(F.array_join(F.slice(parts, 1, limit), "\n"), F.lit("\n" + suffix)),
        ).otherwise(text),
    )


def tokens(chars: Column) -> Column:
    """Token estimate: four characters to one token, rounded down."""
    return F.floor(chars / F.lit(4)).cast("bigint")
