"""Unicode clean-up of raw text."""

from __future__ import annotations

import functools
import itertools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL_OR_INVISIBLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B-\u200D\uFEFF\u00AD]"
LINE_SEPARATORS = r"[\u2028\u2029]"


@F.arrow_udf(T.StringType())
def _compatibility_form(text: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves composed letters apart, so it is no help here.
    return pa.array(
        [t and unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string()
    )


def _may_change(limit: int) -> set[int]:
    """Code points below a limit that NFKC replaces, reorders, or joins to the character before."""
    found = set()
    for code in range(limit):
        char = chr(code)
        if unicodedata.combining(char) or not unicodedata.is_normalized("NFKC", char):
            found.add(code)
    return found


#: Beyond this, texts are normalised without a closer look: the look costs more than NFKC.
_LOOKED_AT = 0x180


@functools.cache
def foreign_pattern() -> str:
    """A character that NFKC may change, or one beyond the accented Latin letters.

    The class is kept short, since a pattern of all that NFKC leaves alone (thousands of runs) takes
    longer than NFKC itself.  Combining marks are beyond it, so an accent never goes unseen.
    """
    changing = sorted(_may_change(_LOOKED_AT) | {_LOOKED_AT})
    runs = [(a + 1, b - 1) for a, b in itertools.pairwise([-1, *changing]) if b > a + 1]
    kept = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)
    # NFKC leaves ASCII alone; said first, since going through all runs for each letter takes longest.
    return rf"[\x{{80}}-\x{{10FFFF}}&&[^{kept}]]"


def normalise(text: Column) -> Column:
    """NFKC, then no control or invisible characters, and one kind of line break.

    Spark has no built-in for NFKC.  ASCII text is already normal, and so is text with accented
    Latin letters and signs that NFKC leaves alone; such rows send NULL to the Arrow function and
    keep their own text.  All other texts go through it.  NFKC turns
    U+00A0 into a space and U+2011 into U+2010, so nothing is left to replace for them.
    """
    beyond_ascii = F.octet_length(text) != F.char_length(text)
    foreign = F.when(beyond_ascii & text.rlike(foreign_pattern()), text)
    normal = F.coalesce(_compatibility_form(foreign), text)
    visible = F.regexp_replace(normal, CONTROL_OR_INVISIBLE, "")
    return F.when(beyond_ascii, F.regexp_replace(visible, LINE_SEPARATORS, "\n")).otherwise(visible)
