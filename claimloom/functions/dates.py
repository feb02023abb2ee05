"""Date spellings to DD/MM/YYYY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import let, strip

# Shape of the text -> format to read it with.
FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]
SHORT_MONTH_FIRST = (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy")
ANY_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"


def standard_date(text: Column, none_words: list[str], none_value: str, short_month_first: bool = True) -> Column:
    """DD/MM/YYYY where a date can be read, ``none_value`` for none, else the text itself.

    A text already shaped DD/MM/YYYY is kept even if there is no such day, and the last
    resort takes the first d/m/yyyy in the text without a range check.
    """
    formats = FORMATS + ([SHORT_MONTH_FIRST] if short_month_first else [])

    def read(value: Column) -> Column:
        spaced = F.regexp_replace(value, r"\s+", " ")
        # The shape is tested first: a format tried in vain costs an exception per row.
        parsed = F.coalesce(
            *[F.when(spaced.rlike(shape), F.try_to_timestamp(spaced, F.lit(fmt))) for shape, fmt in formats]
        )
        day, month, year = (F.regexp_extract(value, ANY_DATE, i) for i in (1, 2, 3))
        found = F.when(
            value.rlike(ANY_DATE),
            F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year),
        )
        return F.when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), value).otherwise(
            F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), found, value)
        )

    missing = text.isNull() | (text == "") | F.lower(text).isin(none_words)
    return F.when(missing, F.lit(none_value)).otherwise(let(strip(text), read))
