"""Scoring predictions against labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.dates import standard_date
from claimloom.functions.text import strip

SCORED_FIELDS = (
    ["scheme_type", "scheme_subtype", "duration"]
    + fixed.STRUCTURED_FIELDS
    + fixed.SCORED_DATES
    + fixed.FREE_TEXT_FIELDS
)


# --- labels ---------------------------------------------------------------------------


def field_of_label(label: Column) -> Column:
    """The field a label spelling stands for."""
    known = F.create_map(*[F.lit(x) for pair in fixed.LABEL_KEYS.items() for x in pair])
    upper = F.upper(label)
    ruled = None
    for alternatives, field in fixed.LABEL_KEY_RULES:
        test = F.lit(False)
        for words in alternatives:
            all_words = F.lit(True)
            for word in words:
                all_words = all_words & F.contains(upper, F.lit(word))
            test = test | all_words
        ruled = F.when(test, field) if ruled is None else ruled.when(test, field)
    spelled = F.replace(F.lower(label), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(known, label), ruled.otherwise(spelled))


def mapped_labels(labels: Column) -> Column:
    """map<label, value> -> map<field, value>; of several labels for a field the last counts."""
    named = F.transform(
        F.map_entries(labels),
        lambda e: F.struct(field_of_label(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.aggregate(
        named,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda kept, e: F.concat(F.filter(kept, lambda k: k["key"] != e["key"]), F.array(e)),
    )
    return F.map_from_entries(last)


def label_columns(gold: DataFrame, labels: str = "labels") -> DataFrame:
    """Add one column per scored field from the labels.

    An absent label is NULL and compares as "".  A label that is there with a null value reads
    "None", as its text would.
    """

    def value(field: str) -> Column:
        found = F.try_element_at("_fields", F.lit(field))
        return F.when(F.map_contains_key("_fields", field), F.coalesce(found, F.lit("None"))).alias(field)

    return gold.withColumn("_fields", mapped_labels(F.col(labels))).select(*gold.columns, *[value(f) for f in SCORED_FIELDS])


# --- normalisers ----------------------------------------------------------------------


def plain(value: Column) -> Column:
    """Missing reads "", else stripped lower case."""
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def evaluation_date(value: Column) -> Column:
    return standard_date(value, fixed.NO_DATE_IN_EVALUATION, "n/a", short_month_first=False)


def _synonym(value: Column, synonyms: dict[str, list[str]]) -> Column:
    upper = F.upper(strip(value))
    picked = F
    for standard, spellings in synonyms.items():
        picked = picked.when(upper.isin(spellings), standard)
    return picked.otherwise(F.lower(upper))


def standard_type(value: Column) -> Column:
    return _synonym(value, fixed.TYPE_SYNONYMS)


def standard_subtype(value: Column) -> Column:
    return _synonym(value, fixed.SUBTYPE_SYNONYMS)


def or_not_applicable(value: Column) -> Column:
    """All spellings of "none", plain "no" among them, read "not applicable"."""
    low = F.lower(strip(value))
    return F.when(low.isin(fixed.NOT_APPLICABLE), "not applicable").otherwise(low)


def standard_duration(value: Column) -> Column:
    """Hyphens read "to", with single spaces around it."""
    low = F.replace(F.lower(strip(value)), F.lit(" - "), F.lit(" to "))
    return F.regexp_replace(F.replace(low, F.lit("-"), F.lit(" to ")), r"(?U)\s+to\s+", " to ")


def normalised(field: str, value: Column) -> Column:
    """A field's value in the form in which it is compared."""
    text = plain(value)
    if field == "scheme_type":
        return standard_type(text)
    if field == "scheme_subtype":
        return standard_subtype(text)
    if field == "duration":
        return standard_duration(text)
    if field in fixed.SCORED_DATES:
        return evaluation_date(text)
    return or_not_applicable(text)


# --- scores ---------------------------------------------------------------------------


def _column(df: DataFrame, field: str, side: str) -> Column:
    return F.col(f"{side}.{field}") if field in df.columns else F.lit(None).cast("string")


def compared(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions and labels of the same example, joined once for every report.

    -> (example_id, expected_<field>, actual_<field> ..., free text lengths); a field that
    either side lacks is missing there.
    """
    p, g = predictions.alias("p"), gold.alias("g")
    columns = [F.col("g.example_id").alias("example_id")]
    for field in SCORED_FIELDS:
        if field in fixed.FREE_TEXT_FIELDS:
            columns.append(F.length(plain(_column(predictions, field, "p"))).alias(f"length_{field}"))
        else:
            columns.append(normalised(field, _column(gold, field, "g")).alias(f"expected_{field}"))
            columns.append(normalised(field, _column(predictions, field, "p")).alias(f"actual_{field}"))
    return g.join(p, F.col("p.doc_id") == F.col("g.example_id")).select(*columns)


def _weights() -> dict[str, float]:
    weights = {"scheme_type": fixed.PAIR_WEIGHT, "scheme_subtype": fixed.PAIR_WEIGHT, "duration": fixed.DURATION_WEIGHT}
    weights.update({f: fixed.STRUCTURED_WEIGHT for f in fixed.STRUCTURED_FIELDS})
    weights.update({f: fixed.DATE_WEIGHT for f in fixed.SCORED_DATES})
    return weights


def _score() -> Column:
    points = F.lit(0.0)
    for field, weight in _weights().items():
        points = points + F.when(F.col(f"expected_{field}") == F.col(f"actual_{field}"), weight).otherwise(0.0)
    for field in fixed.FREE_TEXT_FIELDS:
        points = points + F.when(
            F.col(f"length_{field}") > fixed.FREE_TEXT_LENGTH, fixed.FREE_TEXT_WEIGHT
        ).otherwise(0.0)
    return points / fixed.TOTAL_WEIGHT


def scores(pairs: DataFrame) -> DataFrame:
    """(example_id, score): weighted share of matching fields over ``compared``."""
    return pairs.select("example_id", _score().alias("score"))


def dataset_score(example_scores: DataFrame) -> DataFrame:
    """Mean score and number of examples: one row."""
    return example_scores.agg(F.count("*").alias("examples"), F.avg("score").alias("mean_score"))


def mismatch_report(pairs: DataFrame, examples: int = fixed.REPORTED_EXAMPLES) -> DataFrame:
    """Differing fields of the first examples, with their scores.

    A perfect example has one row with NULL field.  Only as many rows as there are
    reported examples leave the top-k step.
    """
    judged = pairs.orderBy("example_id").limit(examples).withColumn("score", _score())
    differences = F.filter(
        F.array(
            *[
                F.when(
                    F.col(f"expected_{f}") != F.col(f"actual_{f}"),
                    F.struct(
                        F.lit(f).alias("field"),
                        F.col(f"expected_{f}").alias("expected"),
                        F.col(f"actual_{f}").alias("actual"),
                    ),
                )
                for f in fixed.REPORTED_FIELDS
            ]
        ),
        lambda d: d.isNotNull(),
    )
    return judged.select(
        "example_id",
        "score",
        (F.size(differences) == 0).alias("perfect_match"),
        F.explode_outer(differences).alias("d"),
    ).select("example_id", "d.field", "d.expected", "d.actual", "perfect_match", "score")
