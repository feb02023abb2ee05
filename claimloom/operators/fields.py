"""From raw predictions to corrected fields, reasoning trace and output record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.dates import standard_date
from claimloom.functions.text import any_of, contains_any, let, strip, uncased

FIELDS = list(fixed.FIELD_DEFAULTS)
SELF_EXPLAINING = [name for name, source in fixed.REASONING_OF.items() if name == source]


def normalised_date(text: Column) -> Column:
    return standard_date(text, fixed.NO_DATE, "N/A")


def with_defaults(predictions: DataFrame) -> DataFrame:
    """Fill missing fields; blank values stay blank, dates get their standard form."""

    def field(name: str) -> Column:
        value = F.coalesce(strip(F.col(name)), F.lit(fixed.FIELD_DEFAULTS[name]))
        return (normalised_date(value) if name in fixed.DATE_FIELDS else value).alias(name)

    others = [c for c in predictions.columns if c not in FIELDS]
    # Kept as predicted, since these fields are their own reasoning.
    raw = [F.col(name).alias(f"raw_{name}") for name in SELF_EXPLAINING]
    return predictions.select(*others, *[field(name) for name in FIELDS], *raw)


def with_fixed_terms(fields: DataFrame) -> DataFrame:
    """Corrections that follow from the predicted pair alone.

    Subtype PDC makes the type PDC; a periodic claim has fixed slab terms; BOC is now PUC.
    """
    periodic = (F.upper("scheme_type") == "BUY_SIDE") & (F.upper("scheme_subtype") == "PERIODIC_CLAIM")
    deprecated = F.col("scheme_subtype") == "BOC"

    def reasons(given: Column) -> Column:
        slab = F.create_map(
            F.lit("discount_slab_type_reasoning"), F.lit(fixed.SLAB_TYPE_REASON),
            F.lit("best_bet_reasoning"), F.lit(fixed.BEST_BET_REASON),
        )
        name = "scheme_subtype_reasoning"
        converted = F.create_map(
            F.lit(name),
            F.concat(F.lit(fixed.CONVERTED_SUBTYPE_PREFIX), F.coalesce(F.try_element_at(given, F.lit(name)), F.lit(""))),
        )
        return F.when(periodic, _with_entries(given, slab)).when(
            deprecated, _with_entries(given, converted)
        ).otherwise(given)

    given = F.coalesce(F.col("reasonings"), F.create_map().cast("map<string,string>"))
    return (
        fields.withColumn("scheme_type", F.when(F.col("scheme_subtype") == "PDC", "PDC").otherwise(F.col("scheme_type")))
        .withColumn("reasonings", reasons(given))
        .withColumns(
            {
                "discount_slab_type": F.when(periodic, "notApplicable").otherwise(F.col("discount_slab_type")),
                "best_bet": F.when(periodic, "FALSE").otherwise(F.col("best_bet")),
                "scheme_subtype": F.when(deprecated, "PUC").otherwise(F.col("scheme_subtype")),
            }
        )
    )


def _with_entries(given: Column, entries: Column) -> Column:
    kept = F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(entries), k))
    return F.map_concat(kept, entries)


# Rule -> resulting pair, in order of priority.
RULES = {
    "buy_side": ("BUY_SIDE", "PERIODIC_CLAIM"),
    "lifestyle": ("SELL_SIDE", "LS"),
    "one_off": ("OFC", "OFC"),
    "price_drop": ("PDC", "PDC"),
    "exchange": ("SELL_SIDE", "PRX"),
}


def mail_signals(mail: Column) -> Column:
    """What a mail's words say about its scheme: struct of one boolean per rule.

    Taken while the text is at hand, so that the rules do not need it again.
    """

    def signals(low: Column) -> Column:
        return F.struct(
            low.rlike(uncased(any_of(fixed.BUY_SIDE_PATTERNS))).alias("buy_side"),
            contains_any(low, fixed.LIFESTYLE_WORDS).alias("lifestyle"),
            contains_any(low, fixed.ONE_OFF_WORDS).alias("one_off"),
            contains_any(low, fixed.PRICE_DROP_WORDS).alias("price_drop"),
            contains_any(low, fixed.EXCHANGE_WORDS).alias("exchange"),
        )

    return let(F.lower(F.coalesce(mail, F.lit(""))), signals)


def override_rule(signals: Column, vendor: Column) -> Column:
    """Name of the first override rule that applies, NULL if none does."""
    lifestyle_vendor = contains_any(F.lower(F.coalesce(vendor, F.lit(""))), fixed.LIFESTYLE_VENDORS)
    return (
        F.when(signals["buy_side"], "buy_side")
        .when(lifestyle_vendor | signals["lifestyle"], "lifestyle")
        .when(signals["one_off"], "one_off")
        .when(signals["price_drop"], "price_drop")
        .when(signals["exchange"], "exchange")
    )


def _by_rule(rule: Column, values: dict[str, str], otherwise: Column) -> Column:
    picked = F
    for name, value in values.items():
        picked = picked.when(rule == name, F.lit(value))
    return picked.otherwise(otherwise)


def with_overrides(fields: DataFrame, signals: str = "signals") -> DataFrame:
    """Force the pair where the mail or the vendor says what it is; adds ``override_rule``."""
    rule = F.col("override_rule")
    return fields.withColumn("override_rule", override_rule(F.col(signals), F.col("vendor_name"))).withColumns(
        {
            "scheme_type": _by_rule(rule, {r: p[0] for r, p in RULES.items()}, F.col("scheme_type")),
            "scheme_subtype": _by_rule(rule, {r: p[1] for r, p in RULES.items()}, F.col("scheme_subtype")),
        }
    )


def valid_subtype(scheme_type: Column, subtype: Column) -> Column:
    """The subtype a type allows, keeping it where it is allowed already."""
    return (
        F.when(scheme_type == "BUY_SIDE", F.lit("PERIODIC_CLAIM"))
        .when(scheme_type == "PDC", F.lit("PDC"))
        .when(scheme_type == "OFC", F.lit("OFC"))
        .when((scheme_type == "SELL_SIDE") & ~subtype.isin(fixed.SELL_SIDE_SUBTYPES), F.lit("CP"))
        .otherwise(subtype)
    )


def with_valid_pair(fields: DataFrame) -> DataFrame:
    """Correct subtypes the type does not allow; ``pair_fixed`` tells where."""
    subtype = valid_subtype(F.col("scheme_type"), F.col("scheme_subtype"))
    return fields.withColumn("_subtype", subtype).withColumns(
        {
            "pair_fixed": F.col("_subtype") != F.col("scheme_subtype"),
            "scheme_subtype": F.col("_subtype"),
        }
    ).drop("_subtype")


def resolve_fields(predictions: DataFrame, signals: str = "signals") -> DataFrame:
    """All corrections in their order, over predictions with their ``mail_signals``.

    ``stated_type`` and ``stated_subtype`` keep the pair as it was before the overrides,
    which is what confidence is judged by.
    """
    stated = with_fixed_terms(with_defaults(predictions)).withColumns(
        {"stated_type": F.col("scheme_type"), "stated_subtype": F.col("scheme_subtype")}
    )
    overridden = with_overrides(stated, signals).withColumns(
        {"traced_type": F.col("scheme_type"), "traced_subtype": F.col("scheme_subtype")}
    )
    return with_valid_pair(overridden)


def confidence(value: Column, reasoning: Column) -> Column:
    vague = contains_any(F.lower(F.coalesce(value, F.lit(""))), fixed.LOW_CONFIDENCE_WORDS)
    return (
        F.when(vague, "Low")
        .when(F.length(F.coalesce(reasoning, F.lit(""))) < fixed.SHORT_REASONING, "Medium")
        .otherwise("High")
    )


def trace_record(fields: DataFrame) -> DataFrame:
    """Add ``trace``: array<struct<field, value, reasoning, confidence>> over ``resolve_fields``.

    An override changes value and reasoning of the pair but not its confidence, and the
    pair check leaves the trace alone.
    """
    rule = F.col("override_rule")

    def entry(name: str) -> Column:
        source = fixed.REASONING_OF[name]
        value = F.col({"scheme_type": "stated_type", "scheme_subtype": "stated_subtype"}.get(name, name))
        if source == name:
            reasoning = F.col(f"raw_{name}")
        else:
            reasoning = F.coalesce(F.try_element_at("reasonings", F.lit(source)), F.lit(fixed.NO_REASONING))
        judged = confidence(value, reasoning)
        if name in ("scheme_type", "scheme_subtype"):
            value = F.col("traced_type" if name == "scheme_type" else "traced_subtype")
            reasoning = _by_rule(rule, fixed.OVERRIDE_REASONS, reasoning)
        return F.struct(
            F.lit(name).alias("field"),
            value.alias("value"),
            reasoning.alias("reasoning"),
            judged.alias("confidence"),
        )

    return fields.withColumn("trace", F.array(*[entry(name) for name in fixed.REASONING_OF]))


def field_trace(fields: DataFrame) -> DataFrame:
    """One row per document and field: (doc_id, field, value, reasoning, confidence)."""
    return trace_record(fields).select("doc_id", F.inline("trace"))


def reasoning_json(fields: DataFrame) -> DataFrame:
    """The whole trace of a document as one JSON object: (doc_id, reasoning)."""
    by_field = F.map_from_entries(
        F.transform(
            "trace",
            lambda t: F.struct(
                t["field"],
                F.struct(
                    t["value"].alias("value"),
                    t["reasoning"].alias("reasoning"),
                    t["confidence"].alias("confidence"),
                ),
            ),
        )
    )
    overall = (
        F.coalesce("global_reasoning", F.lit(fixed.NO_GLOBAL_REASONING))
        if "global_reasoning" in fields.columns
        else F.lit(fixed.NO_GLOBAL_REASONING)
    )
    named = trace_record(fields).withColumn("_fields", by_field)
    record = F.struct(
        *[F.col("_fields")[name].alias(name) for name in fixed.REASONING_OF],
        overall.alias("global_reasoning"),
    )
    return named.select("doc_id", F.to_json(record).alias("reasoning"))


def output_record(scheme_type: Column, subtype: Column) -> Column:
    """Struct of the fields a scheme of this pair reports, the others NULL."""
    pdc, ofc = scheme_type == "PDC", scheme_type == "OFC"
    periodic = (scheme_type == "BUY_SIDE") & (subtype == "PERIODIC_CLAIM")
    buy_pdc = (scheme_type == "BUY_SIDE") & (subtype == "PDC")

    def sell(*subtypes: str) -> Column:
        return (scheme_type == "SELL_SIDE") & subtype.isin(*subtypes)

    optional = {
        "fsn_file_config_file": ~ofc,
        "max_cap": ofc,
        "price_drop_date": pdc | buy_pdc,
        "min_actual_discount_or_agreed_claim": sell("LS", "PUC"),
        "remove_gst_from_final_claim": pdc | ofc | periodic | buy_pdc | sell("CP", "PRX", "PUC", "SC"),
        "over_and_above": pdc | periodic | buy_pdc | sell("CP", "LS", "PRX", "PUC", "SC"),
        "discount_slab_type": periodic,
        "best_bet": periodic,
        "brand_support_absolute": ofc,
        "gst_rate": ofc,
    }
    return F.struct(
        *[F.col(name) for name in fixed.ALWAYS_OUTPUT],
        *[F.when(included, F.col(name)).alias(name) for name, included in optional.items()],
    )


def output_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, output): the output struct; ``to_json`` leaves its NULL keys out."""
    return fields.select(
        "doc_id", output_record(F.col("scheme_type"), F.col("scheme_subtype")).alias("output")
    )
