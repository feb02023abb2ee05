"""Queries over prediction fields, rules, periods and configuration records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.operators import config, fields, lookup, predict
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query

GIVEN = ["scheme_type", "scheme_subtype", "vendor_name", "start_date", "sub_periods", "extracted_fsns",
         "model_name", "config_brand_support"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction view under the full contract, with a reasoning for two fields."""
    given = view(spark, sf_dir, fx.PREDICTIONS).withColumn(
        "reasonings",
        F.create_map(
            F.lit("scheme_subtype_reasoning"), F.col("reasoning"), F.lit("vendor_name_reasoning"), F.col("reasoning")
        ),
    )
    return predict.as_predictions(given)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = view(spark, sf_dir, fx.MAILS).select("doc_id", fields.mail_signals(F.col("raw_text")).alias("signals"))
    return fields.resolve_fields(predictions(spark, sf_dir).join(mails, "doc_id"))


# --- the same in SQL ------------------------------------------------------------------

_NO_DATE = ", ".join(sql.quoted(w) for w in fixed.NO_DATE)


def date_sql(x: str, none_words: list[str], none_value: str, formats: list[str]) -> str:
    words = ", ".join(sql.quoted(w) for w in none_words)
    part = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    day, month, year = (f"regexp_extract({x}, '{part}', {i})" for i in (1, 2, 3))
    parsed = ", ".join(f"try_strptime({x}, '{f}')" for f in formats)
    return f"""case when {x} is null or {x} = '' or lower({x}) in ({words}) then '{none_value}'
      when regexp_matches({x}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') then {x}
      else coalesce(strftime(coalesce({parsed}), '%d/%m/%Y'),
        case when regexp_matches({x}, '{part}') then lpad({day}, 2, '0') || '/' || lpad({month}, 2, '0') || '/' || {year} end, {x}) end"""


DATE_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d %b %Y", "%d %B %Y", "%B %d, %Y", "%b %d, %Y"]


def _default_sql(name: str) -> str:
    default = sql.quoted(fixed.FIELD_DEFAULTS[name])
    value = f"coalesce({sql.strip(name)}, {default})" if name in GIVEN else default
    return date_sql(value, fixed.NO_DATE, "N/A", DATE_FORMATS) if name in fixed.DATE_FIELDS else value


DEFAULTS = "select doc_id, reasoning, email_text, " + ", ".join(
    f"{_default_sql(n)} as {n}" for n in fixed.FIELD_DEFAULTS
) + ", " + ", ".join(f"{n} as raw_{n}" if n in GIVEN else f"null as raw_{n}" for n in fields.SELF_EXPLAINING) + " from given"


def _contains(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {sql.quoted(w)})" for w in words) + ")"


RULE = f"""case when regexp_matches(low, '{sql.unicode_bounds(fixed.BUY_SIDE_PATTERNS[0])}') or regexp_matches(low, '{fixed.BUY_SIDE_PATTERNS[1]}') then 'buy_side'
  when {_contains('lower(vendor_name)', fixed.LIFESTYLE_VENDORS)} or {_contains('low', fixed.LIFESTYLE_WORDS)} then 'lifestyle'
  when {_contains('low', fixed.ONE_OFF_WORDS)} then 'one_off'
  when {_contains('low', fixed.PRICE_DROP_WORDS)} then 'price_drop'
  when {_contains('low', fixed.EXCHANGE_WORDS)} then 'exchange' end"""

RESOLVED = [
    ("predicted", fx.PREDICTIONS), ("mails", fx.MAILS),
    ("given", "select p.*, m.raw_text as email_text from predicted p join mails m on p.doc_id = m.doc_id"),
    ("defaulted", DEFAULTS),
    ("typed", "select * replace (case when scheme_subtype = 'PDC' then 'PDC' else scheme_type end as scheme_type) from defaulted"),
    ("stated", """select * replace (
        case when periodic then 'notApplicable' else discount_slab_type end as discount_slab_type,
        case when periodic then 'FALSE' else best_bet end as best_bet,
        case when scheme_subtype = 'BOC' then 'PUC' else scheme_subtype end as scheme_subtype),
        scheme_subtype = 'BOC' as converted
      from (select *, upper(scheme_type) = 'BUY_SIDE' and upper(scheme_subtype) = 'PERIODIC_CLAIM' as periodic from typed)"""),
    ("ruled", f"select *, {RULE} as override_rule from (select *, lower(email_text) as low from stated)"),
    ("traced", """select *,
        case override_rule when 'buy_side' then 'BUY_SIDE' when 'lifestyle' then 'SELL_SIDE' when 'one_off' then 'OFC' when 'price_drop' then 'PDC' when 'exchange' then 'SELL_SIDE' else scheme_type end as traced_type,
        case override_rule when 'buy_side' then 'PERIODIC_CLAIM' when 'lifestyle' then 'LS' when 'one_off' then 'OFC' when 'price_drop' then 'PDC' when 'exchange' then 'PRX' else scheme_subtype end as traced_subtype
      from ruled"""),
    ("paired", """select *, case when traced_type = 'BUY_SIDE' then 'PERIODIC_CLAIM' when traced_type = 'PDC' then 'PDC' when traced_type = 'OFC' then 'OFC'
        when traced_type = 'SELL_SIDE' and traced_subtype not in ('CP', 'PUC', 'PRX', 'LS') then 'CP' else traced_subtype end as final_subtype from traced"""),
    ("resolved", """select * exclude (scheme_type, scheme_subtype, final_subtype), scheme_type as stated_type, scheme_subtype as stated_subtype,
        traced_type as scheme_type, final_subtype as scheme_subtype, final_subtype <> traced_subtype as pair_fixed from paired"""),
]


# --- fields ---------------------------------------------------------------------------


@query(ctes(*RESOLVED[:4], body="select doc_id, " + ", ".join(fixed.FIELD_DEFAULTS) + " from defaulted"))
def field_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.with_defaults(predictions(spark, sf_dir)).select("doc_id", *fields.FIELDS)


# Spellings of dates, among them impossible ones.
_DATES = """select doc_id, case doc_id % 12 when 0 then '2024-2-1' when 1 then '31/02/2024' when 2 then '5 Jan 2024'
  when 3 then '05 january 2024' when 4 then 'Jan 5, 2024' when 5 then 'NOT FOUND' when 6 then 'from 3-4-2024 on'
  when 7 then '31-02-2024' when 8 then 'soon' when 9 then '' when 10 then '1/2/2024' else 'March 9, 2024' end as value,
  lang from documents"""


@query(
    ctes(
        ("dates", _DATES),
        body=f"select doc_id, value, {date_sql('value', fixed.NO_DATE, 'N/A', DATE_FORMATS)} as normalised from dates",
    )
)
def normalised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _DATES).select(
        "doc_id", "value", fields.normalised_date(F.col("value")).alias("normalised")
    )


@query(
    ctes(*RESOLVED[:6], body="select doc_id, scheme_type, scheme_subtype, discount_slab_type, best_bet from stated")
)
def fixed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.with_fixed_terms(fields.with_defaults(predictions(spark, sf_dir))).select(
        "doc_id", "scheme_type", "scheme_subtype", "discount_slab_type", "best_bet"
    )


@query(
    ctes(
        *RESOLVED,
        body="""select doc_id, override_rule, stated_type, stated_subtype, traced_type, traced_subtype,
          scheme_type, scheme_subtype, pair_fixed from resolved""",
    )
)
def resolved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select(
        "doc_id", "override_rule", "stated_type", "stated_subtype", "traced_type", "traced_subtype",
        "scheme_type", "scheme_subtype", "pair_fixed",
    )


@query(ctes(("p", fx.PREDICTIONS), body="select doc_id, scheme_type is null as looks_truncated from p"))
def truncated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.truncated(predictions(spark, sf_dir))


def _trace_sql() -> str:
    rows = []
    for name, source in fixed.REASONING_OF.items():
        value = {"scheme_type": "stated_type", "scheme_subtype": "stated_subtype"}.get(name, name)
        none = sql.quoted(fixed.NO_REASONING)
        if name == source:
            reasoning = f"raw_{name}"
        elif name == "scheme_subtype":
            reasoning = f"case when converted and not periodic then {sql.quoted(fixed.CONVERTED_SUBTYPE_PREFIX)} || reasoning else reasoning end"
        elif name == "vendor_name":
            reasoning = "reasoning"
        elif name == "discount_slab_type":
            reasoning = f"case when periodic then {sql.quoted(fixed.SLAB_TYPE_REASON)} else {none} end"
        elif name == "best_bet":
            reasoning = f"case when periodic then {sql.quoted(fixed.BEST_BET_REASON)} else {none} end"
        else:
            reasoning = none
        shown, shown_reason = value, reasoning
        if name in ("scheme_type", "scheme_subtype"):
            shown = "traced_type" if name == "scheme_type" else "traced_subtype"
            shown_reason = "case override_rule " + " ".join(
                f"when '{rule}' then {sql.quoted(reason)}" for rule, reason in fixed.OVERRIDE_REASONS.items()
            ) + f" else {reasoning} end"
        rows.append(
            f"select doc_id, '{name}' as field, {shown} as value, {shown_reason} as reasoning, "
            f"case when {_contains(f'lower({value})', fixed.LOW_CONFIDENCE_WORDS)} then 'Low' "
            f"when length(coalesce({reasoning}, '')) < {fixed.SHORT_REASONING} then 'Medium' else 'High' end as confidence from resolved"
        )
    return " union all ".join(rows)


@query(ctes(*RESOLVED, body=_trace_sql()))
def field_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_trace(resolved(spark, sf_dir))


@query(ctes(*RESOLVED, ("trace", _trace_sql()), body="select confidence, field, count(*) as n from trace group by confidence, field"))
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_trace(resolved(spark, sf_dir)).groupBy("confidence", "field").agg(F.count("*").alias("n"))


_PDC = "scheme_type = 'PDC'"
_OFC = "scheme_type = 'OFC'"
_PERIODIC = "(scheme_type = 'BUY_SIDE' and scheme_subtype = 'PERIODIC_CLAIM')"
_BUY_PDC = "(scheme_type = 'BUY_SIDE' and scheme_subtype = 'PDC')"


def _sell(*subtypes: str) -> str:
    return "(scheme_type = 'SELL_SIDE' and scheme_subtype in (" + ", ".join(f"'{s}'" for s in subtypes) + "))"


OUTPUT_KEYS = {
    **{name: "true" for name in fixed.ALWAYS_OUTPUT},
    "fsn_file_config_file": f"not {_OFC}",
    "max_cap": _OFC,
    "price_drop_date": f"{_PDC} or {_BUY_PDC}",
    "min_actual_discount_or_agreed_claim": _sell("LS", "PUC"),
    "remove_gst_from_final_claim": f"{_PDC} or {_OFC} or {_PERIODIC} or {_BUY_PDC} or {_sell('CP', 'PRX', 'PUC', 'SC')}",
    "over_and_above": f"{_PDC} or {_PERIODIC} or {_BUY_PDC} or {_sell('CP', 'LS', 'PRX', 'PUC', 'SC')}",
    "discount_slab_type": _PERIODIC,
    "best_bet": _PERIODIC,
    "brand_support_absolute": _OFC,
    "gst_rate": _OFC,
}


def _key_values(json: str) -> F.Column:
    """The keys and values of a flat JSON object as rows."""
    return F.explode(F.from_json(json, "map<string,string>")).alias("key", "value")


@query(
    ctes(
        *RESOLVED,
        body=" union all ".join(
            f"select doc_id, '{key}' as key, {key} as value from resolved where {test}" for key, test in OUTPUT_KEYS.items()
        ),
    )
)
def output_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fields.output_fields(resolved(spark, sf_dir)).select("doc_id", F.to_json("output").alias("json"))
    return records.select("doc_id", _key_values("json"))


# --- predictor boundary ---------------------------------------------------------------


@query(
    ctes(
        ("mails", fx.MAILS),
        body="""select doc_id, case when contains(lower(raw_text), 'price drop') then 'PDC' else 'SELL_SIDE' end as scheme_type,
          regexp_extract(lower(raw_text), 'from: (\\w+)', 1) as vendor_name, 'NO TABLE DATA AVAILABLE' as scheme_name from mails""",
    )
)
def predicted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make_predictor():
        """A small rule-based predictor, opened once per task."""

        def run(batch):
            mail = batch["email_text"].str.lower()
            return batch[["doc_id"]].assign(
                scheme_type=mail.str.contains("price drop", regex=False).map({True: "PDC", False: "SELL_SIDE"}),
                vendor_name=mail.str.extract(r"from: (\w+)", expand=False),
                scheme_name=batch["table_data"].str.upper(),
            )

        return run

    inputs = view(spark, sf_dir, fx.MAILS).select(
        "doc_id",
        F.col("raw_text").alias("email_text"),
        F.lit(fixed.NO_TABLE_DATA).alias("table_data"),
        F.lit(fixed.NO_XLSX_DATA).alias("xlsx_data"),
    )
    return predict.predict(inputs, make_predictor, keep=False).select(
        "doc_id", "scheme_type", "vendor_name", "scheme_name"
    )


# --- periods and configuration records ------------------------------------------------

# Periods in several spellings, some that cannot be read.
_PERIODS = """select doc_id, '01/01/2024' as start_date, '31/01/2024' as end_date,
  case doc_id % 6 when 0 then '01/02/2024 to 10/02/2024; 11/02/2024 TO 20/02/2024' when 1 then 'Single Period'
    when 2 then '1 october 2024 to 5 october 2024' when 3 then 'whole month' when 4 then '' else '5 May to 9 May;;n/a; 1 June to 3 June' end as sub_periods
  from documents"""


def periods_sql(source: str) -> list[tuple[str, str]]:
    """CTE periods(..., period_no, num_periods, start_date, end_date, error)."""
    ranges = "list_filter(string_split(lower(sub_periods), ';'), lambda p: contains(p, 'to'))"
    return [
        ("split_periods", f"""select *, case when sub_periods is null or sub_periods = '' or lower(sub_periods) = 'single period' then [] else {ranges} end as ranges from {source}"""),
        ("judged_periods", "select *, len(list_filter(ranges, lambda p: len(string_split(p, 'to')) <> 2)) > 0 as broken from split_periods"),
        ("periods", f"""select * exclude (ranges, broken, start_date, end_date), cast(null as varchar) as error, cast(len(ranges) as bigint) as num_periods,
              generate_subscripts(ranges, 1) as period_no,
              unnest(list_transform(ranges, lambda p: {sql.strip("string_split(p, 'to')[1]")})) as start_date,
              unnest(list_transform(ranges, lambda p: {sql.strip("string_split(p, 'to')[2]")})) as end_date
            from judged_periods where len(ranges) > 0 and not broken
          union all select * exclude (ranges, broken, start_date, end_date), case when broken then 'cannot split the periods: ' || sub_periods end,
              1, 1, start_date, end_date from judged_periods where len(ranges) = 0 or broken"""),
    ]


@query(
    ctes(
        ("given", _PERIODS), *periods_sql("given"),
        body="select doc_id, sub_periods, error, num_periods, cast(period_no as bigint) as period_no, start_date, end_date from periods",
    )
)
def scheme_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.with_periods(view(spark, sf_dir, _PERIODS))


# Every known pair, unknown ones, and blank values that need their fallback.
_PAIRS = """select doc_id,
  case doc_id % 5 when 0 then 'PDC' when 1 then 'BUY_SIDE' when 2 then 'SELL_SIDE' when 3 then 'OFC' else 'OTHER' end as scheme_type,
  case doc_id % 8 when 0 then 'PERIODIC_CLAIM' when 1 then 'PDC' when 2 then 'CP' when 3 then 'PUC' when 4 then 'PRX' when 5 then 'SC' when 6 then 'LS' else 'XX' end as scheme_subtype,
  case when doc_id % 2 = 0 then '' else '5% of NLC' end as config_brand_support,
  case when doc_id % 3 = 0 then '' else '10' end as config_unit_slab_lower,
  case when doc_id % 3 = 1 then '' else '90' end as config_unit_slab_upper,
  case when doc_id % 7 = 0 then '' else '5000' end as config_max_support_value,
  case when doc_id % 11 = 0 then '' else '60:40' end as config_vendor_split_ratio,
  case when doc_id % 13 = 0 then '' else '12' end as config_margin,
  '01/02/2024' as price_drop_date, 'FALSE' as best_bet, 'TRUE' as min_actual_discount_or_agreed_claim,
  case when doc_id % 4 = 0 then '37' else null end as margin, case when doc_id % 4 = 0 then 'PERCENTAGE' else null end as dmrp_type,
  case when doc_id % 4 = 0 then '40' else null end as dmrp_value, case when doc_id % 4 = 0 then 'SITE_9' else null end as site
  from documents"""

_BS = "coalesce(nullif(config_brand_support, ''), 'Not specified')"
_VS = "coalesce(nullif(config_vendor_split_ratio, ''), 'Not specified')"
_LO = "coalesce(nullif(config_unit_slab_lower, ''), '0')"
_UP = "coalesce(nullif(config_unit_slab_upper, ''), '999999')"
_MX = "coalesce(nullif(config_max_support_value, ''), 'No Cap')"
_MG = "coalesce(nullif(config_margin, ''), 'Not specified')"
SHAPES = {
    "PDC": {"brandSupport": _BS, "maxQuantity": _UP, "priceDropDate": "price_drop_date", "maxSupportValue": _MX},
    "BS-PC": {"unitSlabLower": _LO, "unitSlabUpper": _UP, "brandSupport": _BS, "maxSupportValue": _MX, "bestBetQuantity": "best_bet"},
    "BS-PDC": {"brandSupport": _BS, "maxQuantity": _UP, "maxSupportValue": _MX},
    "SS-CP": {"brandSupport": _BS, "vendorSplitRatio": _VS},
    "SS-PUC": {"brandSupport": _BS, "vendorSplitRatio": _VS, "unitSlabLower": _LO, "unitSlabUpper": _UP, "maxSupportValue": _MX, "margin": _MG},
    "SS-PRX": {"incomingFsn": "'Populate from Exchange FSN File'", "vendorSplitRatio": _VS, "exchangeSlabFrom": _LO, "exchangeSlabTo": _UP, "agreedSupport": _BS},
    "SS-SC": {"brandSupport": _BS},
    "SS-LS": {"unitSlabLower": _LO, "unitSlabUpper": _UP, "brandSupport": _BS, "vendorSplitRatio": _VS,
              "margin": f"coalesce(margin, {_MG})", "dmrpType": "coalesce(dmrp_type, 'Manual - From DMRP File')",
              "dmrpValue": "coalesce(dmrp_value, 'Manual - From DMRP File')",
              "maxSupportValue": "coalesce(nullif(config_max_support_value, ''), min_actual_discount_or_agreed_claim)"},
}
CONFIG_TYPE = "case when scheme_type = 'PDC' then 'PDC' " + " ".join(
    f"when scheme_type = '{t}' and scheme_subtype = '{s}' then '{name}'" for (t, s), name in config.CONFIG_TYPES.items()
) + " when scheme_type = 'OFC' then 'info' when scheme_type in ('BUY_SIDE', 'SELL_SIDE') then 'empty' else 'error' end"


def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = view(spark, sf_dir, _PAIRS)
    enriched = F.when(
        F.col("margin").isNotNull(),
        F.struct("margin", F.col("dmrp_type").alias("dmrpType"), F.col("dmrp_value").alias("dmrpValue"), F.col("site").alias("site_id")),
    )
    return config.with_config(given.withColumn("enriched", enriched).drop("margin", "dmrp_type", "dmrp_value", "site"))


@query(
    ctes(
        ("pairs", _PAIRS),
        body=f"""select doc_id, config_type,
          case config_type when 'info' then 'No FSN Config required for OFC' when 'error' then 'Unknown scheme configuration for ' || scheme_type || ' - ' || scheme_subtype end as config_note,
          case when config_type = 'SS-LS' then 'LLM + Local Mapping' when config_type not in ('info', 'error', 'empty') then 'LLM' end as extraction_source,
          case when config_type = 'SS-LS' then coalesce(site, 'National') end as site_id
        from (select *, {CONFIG_TYPE} as config_type from pairs)""",
    )
)
def config_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _configured(spark, sf_dir).select("doc_id", "config_type", "config_note", "extraction_source", "site_id")


@query(
    ctes(
        ("pairs", _PAIRS), ("typed", f"select *, {CONFIG_TYPE} as config_type from pairs"),
        body=" union all ".join(
            f"select doc_id, '{kind}' as config_type, '{key}' as key, {value} as value from typed where config_type = '{kind}'"
            for kind, shape in SHAPES.items() for key, value in shape.items()
        ),
    )
)
def config_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _configured(spark, sf_dir).select("doc_id", "config_type", F.to_json("config_fields").alias("json"))
    return records.select("doc_id", "config_type", _key_values("json"))
