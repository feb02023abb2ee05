"""Queries over labels, normalisers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.operators import evaluate
from claimloom.queries import fields as field_queries
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query

# --- label keys -----------------------------------------------------------------------

_EXTRA_LABELS = [
    "Max Cap (any) per user", "Slab Max Cap", "discount slab", "Best Bet?", "Minimum of actual price", "fsn list",
    "Config sheet", "Over & Above it", "Please remove GST", "gst note", "Document is attached", "Vendor code",
    "Price drop on", "Start of the date", "End of date", "Some Other Field", "Brand",
]
LABELS = list(fixed.LABEL_KEYS) + _EXTRA_LABELS
_LABELS = (
    "select doc_id, case doc_id % {n} {cases} end as label, lang as value from documents".format(
        n=len(LABELS), cases=" ".join(f"when {i} then {sql.quoted(label)}" for i, label in enumerate(LABELS))
    )
)


def field_sql(x: str) -> str:
    known = " ".join(f"when {x} = {sql.quoted(k)} then '{v}'" for k, v in fixed.LABEL_KEYS.items())
    rules = " ".join(
        "when " + " or ".join(
            "(" + " and ".join(f"contains(upper({x}), {sql.quoted(w)})" for w in words) + ")" for words in alternatives
        ) + f" then '{field}'"
        for alternatives, field in fixed.LABEL_KEY_RULES
    )
    return f"case {known} {rules} else replace(lower({x}), ' ', '_') end"


@query(ctes(("l", _LABELS), body=f"select doc_id, label, {field_sql('label')} as field from l"))
def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _LABELS).select("doc_id", "label", evaluate.field_of_label(F.col("label")).alias("field"))


_LABEL_LISTS = """select doc_id, 'Vendor' as k1, concat('v', cast(doc_id as varchar(20))) as v1, 'My Vendor' as k2, lang as v2,
  'End Date' as k3, '01/02/2024' as v3, 'Odd Key' as k4, source as v4 from documents"""


@query(
    ctes(
        ("l", _LABEL_LISTS),
        body="""select doc_id, 'vendor_name' as field, v2 as value from l union all select doc_id, 'end_date', v3 from l
          union all select doc_id, 'odd_key', v4 from l""",
    )
)
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = view(spark, sf_dir, _LABEL_LISTS)
    labels = F.create_map(*[c for i in range(1, 5) for c in (f"k{i}", f"v{i}")])
    return given.select("doc_id", F.explode(evaluate.mapped_labels(labels)).alias("field", "value"))


# --- normalisers ----------------------------------------------------------------------

_SPELLINGS = """select doc_id, case doc_id % 20 when 0 then ' BS ' when 1 then 'sell side' when 2 then 'one off' when 3 then 'PDC-PDC'
  when 4 then 'Price_Drop' when 5 then 'bs-pc' when 6 then 'COUPON' when 7 then 'puc_fdc' when 8 then 'Exchange' when 9 then 'super coin'
  when 10 then 'Lifestyle' when 11 then 'No' when 12 then 'NoField' when 13 then '' when 14 then null when 15 then '01/02/2024 - 10/02/2024'
  when 16 then '2024-02-01' when 17 then '1-feb  to   5-feb' when 18 then 'Jan 5, 2024' else concat(lang, ' ', source) end as value from documents"""


def plain_sql(x: str) -> str:
    return f"lower({sql.strip(f'coalesce({x}, chr(32))')})"


def synonym_sql(x: str, synonyms: dict[str, list[str]]) -> str:
    cases = " ".join(
        f"when upper({x}) in (" + ", ".join(sql.quoted(s) for s in spellings) + f") then '{standard}'"
        for standard, spellings in synonyms.items()
    )
    return f"case {cases} else lower({x}) end"


def na_sql(x: str) -> str:
    words = ", ".join(sql.quoted(w) for w in fixed.NOT_APPLICABLE)
    return f"case when {x} in ({words}) then 'not applicable' else {x} end"


def duration_sql(x: str) -> str:
    return f"regexp_replace(replace(replace({x}, ' - ', ' to '), '-', ' to '), '\\s+to\\s+', ' to ', 'g')"


def evaluation_date_sql(x: str) -> str:
    return field_queries.date_sql(x, fixed.NO_DATE_IN_EVALUATION, "n/a", field_queries.DATE_FORMATS[:-1])


@query(
    ctes(
        ("given", _SPELLINGS), ("plain", f"select doc_id, {plain_sql('value')} as v from given"),
        body=f"""select doc_id, v as plain, {evaluation_date_sql('v')} as date, {synonym_sql('v', fixed.TYPE_SYNONYMS)} as type,
          {synonym_sql('v', fixed.SUBTYPE_SYNONYMS)} as subtype, {na_sql('v')} as not_applicable, {duration_sql('v')} as duration from plain""",
    )
)
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _SPELLINGS).select("doc_id", evaluate.plain(F.col("value")).alias("plain")).select(
        "doc_id",
        "plain",
        evaluate.evaluation_date(F.col("plain")).alias("date"),
        evaluate.standard_type(F.col("plain")).alias("type"),
        evaluate.standard_subtype(F.col("plain")).alias("subtype"),
        evaluate.or_not_applicable(F.col("plain")).alias("not_applicable"),
        evaluate.standard_duration(F.col("plain")).alias("duration"),
    )


# --- scores ---------------------------------------------------------------------------

# Labels for every scored field; predictions that agree in part.
_GOLD = f"""select g.*, case when example_id % 3 = 0 then 'Titan Company Ltd' when example_id % 3 = 1 then 'unknown vendor' else 'n/a' end as vendor_name,
  case when example_id % 2 = 0 then '01/02/2024' else 'Not Specified' end as start_date, '2024-03-31' as end_date,
  'No' as max_cap, 'FALSE' as over_and_above from ({fx.GOLD}) g"""
_PREDICTED = f"""select p.doc_id, p.scheme_type, p.scheme_subtype, p.vendor_name, p.start_date, case when doc_id % 4 = 0 then '31/03/2024' else '1 April 2024' end as end_date,
  case when doc_id % 5 = 0 then '01/02/2024 to 10/02/2024' else 'N/A' end as duration, case when doc_id % 2 = 0 then 'Not Applicable' else '500' end as max_cap,
  case when doc_id % 6 = 0 then 'false' else 'TRUE' end as over_and_above, case when doc_id % 3 = 0 then 'abc' else 'abcd' end as scheme_name,
  model_name as scheme_description from ({fx.PREDICTIONS}) p"""

_GOLD_FIELDS = ["scheme_type", "scheme_subtype", "duration", "vendor_name", "start_date", "end_date", "max_cap", "over_and_above"]


def _normal_sql(field: str, x: str) -> str:
    value = plain_sql(x)
    if field == "scheme_type":
        return synonym_sql(value, fixed.TYPE_SYNONYMS)
    if field == "scheme_subtype":
        return synonym_sql(value, fixed.SUBTYPE_SYNONYMS)
    if field == "duration":
        return duration_sql(value)
    if field in fixed.SCORED_DATES:
        return evaluation_date_sql(value)
    return na_sql(value)


_COMPARED_FIELDS = [f for f in evaluate.SCORED_FIELDS if f not in fixed.FREE_TEXT_FIELDS]
COMPARED = [
    ("gold", _GOLD), ("predicted", _PREDICTED),
    ("compared", "select example_id, " + ", ".join(
        f"{_normal_sql(f, f'g.{f}' if f in _GOLD_FIELDS else 'cast(null as varchar)')} as expected_{f}, "
        f"{_normal_sql(f, f'p.{f}' if f in _GOLD_FIELDS else 'cast(null as varchar)')} as actual_{f}"
        for f in _COMPARED_FIELDS
    ) + ", " + ", ".join(f"length({plain_sql('p.' + f)}) as length_{f}" for f in fixed.FREE_TEXT_FIELDS)
      + " from gold g join predicted p on g.example_id = p.doc_id"),
    ("scored", "select *, (" + " + ".join(
        f"case when expected_{f} = actual_{f} then {w} else 0.0 end" for f, w in evaluate._weights().items()
    ) + " + " + " + ".join(f"case when length_{f} > 3 then 0.5 else 0.0 end" for f in fixed.FREE_TEXT_FIELDS)
      + ") / 16.0 as score from compared"),
]


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compared(view(spark, sf_dir, _PREDICTED), view(spark, sf_dir, _GOLD))


@query(ctes(*COMPARED, body="select example_id, cast(score as double) as score from scored"))
def example_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scores(_compared(spark, sf_dir))


@query(ctes(*COMPARED, body="select count(*) as examples, round(avg(cast(score as double)), 9) as mean_score from scored"))
def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluate.dataset_score(evaluate.scores(_compared(spark, sf_dir)))
    return result.withColumn("mean_score", F.round("mean_score", 9))


@query(
    ctes(
        *COMPARED,
        ("first_examples", f"select * from scored order by example_id limit {fixed.REPORTED_EXAMPLES}"),
        ("differing", " union all ".join(
            f"select example_id, '{f}' as field, expected_{f} as expected, actual_{f} as actual from first_examples where expected_{f} <> actual_{f}"
            for f in fixed.REPORTED_FIELDS
        )),
        body="""select f.example_id, d.field, d.expected, d.actual, d.field is null as perfect_match, cast(f.score as double) as score
          from first_examples f left join differing d on f.example_id = d.example_id""",
    )
)
def mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mismatch_report(_compared(spark, sf_dir))
