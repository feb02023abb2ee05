"""Queries over product codes, brand terms and the products of a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.keys import own_key
from claimloom.operators import config, fields, lookup
from claimloom.queries import fields as field_queries
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query
from claimloom.session import durable

_STATED = """select doc_id, case doc_id % 5 when 0 then 'None' when 1 then 'ACCFGH1234567890;ACCFGH1234567891, short'
  when 2 then concat('ACCFGH1234567890 ACCFGH1234567890', chr(10), chr(9), 'LONGENOUGH') when 3 then '' else text end as extracted_fsns from documents"""


@query(
    ctes(
        ("given", _STATED),
        ("parts", r"""select doc_id, unnest(string_split_regex(extracted_fsns, '[;,\n\s]+')) as code,
           generate_subscripts(string_split_regex(extracted_fsns, '[;,\n\s]+'), 1) as i from given where lower(extracted_fsns) <> 'none'"""),
        body=f"""select doc_id, row_number() over (partition by doc_id order by i) as code_no, code
          from parts where length(code) >= {fixed.CODE_LENGTH}""",
    )
)
def stated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _STATED).select(
        "doc_id", F.posexplode(lookup.stated_codes(F.col("extracted_fsns"))).alias("pos", "code")
    ).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("code_no"), "code")


_MODELS = "select distinct model_name from ({}) p where model_name is not null".format(fx.PREDICTIONS)
_COLLAPSE = "lower(regexp_replace({}, '\\s+', '', 'g'))"

EXACT = f"""select m.model_name, f.fsn, min(f.row_idx) as row_idx from models m join fsn_mapping f
  on {_COLLAPSE.format('m.model_name')} in ({_COLLAPSE.format('f.model_name')}, {_COLLAPSE.format('f.title')}) group by m.model_name, f.fsn"""
PARTIAL = """select m.model_name, f.fsn, min(f.row_idx) as row_idx from models m join fsn_mapping f
  on contains(lower(f.model_name), lower(m.model_name)) or contains(lower(f.title), lower(m.model_name)) group by m.model_name, f.fsn"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, fx.PREDICTIONS).where("model_name is not null").select("model_name").distinct()


@query(ctes(("models", _MODELS), ("fsn_mapping", fx.FSN_MAPPING), body=EXACT))
def exact_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact_codes(_models(spark, sf_dir), view(spark, sf_dir, fx.FSN_MAPPING))


@query(ctes(("models", _MODELS), ("fsn_mapping", fx.FSN_MAPPING), body=PARTIAL))
def partial_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.partial_codes(_models(spark, sf_dir), view(spark, sf_dir, fx.FSN_MAPPING))


# Whole names, their words, brand numbers of two digits, and an absent needle, over all titles and texts of the benchmark.
_NEEDLES = """select distinct lower(p_name) as needle from part union select split_part(lower(p_name), ' ', 1) from part
  union select split_part(lower(p_name), ' ', 2) from part where p_name like '% %' union select split_part(p_brand, '#', 2) from part where p_brand like '%#%'
  union select 'zzz'"""
_TEXTS = "select distinct lower(text) as text from benchmark union select lower(concat(p_brand, ' ', p_name, ' ', p_type)) from part"


@query(
    ctes(
        ("needles", _NEEDLES), ("texts", _TEXTS),
        body="select needle, text from needles join texts on contains(text, needle)",
    )
)
def contained_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.contained_in(view(spark, sf_dir, _NEEDLES), view(spark, sf_dir, _TEXTS))


SETS = [
    ("fsn_mapping", fx.FSN_MAPPING),
    ("stated_lists", r"""select *, case when lower(extracted_fsns) = 'none' then [] else
        list_filter(string_split_regex(extracted_fsns, '[;,\n\s]+'), lambda c: length(c) >= 10) end as stated_fsns from resolved"""),
    ("models", """select distinct model_name from stated_lists where len(stated_fsns) = 0
        and lower(model_name) not in ('not specified', 'n/a', 'none') and model_name <> ''"""),
    ("exact_sets", EXACT),
    ("sets", f"""select *, 'exact' as match from exact_sets union all
        select *, 'partial' from ({PARTIAL.replace('from models m', 'from (select * from models where model_name not in (select model_name from exact_sets)) m')}) t"""),
    ("set_sums", """select model_name as code_set, count(*) as n, any_value(match) as match, arg_min(fsn, row_idx) as first_code,
        arg_max(fsn, row_idx) as last_code, cast(sum(row_idx) as bigint) as row_sum from sets group by model_name"""),
    ("coded", """select r.*, case when len(stated_fsns) > 0 then 'mail' when n > 0 then match else 'none' end as code_source,
        case when len(stated_fsns) > 0 then len(stated_fsns) else coalesce(n, 0) end as num_codes,
        case when len(stated_fsns) = 0 then s.code_set end as code_set, first_code, last_code, row_sum
      from stated_lists r left join set_sums s on len(r.stated_fsns) = 0 and r.model_name = s.code_set"""),
]


@query(
    ctes(*field_queries.RESOLVED, *SETS, body="select model_name, row_idx, fsn, match from sets")
)
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.code_sets(durable(field_queries.resolved(spark, sf_dir)), view(spark, sf_dir, fx.FSN_MAPPING))


def _coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Both are read several times further on.
    resolved = durable(field_queries.resolved(spark, sf_dir))
    sets = durable(lookup.code_sets(resolved, view(spark, sf_dir, fx.FSN_MAPPING)))
    return lookup.with_codes(resolved, sets), sets


@query(
    ctes(
        *field_queries.RESOLVED, *SETS,
        body="select doc_id, array_to_string(stated_fsns, ';') as stated_fsns, code_source, num_codes, code_set from coded",
    )
)
def resolved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = _coded(spark, sf_dir)
    return coded.select("doc_id", F.array_join("stated_fsns", ";").alias("stated_fsns"), "code_source", "num_codes", "code_set")


# --- brand terms ----------------------------------------------------------------------

_VALUES = """select doc_id, case doc_id % 16 when 0 then '30%' when 1 then 'DMRP is 40%' when 2 then '-' when 3 then '250'
  when 4 then '0.37' when 5 then '12.5%' when 6 then null when 7 then '40.0 %' when 8 then '0.285' when 9 then '5d'
  when 10 then 'NaN' when 11 then ' 7.0 ' when 12 then '1.25' when 13 then 'as agreed' when 14 then '0.125' else concat(cast(doc_id % 100 as varchar(9)), '.50 % of price') end as value
  from documents"""


def percent_sql(x: str) -> str:
    s = sql.strip(x)
    stated = f"regexp_extract({s}, '(\\d+(?:\\.\\d+)?)\\s*%', 1)"
    number = f"try_cast({s} as double)"
    return f"""case when {x} is null or {s} in ('', '-') or lower({s}) = 'nan' then 'Not Specified'
      when {stated} <> '' then case when cast({stated} as double) = floor(cast({stated} as double)) then cast(cast({stated} as double)::bigint as varchar) else {stated} end
      when not regexp_matches({s}, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') then {s}
      when {number} > 0 and {number} < 1 then cast(cast(format('{{:.0f}}', {number} * 100) as bigint) as varchar)
      when {number} = floor({number}) then cast({number}::bigint as varchar) else cast({number} as varchar) end"""


@query(ctes(("v", _VALUES), body=f"select doc_id, value, {percent_sql('value')} as cleaned from v"))
def percent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _VALUES).select("doc_id", "value", lookup.percent(F.col("value")).alias("cleaned"))


TERMS = [
    ("brand_mapping", fx.BRAND_MAPPING),
    ("terms", f"""select row_idx, brand, {percent_sql("coalesce(margin, 'Not Specified')")} as margin,
        case when contains(dmrp_details, '%') then 'PERCENTAGE' else 'ABSOLUTE' end as "dmrpType",
        {percent_sql('dmrp_details')} as "dmrpValue", {sql.strip('sc')} as site_id from brand_mapping"""),
]


@query(ctes(*TERMS, body="""select row_idx, brand, margin, "dmrpType", "dmrpValue", site_id from terms"""))
def brand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.brand_terms(view(spark, sf_dir, fx.BRAND_MAPPING))


_VENDORS = "select distinct vendor_name from ({}) p where vendor_name is not null and vendor_name <> 'Unknown Vendor'".format(fx.PREDICTIONS)
VENDOR_TERMS = f"""select vendor_name, min(case when rank = 1 then row_idx end) as row_idx,
    arg_min(brand, row_idx) as brand, arg_min(margin, row_idx) as margin, arg_min("dmrpType", row_idx) as "dmrpType",
    arg_min("dmrpValue", row_idx) as "dmrpValue", arg_min(site_id, row_idx) as site_id
  from (select v.vendor_name, t.*, dense_rank() over (partition by v.vendor_name order by {_COLLAPSE.format('brand')} <> {_COLLAPSE.format('vendor_name')}) as rank
    from vendors v join terms t on {_COLLAPSE.format('brand')} = {_COLLAPSE.format('vendor_name')} or contains(lower(brand), lower(vendor_name)))
  where rank = 1 group by vendor_name"""


@query(ctes(*TERMS, ("vendors", _VENDORS), body=VENDOR_TERMS))
def vendor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = view(spark, sf_dir, fx.PREDICTIONS).where(
        "vendor_name is not null and vendor_name <> 'Unknown Vendor'"
    ).select("vendor_name").distinct()
    return lookup.vendor_terms(vendors, view(spark, sf_dir, fx.BRAND_MAPPING))


ENRICHED = [
    *TERMS,
    ("vendors", """select distinct vendor_name from resolved where scheme_type = 'SELL_SIDE' and scheme_subtype = 'LS'
        and vendor_name <> '' and lower(vendor_name) not in ('unknown vendor', 'not specified', 'unknown')"""),
    ("vendor_terms", VENDOR_TERMS),
    ("enriched", """select r.*, t.margin as e_margin, t."dmrpType" as e_type, t."dmrpValue" as e_value, t.site_id as e_site from coded r
        left join vendor_terms t on r.vendor_name = t.vendor_name and r.scheme_type = 'SELL_SIDE' and r.scheme_subtype = 'LS'"""),
]


@query(
    ctes(
        *field_queries.RESOLVED, *SETS, *ENRICHED,
        body="""select doc_id, scheme_type, scheme_subtype, vendor_name, e_margin as margin, e_type as "dmrpType",
          e_value as "dmrpValue", e_site as site_id from enriched""",
    )
)
def enriched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = durable(field_queries.resolved(spark, sf_dir))
    enriched = lookup.with_vendor_terms(resolved, view(spark, sf_dir, fx.BRAND_MAPPING))
    return enriched.select("doc_id", "scheme_type", "scheme_subtype", "vendor_name", "enriched.*")


# --- products -------------------------------------------------------------------------

CONFIGS = [*ENRICHED, *field_queries.periods_sql("enriched"),
           ("configured", f"select *, {field_queries.CONFIG_TYPE} as config_type from periods")]


def _configs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    coded, sets = _coded(spark, sf_dir)
    enriched = lookup.with_vendor_terms(durable(coded), view(spark, sf_dir, fx.BRAND_MAPPING))
    return config.with_config(config.with_periods(enriched)), sets


@query(
    ctes(
        *field_queries.RESOLVED, *SETS, *CONFIGS,
        body="""select doc_id, cast(period_no as bigint) as period_no, num_periods, start_date, end_date, config_type, code_source,
          greatest(num_codes, 1) as num_products,
          case when len(stated_fsns) > 0 then stated_fsns[1] when code_set is null then 'Populate from FSN File' else first_code end as first_product,
          case when len(stated_fsns) > 0 then stated_fsns[len(stated_fsns)] when code_set is null then 'Populate from FSN File' else last_code end as last_product,
          case when code_set is not null then row_sum end as mapping_rows
        from configured where config_type not in ('info', 'empty', 'error') and error is null""",
    )
)
def config_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of each document and period, summed up per code set before they meet."""
    configs, sets = _configs(spark, sf_dir)
    sums = sets.groupBy(F.col("model_name").alias("code_set")).agg(
        F.min_by("fsn", "row_idx").alias("first_code"),
        F.max_by("fsn", "row_idx").alias("last_code"),
        F.sum("row_idx").alias("mapping_rows"),
    )
    stated = F.size("stated_fsns") > 0

    def product(position: int, looked_up: str) -> F.Column:
        return F.when(stated, F.try_element_at("stated_fsns", F.lit(position))).otherwise(
            F.coalesce(F.col(looked_up), F.lit(fixed.PRODUCT_PLACEHOLDER))
        )

    keyed = configs.where(config.has_products()).withColumn(
        "code_set", own_key(F.col("code_set").isNotNull(), F.col("code_set"), F.col("doc_id"))
    )
    return keyed.join(sums, "code_set", "left").select(
        "doc_id", "period_no", "num_periods", "start_date", "end_date", "config_type", "code_source",
        F.greatest("num_codes", F.lit(1).cast("bigint")).alias("num_products"),
        product(1, "first_code").alias("first_product"),
        product(-1, "last_code").alias("last_product"),
        "mapping_rows",
    )


@query(
    ctes(
        *field_queries.RESOLVED, *SETS, *CONFIGS,
        ("shaped", " union all ".join(
            f"select doc_id, period_no, num_periods, num_codes, code_set, len(stated_fsns) as stated, case when config_type = 'SS-LS' then coalesce(e_site, 'National') end as site_id, '{kind}' as config_type, "
            + "concat_ws(';', " + ", ".join(f"'{k}=' || ({v})" for k, v in sorted(shape.items())) + ") as fields from ("
            + "select * replace (e_margin as margin), e_type as dmrp_type, e_value as dmrp_value from (select *, null as margin from configured where error is null)) "
            + f"where config_type = '{kind}'"
            for kind, shape in field_queries.SHAPES.items()
        )),
        body="""select doc_id, cast(period_no as bigint) as period_no, config_type, site_id,
          case when greatest(num_codes, 1) > 1 then 'products' else 'fields' end as place, greatest(num_codes, 1) as num_products, fields from shaped""",
    )
)
def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration records read back from their JSON."""
    configs, sets = _configs(spark, sf_dir)
    text = config.config_json(configs, sets)
    record = "config_type string, site_id string, fields map<string,string>, products array<map<string,string>>"
    # As a row of its own, a record is made and read once for the filter and the columns behind it.
    read = text.select("doc_id", "period_no", F.inline(F.array(F.from_json("config", record)))).where("config_type is not null")
    one = F.coalesce("fields", F.try_element_at("products", F.lit(1)))
    shown = F.transform(
        F.array_sort(F.map_entries(F.map_filter(one, lambda k, _: k != "ProductId"))),
        lambda e: F.concat_ws("=", e["key"], e["value"]),
    )
    return read.select(
        "doc_id", "period_no", "config_type", "site_id",
        F.when(F.col("fields").isNull(), "products").otherwise("fields").alias("place"),
        F.coalesce(F.nullif(F.size("products"), F.lit(-1)), F.lit(1)).cast("bigint").alias("num_products"),
        F.array_join(shown, ";").alias("fields"),
    )


_WITH_PRODUCTS = "from configured where config_type not in ('info', 'empty', 'error') and error is null"


@query(
    ctes(
        *field_queries.RESOLVED, *SETS, *CONFIGS,
        ("keyed", f"select doc_id, cast(period_no as bigint) as period_no, code_set, stated_fsns {_WITH_PRODUCTS}"),
        body="""select doc_id, period_no, generate_subscripts(stated_fsns, 1) - 1 as product_no, unnest(stated_fsns) as product_id from keyed where len(stated_fsns) > 0
          union all select doc_id, period_no, 0, 'Populate from FSN File' from keyed where len(stated_fsns) = 0 and code_set is null
          union all select doc_id, period_no, row_idx, fsn from keyed join sets s on code_set = s.model_name""",
    )
)
def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product of every document and period, all codes of all sets."""
    return config.product_rows(*_configs(spark, sf_dir))


@query(ctes(*field_queries.RESOLVED, *SETS, body="select model_name as code_set, row_idx as product_no, fsn as product_id from sets"))
def product_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of products, once, as rows."""
    return config.set_rows(_coded(spark, sf_dir)[1])


@query(
    ctes(
        *field_queries.RESOLVED, *SETS, *CONFIGS,
        body=f"""select doc_id, cast(period_no as bigint) as period_no, code_set as product_set,
          case when len(stated_fsns) > 1 then array_to_string(stated_fsns, ';') end as products,
          case when len(stated_fsns) = 1 then stated_fsns[1] when len(stated_fsns) = 0 and code_set is null then 'Populate from FSN File' end as product {_WITH_PRODUCTS}""",
    )
)
def product_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration records that name their set of products, read back from their JSON."""
    text = config.config_json(*_configs(spark, sf_dir), inline=False)
    record = "config_type string, product_set string, fields struct<ProductId: string>, products array<struct<ProductId: string>>"
    read = text.select("doc_id", "period_no", F.from_json("config", record).alias("r")).where("r.config_type is not null")
    return read.select("doc_id", "period_no", "r.product_set", F.array_join("r.products.ProductId", ";").alias("products"), F.col("r.fields.ProductId").alias("product"))


@query(
    ctes(
        *field_queries.RESOLVED, *SETS,
        body="""select doc_id, num_codes, case when len(stated_fsns) > 0 then stated_fsns[1] else first_code end as first_code,
          case when len(stated_fsns) > 0 then stated_fsns[len(stated_fsns)] else last_code end as last_code, scheme_type, vendor_name from coded""",
    )
)
def output_with_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output records with their codes, read back from their JSON."""
    coded, sets = _coded(spark, sf_dir)
    text = config.output_json(fields.output_fields(coded), coded, sets)
    record = "scheme_type string, vendor_name string, resolved_fsns array<string>"
    return text.select("doc_id", F.from_json("output", record).alias("r")).select(
        "doc_id",
        F.size("r.resolved_fsns").cast("bigint").alias("num_codes"),
        F.try_element_at("r.resolved_fsns", F.lit(1)).alias("first_code"),
        F.try_element_at("r.resolved_fsns", F.lit(-1)).alias("last_code"),
        "r.scheme_type",
        "r.vendor_name",
    )
