"""Queries over token usage, cost and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.operators import usage
from claimloom.queries import fixtures as fx
from claimloom.queries import sql_text as sql
from claimloom.queries.fixtures import view
from claimloom.queries.registry import ctes, query


@query(
    ctes(
        ("messages", fx.MESSAGES),
        ("marked", """select *, length(text) as chars, max(case when role = 'assistant' then turn end) over (partition by conv_id) as last_turn from messages"""),
        ("sums", """select conv_id, cast(coalesce(sum(chars) filter (where turn is distinct from last_turn), 0) as bigint) as input_chars,
            cast(coalesce(sum(chars) filter (where turn = last_turn), 0) as bigint) as output_chars from marked group by conv_id"""),
        body="""select conv_id, input_chars // 4 as input_tokens, output_chars // 4 as output_tokens,
          input_chars + output_chars as total_chars, input_chars, output_chars from sums""",
    )
)
def message_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.message_usage(view(spark, sf_dir, fx.MESSAGES))


# Listed, prefixed, longer and unknown model names.
_NAMES = """select o_orderkey as doc_id, case o_orderkey % 7 when 0 then 'openrouter/qwen/qwen3-32b' when 1 then 'openai/gpt-4o-mini'
  when 2 then 'openrouter/anthropic/claude-3-haiku' when 3 then 'openai/gpt-4o-mini-2024' when 4 then 'my/qwen/qwen-2.5-7b-instruct:free'
  when 5 then 'openrouter/openai/gpt-4-turbo' else 'some/new-model' end as model,
  o_custkey % 5000 as input_tokens, o_orderkey % 900 as output_tokens from orders"""


def priced_as(model: str) -> str:
    listed = ", ".join(sql.quoted(m) for m in fixed.PRICES)
    short = model
    for prefix in fixed.PRICED_PREFIXES:
        short = f"replace({short}, '{prefix}', '')"
    partial = " ".join(f"when contains({model}, {sql.quoted(m)}) then {sql.quoted(m)}" for m in fixed.PRICES)
    return f"case when {model} in ({listed}) then {model} when {short} in ({listed}) then {short} {partial} else '{fixed.DEFAULT_PRICED_MODEL}' end"


PRICES = ("prices", "select * from (values " + ", ".join(
    f"('{m}', {i!r}::double, {o!r}::double)" for m, (i, o) in fixed.PRICES.items()
) + ") t(priced_as, in_price, out_price)")
COST = "input_tokens / 1e6 * in_price + output_tokens / 1e6 * out_price"


def costed(source: str) -> tuple[str, str]:
    return ("costed", f"select m.*, in_price, out_price, input_tokens + output_tokens as total_tokens, {COST} as cost "
            f"from (select *, {priced_as('model')} as priced_as from {source}) m join prices p on m.priced_as = p.priced_as")


@query(ctes(("names", _NAMES), PRICES, costed("names"), body="select doc_id, model, priced_as, in_price, out_price from costed"))
def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.with_prices(view(spark, sf_dir, _NAMES)).select("doc_id", "model", "priced_as", "in_price", "out_price")


@query(
    ctes(
        ("file_metrics", fx.FILE_METRICS), PRICES, costed("file_metrics"),
        body="select doc_id, status, model, input_tokens, output_tokens, total_tokens, round(cost, 9) as cost from costed",
    )
)
def file_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = usage.with_cost(view(spark, sf_dir, fx.FILE_METRICS))
    return costs.withColumn("cost", F.round("cost", 9))


_MEASURED = """select doc_id, text as prompt, source as response,
  case when doc_id % 3 = 0 then 0 when doc_id % 3 = 1 then doc_id + 10 else null end as input_tokens, doc_id % 50 as output_tokens from documents"""


@query(
    ctes(
        ("given", _MEASURED),
        body="""select doc_id, case when coalesce(input_tokens, 0) > 0 then input_tokens else length(prompt) // 4 end as input_tokens,
          case when coalesce(input_tokens, 0) > 0 then output_tokens else length(response) // 4 end as output_tokens from given""",
    )
)
def estimated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = view(spark, sf_dir, _MEASURED).withColumns({"p": F.length("prompt"), "r": F.length("response")})
    return usage.measured_or_estimated(given, "p", "r").select("doc_id", "input_tokens", "output_tokens")


def totals_sql(source: str) -> str:
    done = "filter (where status <> 'failed')"
    return f"""select total_files, successful, failed, total_input_tokens, total_output_tokens,
        total_input_tokens + total_output_tokens as total_tokens, {sql.rounded('c', 4)} as total_cost_usd,
        {sql.rounded('(total_input_tokens + total_output_tokens) / greatest(successful, 1)', 2)} as average_tokens_per_file,
        {sql.rounded('c / greatest(successful, 1)', 4)} as average_cost_per_file
      from (select count(*) as total_files, count(*) {done} as successful, count(*) filter (where status = 'failed') as failed,
        cast(coalesce(sum(input_tokens) {done}, 0) as bigint) as total_input_tokens,
        cast(coalesce(sum(output_tokens) {done}, 0) as bigint) as total_output_tokens,
        coalesce(sum(cost) {done}, 0.0) as c from {source})"""


@query(ctes(("file_metrics", fx.FILE_METRICS), PRICES, costed("file_metrics"), body=totals_sql("costed")))
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.batch_totals(usage.with_cost(view(spark, sf_dir, fx.FILE_METRICS)))


@query(
    ctes(
        ("file_metrics", fx.FILE_METRICS), PRICES, costed("file_metrics"),
        body="""select model, status, count(*) as files, cast(sum(total_tokens) as bigint) as tokens, round(sum(cost), 4) as cost
          from costed group by model, status""",
    )
)
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.with_cost(view(spark, sf_dir, fx.FILE_METRICS)).groupBy("model", "status").agg(
        F.count("*").alias("files"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost")
    )


# A document per order, read from a file, with its texts' lengths and some errors.
_ORDER_DOCUMENTS = """select o_orderkey as doc_id, concat('/in/', o_orderpriority, '/f', cast(o_orderkey as varchar(20)), '.pdf') as path,
  o_custkey % 9 + 1 as num_pages, case when o_orderstatus = 'F' then 'All extraction methods failed' end as error,
  o_orderkey * 3 as context_chars, concat(o_orderpriority, '_01022024_101112') as output_directory from orders"""
_ORDER_PERIODS = "select l_orderkey as doc_id, case when l_returnflag = 'R' then 'cannot split the periods' end as error from lineitem"
_ORDER_OUTPUT = "select o_orderkey as doc_id, length(o_orderpriority) as output_chars from orders"
_ORDER_USAGE = "select c_custkey as doc_id, c_custkey * 2 as input_tokens, c_custkey % 700 as output_tokens from customer"


@query(
    ctes(
        ("documents_of", _ORDER_DOCUMENTS), ("cells", fx.CELLS), ("stage_log", fx.STAGE_LOG), PRICES,
        ("counts", "select doc_id, count(distinct (source_page, table_idx)) as n from cells group by doc_id"),
        ("failures", f"select doc_id, max(error) as period_error from ({_ORDER_PERIODS}) group by doc_id"),
        ("spent", "select doc_id, sum(duration) as seconds from (select doc_id, arg_max(duration, ts) as duration from stage_log group by doc_id, stage) group by doc_id"),
        ("used", f"""select d.*, n, period_error, seconds, 'openai/gpt-4o' as model,
            case when coalesce(u.input_tokens, 0) > 0 then u.input_tokens else context_chars // 4 end as input_tokens,
            case when coalesce(u.input_tokens, 0) > 0 then u.output_tokens else output_chars // 4 end as output_tokens
          from documents_of d left join counts c on d.doc_id = c.doc_id left join failures f on d.doc_id = f.doc_id
            left join spent s on d.doc_id = s.doc_id join ({_ORDER_OUTPUT}) o on d.doc_id = o.doc_id left join ({_ORDER_USAGE}) u on d.doc_id = u.doc_id"""),
        costed("used"),
        ("judged", "select *, coalesce(error, period_error) as fault from costed"),
        body=f"""select doc_id, 'f' || doc_id || '.pdf' as file, case when fault is null then 'success' else 'failed' end as status, fault as error,
          num_pages as pages, coalesce(n, 0) as tables_extracted, case when fault is null then input_tokens end as input_tokens,
          case when fault is null then output_tokens end as output_tokens, case when fault is null then total_tokens end as total_tokens,
          case when fault is null then round(cost, 9) end as cost, model,
          case when seconds is not null then {sql.rounded('seconds', 2)} end as processing_time_seconds, output_directory from judged""",
    )
)
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimloom.plans import batch

    metrics = batch.file_metrics(
        view(spark, sf_dir, _ORDER_DOCUMENTS),
        view(spark, sf_dir, fx.CELLS),
        view(spark, sf_dir, _ORDER_PERIODS),
        view(spark, sf_dir, _ORDER_OUTPUT),
        "openai/gpt-4o",
        view(spark, sf_dir, _ORDER_USAGE),
        view(spark, sf_dir, fx.STAGE_LOG),
    )
    return metrics.withColumn("cost", F.round("cost", 9))


@query(
    ctes(
        ("stage_log", fx.STAGE_LOG),
        ("last", "select doc_id, stage, arg_max(duration, ts) as duration from stage_log group by doc_id, stage"),
        ("summed", "select *, sum(duration) over (partition by doc_id) as total from last"),
        body="select doc_id, stage, duration, case when total > 0 then round(duration / total * 100, 6) else 0.0 end as percent from summed",
    )
)
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stage_summary(view(spark, sf_dir, fx.STAGE_LOG), digits=6)
