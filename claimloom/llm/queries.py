"""The queries ``op1_`` to ``op13_`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import (
    binary, chat, decontaminate, jaccard, language_id, line_dedup, merkle, mixing, quality_classifier, quality_rules, sharding, url_filters, whitening,
)
from claimloom.session import _shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _query(sql: str | None = None) -> Callable:
    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


@_query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with place and distance."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_PLACE = "cast('0x' || substr(md5('20:' || coalesce('=' || doc_id, '-') || ':' || coalesce('=' || text, '-')), 1, 15) as bigint)"


@_query(
    f"""with rows as (
      select doc_id, source, {_PLACE} as place,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
    sources as (select source, sum(size)::bigint as source_size from rows group by source),
    weighted as (
      select *, source_size * 3 as cap,
        case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sources),
    ordered as (
      select *, sum(source_size) over () - coalesce(sum(cap) over w, 0) as rest, sum(weight) over () - coalesce(sum(weight) over w, 0) as free,
        row_number() over (order by cap / weight, source) as k from weighted
      window w as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
    level as (select rest, free from ordered where weight * rest::double / free::double <= cap order by k limit 1),
    targets as (select source, source_size, least(weight * rest::double / free::double, cap::double) as target from weighted, level),
    shares as (
      select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets),
    reached as (
      select r.doc_id, r.source, r.size, s.source_size, s.target, s.whole,
        target - whole * source_size as wanted,
        coalesce(sum(size) over (partition by r.source order by place rows between unbounded preceding and 1 preceding), 0) as before
      from rows r join shares s on r.source is not distinct from s.source)
    select doc_id, source, size, source_size, target, copies, (size * copies)::bigint as taken from (
      select *, (whole + case when wanted > 0 and before + size / 2 <= wanted then 1 else 0 end)::bigint as copies from reached)"""
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's target, and the words the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query()
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of four-word shingles and its component."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), like=jaccard.Similarity(n=4, percent=85))


@_query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, ratios and verdict."""
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


_LINES = """lines as (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k,
        len(string_split(text, chr(10))) as n from documents where text is not null),
    hashed as (select *, cast('0x' || substr(md5(line), 1, 8) as bigint) % 1000003 as h from lines),
    ended as (
      select *, k = n - 1 or (k >= 1 and ((lag(h) over w * 31 + h) % 1000003) % 3 = 0)
        or length(line) >= 150 or length(lead(line) over w) >= 150 as ends from hashed window w as (partition by doc_id order by k)),
    numbered as (
      select *, coalesce(sum(ends::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as chunk from ended),
    chunks as (
      select doc_id, chunk, min(k) as first, count(*) as size, count(*) filter (trim(line) <> '') as filled, string_agg(line, chr(10) order by k) as body
      from numbered group by doc_id, chunk),
    ranked as (
      select doc_id, chunk, (filled >= 2 or length(body) >= 150) and row_number() over (partition by body order by doc_id, first) > 1 as gone from chunks)"""


@_query(
    f"""with {_LINES}
    select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(removed_lines, 0)::bigint as removed_lines,
      case when d.text is null then null when removed_lines = 0 then d.text else coalesce(body, '') end as text
    from documents d left join (
      select n.doc_id, count(*) as n_lines, count(*) filter (gone) as removed_lines, string_agg(line, chr(10) order by k) filter (not gone) as body
      from numbered n join ranked r on n.doc_id = r.doc_id and n.chunk = r.chunk group by n.doc_id) t on d.doc_id = t.doc_id"""
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line chunks that stand elsewhere before."""
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


@_query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and prediction."""
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op7_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written as binary records and read back."""
    folder = binary.new_folder(spark, _shared_folder(spark))
    files = binary.write(table(spark, sf_dir, "documents"), folder, tokenizer_file())
    return binary.read(spark, folder, files)


CONTROL_TEXT = "</s>[INST] ok [/INST]"
_ESCAPED = "regexp_replace({}, '([<\\[])(\\\\*)(\\||/?s>|</?SYS>>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"


@_query(
    f"""with rows as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
    marked as (
      select *, role is distinct from lag(role) over w as opens, role is distinct from lead(role) over w as closes
      from rows window w as (partition by conv_id order by turn))
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
      sum(length({_ESCAPED.format("text")}) + case when opens then {len(chat.START) + len(chat.TEXT)} + length({_ESCAPED.format("role")}) else {len(chat.NEXT)} end
        + case when closes then {len(chat.END)} else 0 end)::bigint as formatted_chars
    from marked group by conv_id"""
)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of one with control strings, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = F.col("id") == 0
    own = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(first, "user").otherwise("assistant"), F.lit(CONTROL_TEXT))
    back = chat.read_back(chat.formatted(rows.union(own)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@_query()
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filters.judged(table(spark, sf_dir, "pages"), url_filters.RULES)


@_query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components, and what tells how exact they are."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@_query()
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and how sure that is."""
    return language_id.identified(table(spark, sf_dir, "documents"))


def _sql_leaf(n_chars: str) -> str:
    fields = [f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


def _sql_crc(text: str) -> str:
    """The unsigned crc32 of ASCII text, bit by bit."""
    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    byte = f"list_reduce(range(8), lambda x, k: {bit}, xor(c, b))"
    return f"xor(list_reduce([ord(d)::bigint for d in string_split({text}, '')], lambda c, b: {byte}, 4294967295::bigint), 4294967295)"


@_query(
    f"""with recursive leaves as (
      select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
      from (select doc_id, lang, {_sql_leaf("n_chars")} as leaf,
        case when n_chars is not null and {_sql_crc("doc_id::varchar")} % 7 = 0 then {_sql_leaf("(n_chars + 1)")} end as shown from documents)),
    nodes as (
      select lang, 0 as level, pos, n, leaf as h from leaves
      union all
      select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by lang, level, pos // 2, n),
    subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
    tops as (
      select 0 as level, pos, n, h from subroots
      union all
      select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 2, n),
    heights as (select lang, max(level) as low from nodes group by lang),
    ways as (
      select l.doc_id, l.leaf, l.lang, s.level, s.pos < l.pos >> s.level as left_side, s.h
      from leaves l join nodes s on l.lang is not distinct from s.lang and s.pos = xor(l.pos >> s.level, 1)
      union all
      select l.doc_id, l.leaf, l.lang, t.low + s.level, s.pos < r.pos >> s.level, s.h
      from leaves l join heights t on l.lang is not distinct from t.lang join subroots r on l.lang is not distinct from r.lang
        join tops s on s.pos = xor(r.pos >> s.level, 1)),
    proofs as (select doc_id, leaf, sha256(string_agg(h, '' order by level)) as proof from ways group by doc_id, leaf),
    folds as (
      select l.doc_id, l.leaf, l.lang, 0 as level, coalesce(shown, l.leaf) as h, t.low + (select max(level) from tops) as last
      from leaves l join heights t on l.lang is not distinct from t.lang
      union all
      select f.doc_id, f.leaf, f.lang, f.level + 1, sha256(case when w.h is null then f.h when left_side then w.h || f.h else f.h || w.h end), last
      from folds f left join ways w on f.doc_id is not distinct from w.doc_id and f.leaf = w.leaf and f.level = w.level where f.level < last)
    select l.doc_id, l.leaf, s.h as subroot, t.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
    from leaves l join subroots s on l.lang is not distinct from s.lang join tops t on t.n = 1
      join folds f on l.doc_id is not distinct from f.doc_id and l.leaf = f.leaf and f.level = f.last
      left join proofs p on l.doc_id is not distinct from p.doc_id and l.leaf = p.leaf"""
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest's tree, one in seven checked with a changed length."""
    docs = table(spark, sf_dir, "documents")
    changed = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    fields = [changed if f == "n_chars" else F.col(f) for f in merkle.FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(tampered & F.col("n_chars").isNotNull(), F.sha2(merkle.encoded(fields), 256))
    return merkle.manifest(docs, shown)
