"""SQL for the comparison database: the cleaning rules stated a second time.

Block removal uses windows and recursion here, where the operators work inside the row.
RE2 knows only ASCII word boundaries, so the patterns spell theirs out.
"""

from __future__ import annotations

from claimloom import fixed_values as fixed
from claimloom.functions.text import WHITE_SPACE

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def unicode_bounds(pattern: str) -> str:
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{NOT_WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|{NOT_WORD})"
    return pattern


def any_pattern(x: str, patterns: list[str], flags: str = "") -> str:
    return matches(x, flags + "|".join(f"(?:{unicode_bounds(p)})" for p in patterns))


def has_email(x: str) -> str:
    return matches(x, "(?i)" + fixed.EMAIL_ADDRESS)


CC_CONTINUES = f"({has_email('s')} or s like '%,' or s like '%;')"
ADDRESS_CONTINUES = f"({has_email('s')} or s like '%,' or s like '%;' or s like '%<%' or s like '%>%')"


def line_blocks(source: str, text: str, name: str, start: str, continues: str) -> list[tuple[str, str]]:
    """CTEs ending in ``name(doc_id, text, starts)``."""
    return [
        (
            f"{name}_lines",
            f"select doc_id, unnest(string_split({text}, chr(10))) as line, "
            f"generate_subscripts(string_split({text}, chr(10)), 1) as pos from {source}",
        ),
        (
            f"{name}_classes",
            f"select doc_id, pos, line, case when {matches('s', '(?i)' + start)} then 'H' "
            f"when {continues} then 'C' else 'N' end as c "
            f"from (select *, {strip('line')} as s from {name}_lines)",
        ),
        (
            f"{name}_marks",
            "select *, last_value(case when c <> 'C' then c end ignore nulls) "
            f"over (partition by doc_id order by pos rows unbounded preceding) as lead from {name}_classes",
        ),
        (
            name,
            "select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where lead is distinct from 'H'), '') as text, "
            f"count(*) filter (where c = 'H') as starts from {name}_marks group by doc_id",
        ),
    ]


def cc_blocks(source: str, text: str, name: str = "cc") -> list[tuple[str, str]]:
    return line_blocks(source, text, name, fixed.CC_LINE, CC_CONTINUES)


def address_blocks(source: str, text: str, name: str = "address") -> list[tuple[str, str]]:
    return line_blocks(source, text, name, fixed.ADDRESS_LINE, ADDRESS_CONTINUES)


def disclaimer_blocks(
    source: str,
    text: str,
    name: str = "block",
    markers: list[str] = fixed.BLOCK_MARKERS,
    endings: list[str] = fixed.BLOCK_ENDINGS,
) -> list[tuple[str, str]]:
    """CTEs ending in ``name(doc_id, text, blocks)``: one recursion step per block."""

    def first(x: str, patterns: list[str], flags: str) -> str:
        return "coalesce(" + ", ".join(
            f"nullif(regexp_extract({x}, {quoted(flags + p)}), '')" for p in patterns
        ) + ")"

    step = f"""
      select doc_id, round + 1, case when hit is null then text else
          substr(text, 1, strpos(text, hit) - 1) ||
          case when ending is null then '' else
            substr(after, 1 + length(regexp_extract(substr(after, 1, {fixed.SENTENCE_REACH}), '^[^.\\n]*[.\\n]'))) end end,
        hit is not null
      from (select *, substr(rest, strpos(rest, ending) + length(ending)) as after
        from (select *, {first('rest', endings, '(?i)')} as ending
          from (select *, substr(text, strpos(text, hit)) as rest
            from (select *, {first('text', markers, '(?is)')} as hit from {name}_rounds
              where more and round < {fixed.BLOCK_ROUNDS}))))"""
    return [
        (
            f"{name}_rounds(doc_id, round, text, more)",
            f"select doc_id, 0, {text}, true from {source} union all {step}",
        ),
        (
            name,
            "select doc_id, arg_max(text, round) as text, max(case when more then round else 0 end) as blocks "
            f"from {name}_rounds group by doc_id",
        ),
    ]


def paragraphs(source: str, text: str, name: str = "paragraphs") -> list[tuple[str, str]]:
    """CTE ``name(doc_id, paragraph_no, p)``."""
    split = f"string_split_regex({text}, '\\n\\s*\\n')"
    return [
        (
            name,
            "select doc_id, row_number() over (partition by doc_id order by i) as paragraph_no, p from "
            f"(select doc_id, i, {strip('part')} as p from "
            f"(select doc_id, unnest({split}) as part, generate_subscripts({split}, 1) as i from {source})) "
            "where p <> ''",
        )
    ]


LINES = f"list_filter(list_transform(string_split(p, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
ALIGNED = WORD + r"{2,}\s{3,}" + WORD + "{2,}"
IS_TABLE = f"""(len(list_filter({LINES}, lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2
  or (len({LINES}) > 1 and 2 * len(list_filter({LINES}, lambda l: {matches('l', ALIGNED)} or contains(l, chr(9)))) >= len({LINES})))"""
WITHOUT_EMAILS = f"regexp_replace(p, {quoted('(?i)' + fixed.EMAIL_ADDRESS)}, '', 'g')"
IS_PROTECTED = any_pattern(WITHOUT_EMAILS, fixed.PROTECTED_PATTERNS)
HEADER_LINES = f"len(list_filter({LINES}, lambda l: {' or '.join(matches('l', '(?i)' + h) for h in fixed.HEADER_PATTERNS)}))"
IS_HEADER = f"""({matches('p', '(?i)' + fixed.HEADER_PATTERNS[1])} or {matches('p', '(?i)' + fixed.HEADER_PATTERNS[2])}
  or case when len({LINES}) = 1 then {HEADER_LINES} = 1
     else 2 * {HEADER_LINES} >= len({LINES})
       or (len({LINES}) < 5 and len(list_filter({LINES}, lambda l: {matches('l', '(?i)' + fixed.METADATA_LINE)})) > 0) end)"""
IS_FOOTER = "(" + " or ".join(matches("p", "(?i)" + f) for f in fixed.FOOTER_PATTERNS) + ")"
KEYWORDS = (
    "list_filter([" + ", ".join(quoted(k) for k in fixed.DISCLAIMER_KEYWORDS) + "], lambda k: contains(lower(p), k))"
)
IS_DISCLAIMER = (
    f"(len({KEYWORDS}) >= {fixed.DISCLAIMER_KEYWORD_MINIMUM} or "
    + " or ".join(matches("p", "(?i)" + b) for b in fixed.BOILERPLATE_PATTERNS) + ")"
)


def classes(source: str = "paragraphs", name: str = "classes") -> list[tuple[str, str]]:
    """CTE ``name(doc_id, paragraph_no, p, class)``."""
    return [
        (
            name,
            f"select *, case when {IS_TABLE} then 'table' when {IS_PROTECTED} then 'protected' "
            f"when {IS_HEADER} then 'header' when {IS_FOOTER} then 'footer' "
            f"when {IS_DISCLAIMER} then 'disclaimer' else 'body' end as class from {source}",
        )
    ]


def cleaning(source: str = "mails", text: str = "raw_text") -> list[tuple[str, str]]:
    """CTEs from ``source`` to ``cleaned(doc_id, cleaned_text)`` with every step between."""
    return [
        *cc_blocks(source, text),
        *address_blocks("cc", "text"),
        *disclaimer_blocks("address", "text"),
        *paragraphs("block", "text"),
        *classes(),
        (
            "kept",
            "select doc_id, string_agg(p, chr(10) || chr(10) order by "
            "case when class in ('table', 'protected') then 0 else 1 end, paragraph_no) as cleaned_text "
            "from classes where class in ('table', 'protected', 'body') group by doc_id",
        ),
        (
            "cleaned",
            f"select s.doc_id, s.{text} as raw_text, coalesce(k.cleaned_text, '') as cleaned_text "
            f"from {source} s left join kept k on s.doc_id = k.doc_id",
        ),
    ]


def rounded(x: str, digits: int) -> str:
    return f"cast(format('{{:.{digits}f}}', {x}) as double)"
