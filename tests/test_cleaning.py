import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import plain_rules as plain
from claimloom import fixed_values as fixed
from claimloom.functions.normalise import foreign_pattern, normalise
from claimloom.functions.text import first_lines, strip, without_emails
from claimloom.operators import clean
from claimloom.queries import sql_text as sql
from claimloom.queries.registry import ctes

PIECES = [
    "Cc: a@b.com,", "cc :x", "CC:", "From: Bob <bob@x.org>", "To: y", " to : z;", "next@line.de", "one,", "two;", "a<b", "c>d",
    "", "", "  ", "\t", "plain words here", "Regards", "the claim is due", "Claim", "éclaim", "claimé", "xclaim", "order-12", "a.b@c.dd12%",
    "5%", "5 . %", "12.5 %", "1.2.3%", "100 units", "7kgs", "1/2/24", "10:30 AM", "ABC-123", "ABCDE-123", "₹ 5", "$x", "po #", "po#1",
    "| a | b |", "|x|", "ab   cd", "a   b", "col\tcol", "---- Forwarded message ----", "On Monday", "John wrote:", "On 5 May Bob wrote :",
    "Subject: hi", "Sent: x", "Date: y", "x@y.zz on Friday", "\"Al B\" <al@b.co>", "01/02/2024, 10:30 pm", "https://mail.google.com/mail/u/0",
    "[quoted TEXT hidden]", "1/3", "22/7 ", "Click here to unsubscribe", "confidential", "the recipient", "liability", "damages and viruses",
    "mutations in their transfer", "Do not reply to this EMAIL", "on behalf of the X group", "intended solely for the addressee",
    "This e-mail message may contain confidential", "This email is", "it is confidential so", "legally protected.", "strictly prohibited",
    "STRICTLY PROHIBITED by law. More", "personally liable for any damages or so", "Any views or opinions presented in this email",
    "This message contains confidential information", "本电子邮件及其附件含有一些保密信息", "actions taken on the basis of the information provided", " x ",
    "a​b", "😀 smile", "ｆｕｌｌ", "soft­hyphen", "on", "On a day, and", "wrote", "al@b.co.at", "éa@b.com at", "..@b.com on", "é.@b.com on", "a.b_%@c.d-e.com2 pm", "<a@b.com>", "'x y' <q@r.st>",
    "on behalf of the", "the group", "legally", "This email and any files transmitted",  "line sep", "no-sign-" + "x" * 30, "o" * 40 + "@", "a@b.com_x@c.de y", "İstanbul",
]


def random_texts(count, seed):
    rng = random.Random(seed)
    joins = ["\n", "\n", "\n\n", " ", "\n \n", ". "]
    texts = []
    for _ in range(count):
        parts = [rng.choice(PIECES) for _ in range(rng.randint(1, 14))]
        texts.append("".join(p + rng.choice(joins) for p in parts))
    return texts


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(random_texts(4000, 7)))
    return spark.createDataFrame(rows, "doc_id bigint, raw_text string").repartition(4)


def compare(df, column, expected):
    wrong = [
        (row.raw_text, row[column], expected(row.raw_text))
        for row in df.select("raw_text", column).collect()
        if row[column] != expected(row.raw_text)
    ]
    assert not wrong, wrong[:3]


def test_only_texts_that_nfkc_may_change_go_to_python(spark):
    usual = ["\u20b9 500 \u2013 10 %", "caf\u00e9, na\u00efve, Stra\u00dfe", "\u201cquoted\u201d \u2014 it\u2019s", "Привет", "\u6f22\u5b57\u304b\u306a", "plain"]
    changed = ["a\u00a0b", "e\u0301", "\ufb01ne", "\u00bd", "\u2026", "\u1100\u1161", "\u304b\u3099", "q\u0323\u0307", "\u2122", "\u212b"]
    df = spark.createDataFrame([(x,) for x in usual + changed], "t string")
    foreign = {r[0] for r in df.where(F.col("t").rlike(foreign_pattern())).collect()}
    # Beyond the accented Latin letters nothing is looked at.
    assert foreign == set(changed) | {usual[k] for k in (0, 2, 3, 4)}
    rng = random.Random(5)
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, rng.choices(codes, k=3))) for _ in range(20_000)] + [f"a{chr(c)}" for c in codes[:0x3000]]
    kept = spark.createDataFrame([(x,) for x in texts], "t string").where(~F.col("t").rlike(foreign_pattern())).collect()
    assert kept and all(unicodedata.is_normalized("NFKC", r[0]) for r in kept)


def test_normalise(texts):
    compare(texts.withColumn("r", normalise(F.col("raw_text"))), "r", plain.normal)


@pytest.mark.parametrize("spark_rule, plain_rule", [
    (clean.without_cc_blocks, plain.without_cc),
    (clean.without_address_blocks, plain.without_addresses),
])
def test_line_blocks(texts, spark_rule, plain_rule):
    result = texts.withColumn("s", spark_rule(F.col("raw_text"))).withColumn(
        "r", F.struct("s.text", "s.starts")
    )
    wrong = [r for r in result.collect() if tuple(r.r) != plain_rule(r.raw_text)]
    assert not wrong, wrong[:3]


def test_disclaimer_blocks(texts):
    result = texts.withColumn("r", clean.without_disclaimer_blocks(F.col("raw_text"))).collect()
    wrong = [r for r in result if (r.r.text, r.r.blocks) != plain.without_disclaimers(r.raw_text)]
    assert not wrong, wrong[:3]
    assert sum(r.r.blocks > 0 for r in result) > 100


def test_more_than_ten_blocks(spark):
    text = "This e-mail message may contain confidential x strictly prohibited. " * 13
    df = spark.createDataFrame([(text,)], "raw_text string")
    row = df.select(clean.without_disclaimer_blocks(F.col("raw_text")).alias("r")).first().r
    assert (row.text, row.blocks) == plain.without_disclaimers(text) and row.blocks == 10


#: For each rule, paragraphs it takes and paragraphs it leaves.
CASES = {
    "is_table": (
        ["| a | b |\n| c | d |", "ab   cd\nplain", "col\tcol\nx", "ab   cd\n\nef\tgh\nx\ny"],
        ["| a | b |", "| a | b |\n| c", "ab   cd\nx\ny", "a   b\nc   d", "ab   cd", "plain words"],
    ),
    "is_protected": (
        ["the claim is due", "po #", "order-12", "5%", "12.5 %", "7kgs", "100 units", "1/2/24", "10:30 AM", "ABC-123", "\u20b9 5", "total  amount"],
        ["Claim", "\u00e9claim", "claim\u00e9", "xclaim", "ABCDE-123", "$x", "10:30 am", "price@shop.com", "plain words here"],
    ),
    "is_header": (
        ["Subject: hi", "sent : x", "---- Forwarded message ----", "hello\nOn 5 May Bob wrote :\nmore\nmore", "From: x\ny\nz", "Cc: x\ny\nz",
         "From: x\nTo: y\nSent: z\nd\ne", '"Al B" <al@b.co>', "x@y.zz on Friday", "01/02/2024, 10:30 pm"],
        ["x\ny\nz", "Cc: x", "From: x\nb\nc\nd\ne", "John wrote:", "On Monday", "x@y.zz Friday", "plain words"],
    ),
    "is_footer": (
        ["1/3", "[quoted TEXT hidden]", "Click here to unsubscribe", "to manage preferences", "at https://mail.google.com/mail/u/0"],
        ["see 1/3", "1/3 of it", "1/2/24", "mail.google.com", "quoted text hidden"],
    ),
    "is_disclaimer": (
        ["Confidential recipient LIABILITY", "mutations in their transfer, an error", "Do not reply to this EMAIL", "on behalf of the X group", "a system generated note"],
        ["confidential recipient", "confidential confidential confidential", "on behalf of the team", "plain words"],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_paragraph_rules(spark, name):
    taken, left = CASES[name]
    df = spark.createDataFrame([(x, True) for x in taken] + [(x, False) for x in left], "p string, expected boolean")
    wrong = df.withColumn("got", getattr(clean, name)(F.col("p"))).where("got <> expected").collect()
    assert not wrong, wrong


def test_first_rule_that_applies(spark):
    expected = {
        "| claim | b |\n| From: x | d |": "table", "From: the claim": "protected", "From: x\n1/3": "header",
        "Click here to unsubscribe, confidential recipient liability": "footer", "confidential recipient liability": "disclaimer", "bye": "body",
    }
    df = spark.createDataFrame([(x,) for x in expected], "p string")
    assert {r.p: r.c for r in df.select("p", clean.paragraph_class(F.col("p")).alias("c")).collect()} == expected


def test_random_texts_against_sql(texts):
    """Whole cleaning, and the class of every paragraph, as the comparison SQL states them."""
    plain_texts = texts.where(r"raw_text rlike '^[\\x00-\\x7f]*$'")
    given = plain_texts.toPandas()  # noqa: F841
    query = ctes(
        ("mails", "select doc_id, raw_text from given"), *sql.cleaning(),
        body="""select c.doc_id, cleaned_text, coalesce(classes, []) as classes from cleaned c left join
          (select doc_id, list(class order by paragraph_no) as classes from classes group by doc_id) l on c.doc_id = l.doc_id""",
    )
    expected = {r[0]: (r[1], r[2]) for r in duckdb.sql(query).fetchall()}
    got = clean.clean(plain_texts).select("doc_id", "raw_text", "cleaned_text", F.col("paragraphs.class").alias("classes")).collect()
    assert len(got) == len(expected) > 500
    wrong = [(r.raw_text, r.cleaned_text, r.classes, expected[r.doc_id]) for r in got if (r.cleaned_text, r.classes) != expected[r.doc_id]]
    assert not wrong, wrong[:2]


def test_without_emails(texts):
    compare(texts.withColumn("r", without_emails(F.col("raw_text"))), "r", lambda t: plain.EMAIL.sub("", t))


@pytest.mark.parametrize("text, cleaned", [
    ("word​word", "wordword"), ("auto­matic", "automatic"), ("text\x00null", "textnull"),
    ("₹25,000", "₹25,000"), ("Café", "Café"), ("a‑b c", "a‐b c"), ("", ""),
])
def test_unicode_pairs(spark, text, cleaned):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalise(F.col("t"))).first()[0] == cleaned


def test_order_and_case(spark):
    text = "just words\n\nthe claim is due\n\nClaim\n\n1/3\n\nlast words"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, raw_text string")
    cleaned = {r.doc_id: r.cleaned_text for r in clean.clean(df).collect()}
    # Protected paragraphs come first, and the words that protect are lower case.
    assert cleaned == {1: "the claim is due\n\njust words\n\nClaim\n\nlast words", 2: "", 3: ""}


def test_audit(spark):
    text = "Cc: a@b.co\nFrom: x\n\n1/3\n\nSubject: hi\n\nthe claim\n\n| a | b |\n| c | d |\n\nconfidential recipient liability\n\nbye"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, raw_text string")
    row = clean.audit_counts(clean.with_paragraphs(df)).first()
    assert (row.removed, row.retained, row.protected, row.tables_protected) == (5, 4, 1, 1)
    report = clean.keyword_report(clean.with_paragraphs(df)).collect()
    assert [r.keywords_found for r in report] == [["confidential", "liability", "recipient"]]


def test_long_lines_stay_linear(spark):
    """Long runs that invite backtracking finish quickly."""
    runs = [
        "9" * 200_000, "x" * 200_000 + "@", "-" * 200_000, "\n" * 100_000, "a@" * 50_000, "On " * 30_000 + "\nwrote:",
        "x.y" * 50_000 + "@", "x@y.zz; " * 30_000, "a" + " " * 100_000 + "@", "on behalf of the " * 20_000, "This email confidential " * 20_000,
        "This email " * 20_000 + "confidential", "Cc:\n" * 30_000, "From: x,\n" * 30_000, "a\t" * 50_000, "5" + " " * 100_000,
    ]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id bigint, raw_text string")
    assert clean.clean(df).select(F.sum(F.length("cleaned_text"))).first()[0] > 0


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\nb\n", "a\nb\n\n", "a\r\nb\rc", "a\x0bb\x0cc", "a b\x85c", "\n\n\n"])
@pytest.mark.parametrize("limit", [1, 2, 3])
def test_first_lines(spark, text, limit):
    lines = text.splitlines()
    expected = "\n".join(lines[:limit]) + "\n..." if len(lines) > limit else text
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(first_lines(F.col("t"), limit, "...")).first()[0] == expected


def test_strip(spark):
    samples = ["\x1c a \x85", " b　", " \t\n", "c​"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [s.strip() for s in samples]


def test_size_statistics(spark):
    df = spark.createDataFrame([("x" * 20000, "y" * 17531), ("", ""), (None, None)], "a string, b string")
    rows = df.select(*clean.size_statistics(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [
        (20000, 17531, 2469, round(2469 / 20000 * 100, 2)), (0, 0, 0, 0.0), (0, 0, 0, 0.0)
    ]


def test_fixed_patterns_all_used():
    from claimloom.operators.clean import DIGIT_FORMS

    assert set(DIGIT_FORMS) <= set(fixed.PROTECTED_PATTERNS)
