import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import lookup


def fsn_mapping(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx bigint, model_name string, title string, fsn string")


def fields_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, model_name string, extracted_fsns string")


def test_stated_codes(spark):
    given = ["None", None, "", "ACCFGH1234567890;ACCFGH1234567890, short\nLONGENOUGH", "a b c", "NONE"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(lookup.stated_codes(F.col("v"))).collect()]
    assert got == [[], [], [], ["ACCFGH1234567890", "ACCFGH1234567890", "LONGENOUGH"], [], []]


def test_resolution(spark):
    mapping = fsn_mapping(spark, [
        ("Red Widget", "Acme red widget", "F2"), ("redwidget", "x", "F1"), ("blue", "RED  WIDGET", "F2"), ("small widget", None, "F3"), ("C++ (8GB)", "t", "F4"),
    ])
    given = fields_of(spark, [
        ("red widget", "None"), ("widget", None), ("red widget", "ABCDEFGHIJ"), ("n/a", "None"), ("zzz", "None"), ("", ""), ("c++ (8", "None"), ("E", "None"),
    ])
    sets = lookup.code_sets(given, mapping)
    listed = {}
    for r in sets.orderBy("model_name", "row_idx").collect():
        listed.setdefault(r.model_name, []).append((r.fsn, r.match))
    # Distinct codes in the order of the mapping; the partial match only without an exact one.
    assert listed["red widget"] == [("F2", "exact"), ("F1", "exact")]
    assert listed["widget"] == [("F2", "partial"), ("F1", "partial"), ("F3", "partial")]
    assert listed["c++ (8"] == [("F4", "partial")]
    assert [c for c, _ in listed["E"]] == ["F2", "F1", "F3"]
    assert set(listed) == {"red widget", "widget", "c++ (8", "E"}
    coded = {r.doc_id: (r.code_source, r.num_codes, r.code_set) for r in lookup.with_codes(given, sets).collect()}
    assert coded == {
        0: ("exact", 2, "red widget"), 1: ("partial", 3, "widget"), 2: ("mail", 1, None), 3: ("none", 0, None),
        4: ("none", 0, None), 5: ("none", 0, None), 6: ("partial", 1, "c++ (8"), 7: ("partial", 3, "E"),
    }


def test_mapping_without_titles(spark):
    mapping = fsn_mapping(spark, [("Red Widget", "x", "F2")]).drop("title")
    sets = lookup.code_sets(fields_of(spark, [("redwidget", "None")]), mapping)
    assert [(r.fsn, r.match) for r in sets.collect()] == [("F2", "exact")]


def test_contained_in_matches_brute_force(spark):
    rng = random.Random(3)
    letters = "aabc é😀"
    texts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(300)}
    needles = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(200)} | {"zzz", "z"}
    got = lookup.contained_in(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string")
    ).collect()
    assert sorted((r.needle, r.text) for r in got) == sorted((n, t) for n in needles for t in texts if n in t)


def test_contained_in_has_no_cross_join(spark):
    needles, texts = spark.createDataFrame([("ab",)], "needle string"), spark.createDataFrame([("abc",)], "text string")
    plan = lookup.contained_in(needles, texts)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("value, cleaned", [
    ("30%", "30"), ("0.3", "30"), ("DMRP is 40%", "40"), ("40.0%", "40"), ("12.50 %", "12.50"), ("-", "Not Specified"), ("", "Not Specified"),
    (None, "Not Specified"), ("NaN", "Not Specified"), ("250", "250"), ("250.0", "250"), ("1.25", "1.25"), ("0.125", "12"), ("0.375", "38"),
    ("0.285", "28"), ("5d", "5d"), ("1e3", "1000"), ("-4", "-4"), ("as agreed", "as agreed"), ("0", "0"), ("1", "1"), (" 7 ", "7"),
])
def test_percent(spark, value, cleaned):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(lookup.percent(F.col("v"))).first()[0] == cleaned


def test_brand_columns(spark):
    assert lookup.pick_column(["Description", "SC"], "SC") == "Description"
    mapping = spark.createDataFrame(
        [(0, " Indo Era ", "DMRP 40%", None, "S1"), (1, "Indo Era Kids", "250", "0.37", None)],
        "row_idx bigint, `BRAND ` string, `DMRP Details 24` string, `Margin %` string, SC string",
    )
    vendors = spark.createDataFrame([("IndoEra",), ("era k",), ("nobody",)], "vendor_name string")
    got = {r.vendor_name: (r.row_idx, r.margin, r.dmrpType, r.dmrpValue, r.site_id) for r in lookup.vendor_terms(vendors, mapping).collect()}
    assert got == {"IndoEra": (0, "Not Specified", "PERCENTAGE", "40", "S1"), "era k": (1, "37", "ABSOLUTE", "250", "National_Site")}


def test_only_known_lifestyle_vendors_are_enriched(spark):
    mapping = spark.createDataFrame([(0, "Titan", "40%", "10%", "S1")], "row_idx bigint, brand string, dmrp_details string, margin string, sc string")
    given = spark.createDataFrame(
        [(1, "SELL_SIDE", "LS", "TITAN"), (2, "SELL_SIDE", "CP", "Titan"), (3, "SELL_SIDE", "LS", "Unknown Vendor"), (4, "SELL_SIDE", "LS", "")],
        "doc_id bigint, scheme_type string, scheme_subtype string, vendor_name string",
    )
    got = {r.doc_id: r.enriched and r.enriched.margin for r in lookup.with_vendor_terms(given, mapping).collect()}
    assert got == {1: "10", 2: None, 3: None, 4: None}


def test_without_mappings(spark):
    mapping = fsn_mapping(spark, [("x", "y", "z")]).limit(0)
    given = fields_of(spark, [("red", "None")])
    coded = lookup.with_codes(given, lookup.code_sets(given, mapping)).first()
    assert (coded.code_source, coded.num_codes) == ("none", 0)
