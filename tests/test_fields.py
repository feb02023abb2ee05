import json

import pytest
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.operators import config, fields, predict


def predictions(spark, rows):
    """Rows of {field: value}, with every other field missing."""
    columns = sorted({c for row in rows for c in row} - {"reasonings", "global_reasoning"})
    schema = "doc_id bigint, " + ", ".join(f"{c} string" for c in columns) + ", reasonings map<string,string>, global_reasoning string"
    data = [
        (i, *[row.get(c) for c in columns], row.get("reasonings"), row.get("global_reasoning"))
        for i, row in enumerate(rows)
    ]
    return predict.as_predictions(spark.createDataFrame(data, schema))


def resolve(spark, rows, mails=None):
    given = predictions(spark, rows)
    texts = spark.createDataFrame(
        [(i, m) for i, m in enumerate(mails or [""] * len(rows))], "doc_id bigint, email_text string"
    )
    signals = texts.select("doc_id", fields.mail_signals(F.col("email_text")).alias("signals"))
    return fields.resolve_fields(given.join(signals, "doc_id"))


def pairs(df):
    return [(r.scheme_type, r.scheme_subtype) for r in df.orderBy("doc_id").collect()]


def test_defaults_keep_blanks(spark):
    row = fields.with_defaults(predictions(spark, [{"vendor_name": "  ", "duration": " x "}])).first()
    assert row.vendor_name == "" and row.duration == "x" and row.scheme_name == "Unnamed Scheme"
    assert row.start_date == row.end_date == row.price_drop_date == "N/A"
    assert set(fixed.FIELD_DEFAULTS) == set(fixed.REASONING_OF)


DATES = {
    "2024-02-01": "01/02/2024", "2024-2-1": "01/02/2024", "1-2-2024": "01/02/2024", "01/02/2024": "01/02/2024",
    "99/99/9999": "99/99/9999", "1/2/2024": "01/02/2024", "31/02/2024": "31/02/2024", "31-02-2024": "31/02/2024",
    "5 Jan 2024": "05/01/2024", "05 january 2024": "05/01/2024", "5  Jan  2024": "05/01/2024", "January 5, 2024": "05/01/2024",
    "JAN 05, 2024": "05/01/2024", "May 5, 2024": "05/05/2024", "5 May 2024": "05/05/2024", "from 3/4/2024 on": "03/04/2024",
    "3-4-20245": "03/04/2024", "soon": "soon", "5 Foo 2024": "5 Foo 2024", "2024/02/01": "2024/02/01", "1/2/24": "1/2/24",
    "Feb 30, 2024": "Feb 30, 2024", "x 45/67/8901": "45/67/8901", "29 Feb 2024": "29/02/2024", "2023-02-29": "2023-02-29",
}


def test_dates(spark):
    from claimloom.functions.dates import standard_date

    df = spark.createDataFrame([(d,) for d in [*DATES, "Jan 5, 2024"]], "d string")

    def read(short_month_first):
        date = standard_date(F.col("d"), fixed.NO_DATE, "N/A", short_month_first)
        return {r.d: r.r for r in df.select("d", date.alias("r")).collect()}

    # Evaluation reads a short month only behind the day, unless the name is short itself.
    assert read(True) == {**DATES, "Jan 5, 2024": "05/01/2024"}
    assert read(False) == {**DATES, "Jan 5, 2024": "Jan 5, 2024", "JAN 05, 2024": "JAN 05, 2024"}


def test_no_dates(spark):
    df = spark.createDataFrame([("",), (None,), ("Not Found",), ("NONE",), ("n/a",)], "d string")
    assert {r[0] for r in df.select(fields.normalised_date(F.col("d"))).collect()} == {"N/A"}


def test_fixed_terms(spark):
    rows = [
        {"scheme_type": "SELL_SIDE", "scheme_subtype": "PDC"},
        {"scheme_type": "buy_side", "scheme_subtype": "periodic_claim"},
        {"scheme_type": "SELL_SIDE", "scheme_subtype": "BOC", "reasonings": {"scheme_subtype_reasoning": "why"}},
    ]
    got = fields.with_fixed_terms(fields.with_defaults(predictions(spark, rows))).orderBy("doc_id").collect()
    assert got[0].scheme_type == "PDC"
    assert (got[1].discount_slab_type, got[1].best_bet) == ("notApplicable", "FALSE")
    assert got[1].reasonings["best_bet_reasoning"] == fixed.BEST_BET_REASON
    assert got[2].scheme_subtype == "PUC"
    assert got[2].reasonings["scheme_subtype_reasoning"] == "(AUTO-CONVERTED FROM BOC) why"


def test_overrides_in_order(spark):
    mails = [
        "JBP and price drop", "Net   Inwards plan", "sorry for the delay", "one-off price drop", "Price Drop and exchange",
        "bumpup bup offer", "nothing", "xjbpx", "",
    ]
    rows = [{"scheme_type": "SELL_SIDE", "scheme_subtype": "PUC"} for _ in mails]
    rows[-1]["vendor_name"] = "TITAN Company"
    df = resolve(spark, rows, mails)
    assert pairs(df) == [
        ("BUY_SIDE", "PERIODIC_CLAIM"), ("BUY_SIDE", "PERIODIC_CLAIM"), ("SELL_SIDE", "LS"), ("OFC", "OFC"), ("PDC", "PDC"),
        ("SELL_SIDE", "PRX"), ("SELL_SIDE", "PUC"), ("SELL_SIDE", "PUC"), ("SELL_SIDE", "LS"),
    ]
    # A pair forced by the mail keeps its own slab terms.
    first = df.orderBy("doc_id").first()
    assert first.discount_slab_type == "Not Applicable" and first.best_bet == "Not Applicable"


def test_pair_check(spark):
    given = [("BUY_SIDE", "CP"), ("PDC", "CP"), ("OFC", "LS"), ("SELL_SIDE", "SC"), ("SELL_SIDE", "LS"), ("OTHER", "CP"), ("BUY_SIDE", "PERIODIC_CLAIM")]
    df = resolve(spark, [{"scheme_type": t, "scheme_subtype": s} for t, s in given])
    assert pairs(df) == [
        ("BUY_SIDE", "PERIODIC_CLAIM"), ("PDC", "PDC"), ("OFC", "OFC"), ("SELL_SIDE", "CP"), ("SELL_SIDE", "LS"),
        ("OTHER", "CP"), ("BUY_SIDE", "PERIODIC_CLAIM"),
    ]
    assert [r.pair_fixed for r in df.orderBy("doc_id").collect()] == [True, True, True, True, False, False, False]


def test_trace(spark):
    long = "x" * 50
    rows = [{
        "scheme_type": "SELL_SIDE", "scheme_subtype": "SC", "vendor_name": "Unknown Vendor", "model_name": " M1 ",
        "reasonings": {"scheme_type_reasoning": long, "vendor_name_reasoning": long, "duration_reasoning": "short"},
        "global_reasoning": "all in all",
    }]
    df = resolve(spark, rows, ["price drop"])
    trace = {r.field: (r.value, r.reasoning, r.confidence) for r in fields.field_trace(df).collect()}
    assert len(trace) == 31
    # The override changes value and reason; confidence is that of the prediction.
    assert trace["scheme_type"] == ("PDC", fixed.OVERRIDE_REASONS["price_drop"], "High")
    assert trace["scheme_subtype"] == ("PDC", fixed.OVERRIDE_REASONS["price_drop"], "Medium")
    assert trace["vendor_name"][2] == "Low" and trace["duration"] == ("Not Specified", "short", "Low")
    assert trace["model_name"] == ("M1", " M1 ", "Medium") and trace["extracted_fsns"] == ("None", None, "Medium")
    record = json.loads(fields.reasoning_json(df).first().reasoning)
    assert record["global_reasoning"] == "all in all" and record["scheme_type"]["value"] == "PDC"
    assert len(record) == 32


def test_pair_check_leaves_the_trace(spark):
    trace = fields.field_trace(resolve(spark, [{"scheme_type": "SELL_SIDE", "scheme_subtype": "SC"}]))
    assert trace.where("field = 'scheme_subtype'").first().value == "SC"


EXTRA = {
    ("PDC", "PDC"): {"fsn_file_config_file", "price_drop_date", "remove_gst_from_final_claim", "over_and_above"},
    ("OFC", "OFC"): {"max_cap", "remove_gst_from_final_claim", "brand_support_absolute", "gst_rate"},
    ("BUY_SIDE", "PERIODIC_CLAIM"): {"fsn_file_config_file", "remove_gst_from_final_claim", "over_and_above", "discount_slab_type", "best_bet"},
    ("BUY_SIDE", "PDC"): {"fsn_file_config_file", "price_drop_date", "remove_gst_from_final_claim", "over_and_above"},
    ("SELL_SIDE", "LS"): {"fsn_file_config_file", "min_actual_discount_or_agreed_claim", "over_and_above"},
    ("SELL_SIDE", "PUC"): {"fsn_file_config_file", "min_actual_discount_or_agreed_claim", "remove_gst_from_final_claim", "over_and_above"},
    ("SELL_SIDE", "CP"): {"fsn_file_config_file", "remove_gst_from_final_claim", "over_and_above"},
    ("OTHER", "CP"): {"fsn_file_config_file"},
}


def test_output_keys(spark):
    base = fields.with_defaults(predictions(spark, [{"duration": "x"}]))
    for (kind, subtype), extra in EXTRA.items():
        row = base.withColumns({"scheme_type": F.lit(kind), "scheme_subtype": F.lit(subtype)})
        output = json.loads(fields.output_fields(row).select(F.to_json("output")).first()[0])
        assert set(output) == set(fixed.ALWAYS_OUTPUT) | extra, (kind, subtype)


def test_responses_and_truncation(spark):
    df = spark.createDataFrame(
        [(1, '{"scheme_type": "OFC", "reasonings": {"a": "b"}}'), (2, "{broken"), (3, "{}")], "doc_id bigint, response string"
    )
    parsed = predict.parse_predictions(df)
    assert {r.doc_id: r.prediction_error is None for r in parsed.collect()} == {1: True, 2: False, 3: True}
    assert parsed.schema == predict.PREDICTION_SCHEMA
    assert {r.doc_id: r.looks_truncated for r in predict.truncated(parsed).collect()} == {1: False, 2: True, 3: True}


def test_predictor_runs_once_per_task(spark, tmp_path):
    def make():
        import pandas as pd

        return lambda batch: pd.DataFrame({"doc_id": batch["doc_id"], "scheme_name": batch["email_text"].str.upper()})

    inputs = spark.createDataFrame([(1, "a", "", ""), (2, None, "", "")], "doc_id bigint, email_text string, table_data string, xlsx_data string")
    got = predict.predict(inputs, make)
    assert {r.doc_id: r.scheme_name for r in got.collect()} == {1: "A", 2: None}
    assert got.schema == predict.PREDICTION_SCHEMA
    # Kept predictions are read from their table; the predictor is out of the plan.
    assert "MapInPandas" not in got._jdf.queryExecution().toString()


def test_periods(spark):
    given = [
        ("01/02/2024 to 10/02/2024; 11/02/2024 TO 20/02/2024", 2, None), ("single PERIOD", 1, None), ("", 1, None),
        ("1 october to 5 october", 1, "error"), ("weekly", 1, None), ("a to b;nothing", 1, None),
    ]
    df = spark.createDataFrame([(i, "s", "e", g[0]) for i, g in enumerate(given)], "doc_id bigint, start_date string, end_date string, sub_periods string")
    got = {}
    for r in config.with_periods(df).orderBy("doc_id", "period_no").collect():
        got.setdefault(r.doc_id, []).append((r.start_date, r.end_date, r.error))
    assert [len(got[i]) for i in range(6)] == [g[1] for g in given]
    assert got[0] == [("01/02/2024", "10/02/2024", None), ("11/02/2024", "20/02/2024", None)]
    assert got[3][0][2] is not None and got[4] == [("s", "e", None)] and got[5] == [("a", "b", None)]


def configs(spark, rows, enriched=None, codes=()):
    df = resolve(spark, rows)
    terms = F.struct(*[F.lit(v).alias(k) for k, v in enriched.items()]) if enriched else F.lit(None).cast(
        "struct<margin:string,dmrpType:string,dmrpValue:string,site_id:string>"
    )
    return config.with_config(
        config.with_periods(
            df.withColumns(
                {
                    "enriched": terms,
                    "stated_fsns": F.array(*[F.lit(c) for c in codes]).cast("array<string>"),
                    "code_set": F.lit(None).cast("string"),
                }
            )
        )
    )


def empty_sets(spark):
    return spark.createDataFrame([], "model_name string, row_idx bigint, fsn string, match string")


def records(spark, df, sets=None):
    rows = config.config_json(df, empty_sets(spark) if sets is None else sets).orderBy("doc_id", "period_no").collect()
    return [json.loads(r.config) for r in rows]


def test_config_shapes(spark):
    keys = {
        ("PDC", "PDC"): ["brandSupport", "maxQuantity", "priceDropDate", "maxSupportValue"],
        ("BUY_SIDE", "PERIODIC_CLAIM"): ["unitSlabLower", "unitSlabUpper", "brandSupport", "maxSupportValue", "bestBetQuantity"],
        ("SELL_SIDE", "CP"): ["brandSupport", "vendorSplitRatio"],
        ("SELL_SIDE", "PUC"): ["brandSupport", "vendorSplitRatio", "unitSlabLower", "unitSlabUpper", "maxSupportValue", "margin"],
        ("SELL_SIDE", "PRX"): ["incomingFsn", "vendorSplitRatio", "exchangeSlabFrom", "exchangeSlabTo", "agreedSupport"],
        ("SELL_SIDE", "LS"): ["unitSlabLower", "unitSlabUpper", "brandSupport", "vendorSplitRatio", "margin", "dmrpType", "dmrpValue", "maxSupportValue"],
    }
    got = records(spark, configs(spark, [{"scheme_type": t, "scheme_subtype": s} for t, s in keys]))
    for record, expected in zip(got, keys.values()):
        assert set(record["fields"]) == set(expected) | {"ProductId"}
        assert record["fields"]["ProductId"] == "Populate from FSN File"
    assert got[-1]["extraction_source"] == "LLM + Local Mapping" and got[-1]["site_id"] == "National"
    assert got[-1]["fields"]["dmrpType"] == "Manual - From DMRP File" and "site_id" not in got[0]


def test_config_without_fields(spark):
    df = configs(spark, [{"scheme_type": "OFC", "scheme_subtype": "OFC"}, {"scheme_type": "OTHER", "scheme_subtype": "CP"}])
    assert records(spark, df) == [
        {"info": "No FSN Config required for OFC"}, {"error": "Unknown scheme configuration for OTHER - CP"}
    ]
    bare = spark.range(1).select(config.config_type(F.lit("BUY_SIDE"), F.lit("XX")), config.config_type(F.lit("SELL_SIDE"), F.lit("SC")))
    assert tuple(bare.first()) == ("empty", "SS-SC")


def test_enrichment_and_fallbacks(spark):
    rows = [{"scheme_type": "SELL_SIDE", "scheme_subtype": "LS", "config_margin": "9", "config_max_support_value": "", "min_actual_discount_or_agreed_claim": "TRUE"}]
    terms = {"margin": "37", "dmrpType": "PERCENTAGE", "dmrpValue": "40", "site_id": "SITE_1"}
    (record,) = records(spark, configs(spark, rows, terms))
    assert record["site_id"] == "SITE_1"
    assert {k: record["fields"][k] for k in ("margin", "dmrpType", "dmrpValue", "maxSupportValue")} == {
        "margin": "37", "dmrpType": "PERCENTAGE", "dmrpValue": "40", "maxSupportValue": "TRUE"
    }


def test_products(spark):
    rows = [{"scheme_type": "SELL_SIDE", "scheme_subtype": "CP"}]
    (one,) = records(spark, configs(spark, rows, codes=["A" * 10]))
    (two,) = records(spark, configs(spark, rows, codes=["A" * 10, "A" * 10]))
    assert one["fields"]["ProductId"] == "A" * 10 and "products" not in one
    assert [p["ProductId"] for p in two["products"]] == ["A" * 10] * 2 and "fields" not in two


def test_large_code_sets_stay_rows(spark):
    sets = spark.createDataFrame([("m", i, f"F{i}", "exact") for i in range(5)], "model_name string, row_idx bigint, fsn string, match string")
    df = configs(spark, [{"scheme_type": "SELL_SIDE", "scheme_subtype": "CP"}]).withColumn("code_set", F.lit("m"))
    whole = json.loads(config.config_json(df, sets).first().config)
    assert [p["ProductId"] for p in whole["products"]] == [f"F{i}" for i in range(5)]
    named = json.loads(config.config_json(df, sets, limit=4).first().config)
    assert named["product_set"] == "m" and "products" not in named
    assert [r.product_id for r in config.product_rows(df, sets).orderBy("product_no").collect()] == [f"F{i}" for i in range(5)]
