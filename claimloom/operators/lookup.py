"""Product codes and brand terms from the reference tables.

Both tables may be large and both sides may be skewed, so a lookup runs over the distinct
keys of the documents, nothing is broadcast by force, and results stay in rows: a set of
codes is stored once for a model and not once for every document that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import fixed_values as fixed
from claimloom.functions.keys import own_key
from claimloom.functions.text import collapse, strip
from claimloom.session import durable

GRAM = 3


def pick_column(columns: list[str], key: str) -> str | None:
    """The first column whose name contains ``key``, ignoring case."""
    return next((c for c in columns if key.lower() in c.lower()), None)


def brand_column(columns: list[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() == "brand"), None)


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one size."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: Bits of the table that tells which pieces any needle has; 2^_PIECE_BITS / 64 rows at most.
_PIECE_BITS = 22


def _marked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the place of their hash in a bit table: ``cell`` and ``bit``."""
    spot = F.xxhash64("gram").bitwiseAND((1 << _PIECE_BITS) - 1)
    return pieces.withColumns({"cell": F.shiftright(spot, 6), "bit": F.expr("shiftleft(1L, cast(xxhash64(gram) & 63 as int))")})


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, text) in which the text contains the needle.

    ``needles(needle)`` and ``texts(text)`` are distinct and not empty.  The index is built from
    the needles: a bit table of fixed size (1 MB) holds the hashes of their pieces, three letters
    each or a shorter needle itself, and is sent to every task.  Texts are read once, and of their
    pieces only those that some needle may have are written down and shuffled.  Each needle is
    then looked up by the one of its pieces that fewest texts hold: an equi join followed by the
    test, never a comparison of every pair.
    """
    needle_grams = durable(
        needles.select(
            "needle",
            F.explode(F.when(F.length("needle") >= GRAM, _grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))).alias("gram"),
        )
    )
    sizes = sorted(r[0] for r in needle_grams.select(F.length("gram")).distinct().collect())  # 1 to GRAM
    if not sizes:
        return needles.join(texts, needles["needle"] == texts["text"]).select("needle", "text")
    bits = _marked(needle_grams.select("gram")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    pieces = texts.select("text", F.explode(F.concat(*[_grams(F.col("text"), n) for n in sizes])).alias("gram"))
    wanted = _marked(pieces).join(F.broadcast(bits), "cell").where("(bits & bit) != 0").select("text", "gram")
    hits = durable(wanted)
    spread = hits.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = (
        needle_grams.join(spread, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    )
    return rarest.join(hits, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text")


# --- product codes --------------------------------------------------------------------


def stated_codes(extracted: Column) -> Column:
    """Codes named in the mail: parts of at least ten characters, duplicates kept."""
    parts = F.filter(
        F.transform(F.split(extracted, r"(?U)[;,\n\s\x1c-\x1f]+"), strip),
        lambda code: F.length(code) >= fixed.CODE_LENGTH,
    )
    none = extracted.isNull() | (F.lower(extracted) == "none")
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def wants_lookup(model: Column) -> Column:
    return model.isNotNull() & (model != "") & ~F.lower(model).isin(fixed.NO_MODEL)


def _mapping_names(mapping: DataFrame) -> DataFrame:
    """(name, row_idx, fsn) for the model name and the title, if there is one."""
    names = [c for c in ("model_name", "title") if c in mapping.columns]
    return mapping.select(
        F.explode(F.array(*names)).alias("name"), F.col("row_idx").cast("bigint").alias("row_idx"), "fsn"
    ).where(F.col("name").isNotNull())


def exact_codes(models: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes whose model name or title equals the model without regard to spaces and case.

    ``models(model_name)`` -> (model_name, row_idx, fsn), each code once, at its first row.
    """
    keyed = _mapping_names(mapping).select(collapse(F.col("name")).alias("key"), "row_idx", "fsn")
    return (
        models.select("model_name", collapse(F.col("model_name")).alias("key"))
        .join(keyed, "key")
        .groupBy("model_name", "fsn")
        .agg(F.min("row_idx").alias("row_idx"))
    )


def partial_codes(models: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes whose model name or title contains the model, ignoring case."""
    lowered = _mapping_names(mapping).select(F.lower("name").alias("text"), "row_idx", "fsn")
    needles = models.select(F.lower("model_name").alias("needle"))
    pairs = contained_in(
        needles.where(F.col("needle") != "").distinct(),
        lowered.where(F.col("text") != "").select("text").distinct(),
    )
    return (
        models.withColumn("needle", F.lower("model_name"))
        .join(pairs, "needle")
        .join(lowered, "text")
        .groupBy("model_name", "fsn")
        .agg(F.min("row_idx").alias("row_idx"))
    )


def code_sets(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Codes of every model that needs a lookup: (model_name, row_idx, fsn, match).

    The partial match serves only the models without an exact one.  Order by ``row_idx``.
    """
    models = (
        fields.where(wants_lookup(F.col("model_name")) & (F.size(stated_codes(F.col("extracted_fsns"))) == 0))
        .select("model_name")
        .distinct()
    )
    exact = exact_codes(models, mapping)
    rest = models.join(exact.select("model_name").distinct(), "model_name", "left_anti")
    return exact.withColumn("match", F.lit("exact")).unionByName(
        partial_codes(rest, mapping).withColumn("match", F.lit("partial"))
    )


def with_codes(fields: DataFrame, sets: DataFrame) -> DataFrame:
    """Add where a document's codes come from and how many there are.

    ``code_source`` is mail, exact, partial or none; ``code_set`` names the model under
    which ``code_sets`` lists them, ``stated_fsns`` holds those named in the mail.
    """
    summary = sets.groupBy("model_name").agg(
        F.count("*").alias("_found"), F.first("match").alias("_match")
    ).withColumnRenamed("model_name", "_key")
    stated = F.size("stated_fsns")
    key = own_key((stated == 0) & wants_lookup(F.col("model_name")), F.col("model_name"), F.col("doc_id"))
    return (
        fields.withColumn("stated_fsns", stated_codes(F.col("extracted_fsns")))
        .withColumn("_wanted", key)
        .join(summary, F.col("_wanted") == F.col("_key"), "left")
        .withColumn(
            "code_source",
            F.when(stated > 0, "mail").when(F.col("_found") > 0, F.col("_match")).otherwise("none"),
        )
        .withColumn("num_codes", F.when(stated > 0, stated).otherwise(F.coalesce("_found", F.lit(0))).cast("bigint"))
        .withColumn("code_set", F.when(F.col("_found") > 0, F.col("_key")))
        .drop("_wanted", "_key", "_found", "_match")
    )


# --- brand terms ----------------------------------------------------------------------


def percent(value: Column) -> Column:
    """Clean a percentage: "30%", "0.3" and "DMRP is 30%" all give "30"."""
    stripped = strip(value)
    stated = F.regexp_extract(stripped, r"(\d+(?:\.\d+)?)\s*%", 1)
    stated_whole = stated.rlike(r"^\d+(\.0+)?$")
    numeric = stripped.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    number = F.when(numeric, stripped.try_cast("double"))

    def whole(v: Column) -> Column:
        return v.try_cast("decimal(38,0)").cast("string")

    return (
        F.when(value.isNull() | (stripped == "") | (stripped == "-") | (F.lower(stripped) == "nan"), fixed.NOT_SPECIFIED)
        .when((stated != "") & stated_whole, whole(F.regexp_extract(stated, r"^\d+", 0)))
        .when(stated != "", stated)
        .when((number > 0) & (number < 1), whole(F.bround(number * 100, 0)))
        .when(number == F.floor(number), whole(number))
        .when(number.isNotNull(), number.cast("string"))
        .otherwise(stripped)
    )


def brand_terms(mapping: DataFrame) -> DataFrame:
    """(row_idx, brand, margin, dmrpType, dmrpValue, site_id) from a brand table.

    Columns are found by name: the brand column by its stripped name, the others by the
    first name that contains theirs.  The underscore and space spellings are the same.
    """
    columns = mapping.columns
    spelled = [c.replace("_", " ") for c in columns]

    def text(key: str, default: str) -> Column:
        name = pick_column(spelled, key)
        if name is None:
            return F.lit(default)
        value = F.col(f"`{columns[spelled.index(name)]}`").cast("string")
        return F.when(value.isNull() | (F.lower(value) == "nan"), default).otherwise(strip(value))

    brand = brand_column(columns)
    if brand is None:
        return mapping.select(
            F.col("row_idx").cast("bigint").alias("row_idx"),
            *[F.lit("").alias(c) for c in ("brand", "margin", "dmrpType", "dmrpValue", "site_id")],
        ).limit(0)
    details = text("DMRP Details", fixed.NOT_SPECIFIED)
    return mapping.select(
        F.col("row_idx").cast("bigint").alias("row_idx"),
        F.col(f"`{brand}`").cast("string").alias("brand"),
        percent(text("Margin", fixed.NOT_SPECIFIED)).alias("margin"),
        F.when(F.contains(details, F.lit("%")), "PERCENTAGE").otherwise("ABSOLUTE").alias("dmrpType"),
        percent(details).alias("dmrpValue"),
        text("SC", fixed.DEFAULT_SITE).alias("site_id"),
    ).where(F.col("brand").isNotNull())


ENRICHED = ["margin", "dmrpType", "dmrpValue", "site_id"]


def vendor_terms(vendors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Brand terms of each vendor: (vendor_name, row_idx, margin, dmrpType, ...).

    The first row whose brand equals the vendor without regard to spaces and case, else
    the first row whose brand contains the vendor.
    """
    terms = brand_terms(mapping)
    first = F.min_by(F.struct("row_idx", "brand", *ENRICHED), "row_idx").alias("row")
    exact = (
        vendors.withColumn("key", collapse(F.col("vendor_name")))
        .join(terms.withColumn("key", collapse(F.col("brand"))), "key")
        .groupBy("vendor_name")
        .agg(first)
    )
    rest = vendors.join(exact.select("vendor_name"), "vendor_name", "left_anti").withColumn(
        "needle", F.lower("vendor_name")
    )
    lowered = terms.withColumn("text", F.lower("brand"))
    pairs = contained_in(
        rest.where(F.col("needle") != "").select("needle").distinct(),
        lowered.where(F.col("text") != "").select("text").distinct(),
    )
    partial = rest.join(pairs, "needle").join(lowered, "text").groupBy("vendor_name").agg(first)
    return exact.unionByName(partial).select("vendor_name", "row.*")


def wants_terms(fields: DataFrame) -> Column:
    """Only lifestyle schemes of known vendors are enriched."""
    vendor = F.col("vendor_name")
    return (
        (F.col("scheme_type") == "SELL_SIDE")
        & (F.col("scheme_subtype") == "LS")
        & (vendor != "")
        & ~F.lower(vendor).isin(fixed.NO_VENDOR)
    )


def with_vendor_terms(fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``enriched``: struct<margin, dmrpType, dmrpValue, site_id>, NULL where none applies."""
    wanted = F.coalesce(wants_terms(fields), F.lit(False))
    vendors = fields.where(wanted).select("vendor_name").distinct()
    terms = vendor_terms(vendors, mapping).select(
        F.col("vendor_name").alias("_vendor"), F.struct(*ENRICHED).alias("enriched")
    )
    key = own_key(wanted, F.col("vendor_name"), F.col("doc_id"))
    return fields.withColumn("_wanted", key).join(terms, F.col("_wanted") == F.col("_vendor"), "left").drop(
        "_wanted", "_vendor"
    )
