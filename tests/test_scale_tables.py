"""Cells and lines of tables: one window, one move of the rows."""

import pathlib

from pyspark.sql import functions as F

from claimloom.functions import numbering
from claimloom.operators import layout, tables
from claimloom.plans import batch
from claimloom.queries import batches as batch_queries
from claimloom.queries import fixtures as fx
from claimloom.queries import layout as layout_queries
from claimloom.sources import readers


def test_cells_from_one_window(spark, sf_dir):
    """Both columns of the cells come from one numbering, with the rows of the SQL."""
    got, wanted = fx.cells(spark, sf_dir), fx.view(spark, sf_dir, fx.CELLS)
    assert got.dtypes == wanted.dtypes
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    got, wanted = layout_queries._own_names(spark, sf_dir), fx.view(spark, sf_dir, layout_queries._OWN_NAMES)
    assert got.dtypes == wanted.dtypes
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_numbers_over_ranges(spark, monkeypatch):
    """Groups over several ranges and batches, null groups among them, are numbered without a shuffle of the rows."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.col("id").alias("k")
    )
    plans = []
    durable = numbering.durable
    monkeypatch.setattr(numbering, "durable", lambda df: plans.append(durable(df)) or plans[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = numbering.numbered(rows, ["g"], ["k"], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: r.k):
        groups.setdefault(r.g, []).append(r.k)
    assert sorted((str(r.g), r.n, r.k) for r in got) == sorted((str(g), n, k) for g, ks in groups.items() for n, k in enumerate(ks))
    assert plans[0].select("_range").distinct().count() > 1 and "_opens" in plans[0].columns


def test_workbooks_rank_their_rows_once(spark):
    """Sizes and texts of workbooks come from the same sheets, ranked once."""
    rows = [(f"b{i % 3}", i % 2, f"S{i % 2}", i, f"r{i}") for i in range(300)]
    ranked = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            ranked.add(batch.num_rows)
            yield batch

    kinds = "file string, sheet_idx int, sheet string, row_idx int, row_text string"
    books = tables.workbook_texts(tables.sheet_texts(spark.createDataFrame(rows, kinds).mapInArrow(told, kinds))).collect()
    assert ranked.value == 300
    assert {r.file: (r.text.count("=== Sheet: "), r.text.count("[NOTE: ")) for r in books} == {"b0": (2, 0), "b1": (2, 0), "b2": (2, 0)}


def _counted(df, count):
    """``df`` through a task that adds its rows to an accumulator, each time they are made."""

    def told(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    return df.mapInArrow(told, df.schema)


CELLS = "doc_id bigint, source_page int, table_idx int, row_idx int, col_idx int, value string"


def test_pages_are_assembled_once(spark):
    """Elements are read for sizes and texts of pages, and not again for sizes and texts of documents."""
    rows = [(d, p, s, "char", 10.0, 100.0, f"t{d}{p}{s}" * 9) for d in range(9) for p in range(3) for s in range(4)]
    elements = spark.createDataFrame(rows, "doc_id bigint, page int, seq int, object_type string, x0 double, top double, text string")
    zones = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 150.0)], "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    counts = spark.createDataFrame([(d, 3) for d in range(9)], "doc_id bigint, num_pages bigint")
    seen = spark.createDataFrame([(20, 1, "seen")], "doc_id bigint, page int, text string")
    made = spark.sparkContext.accumulator(0)
    got = {r.doc_id: r.raw_text for r in layout.extracted(_counted(elements, made), zones, counts, seen).collect()}
    assert made.value <= 3 * len(rows)
    assert set(got) == {*range(9), 20} and got[20].endswith("seen")
    assert "--- Page 1 ---" not in got[1] and got[0].count("t0") == 3 * 4 * 9


def test_headers_of_documents(spark):
    """One pass over the header rows gives the names, and the places that the columns have in the document."""
    rows = [(1, 1, 0, 0, 0, "a"), (1, 1, 0, 0, 1, "a"), (1, 1, 0, 0, 2, "a_1"), (1, 1, 1, 0, 0, "b"), (1, 1, 1, 0, 1, "a"), (2, 1, 0, 0, 0, None), (None, 1, 0, 0, 0, "x")]
    rows += [(1, 1, 0, 1, c, f"v{c}") for c in range(3)] + [(1, 1, 1, 1, 1, None), (2, 1, 0, 1, 0, 'q"'), (None, 1, 0, 1, 0, "y"), (3, 1, 0, 1, 0, "no header")]
    cells = spark.createDataFrame(rows, CELLS)
    headers = tables.document_headers(cells)
    columns = tables.table_columns(cells).select("doc_id", "name", "place", "num_columns")
    assert sorted(headers.select(*columns.columns).distinct().collect()) == sorted(columns.collect())
    placed = tables.placed_cells(cells, headers)
    assert placed.count() == 5 and tables.table_cells(cells, placed).exceptAll(tables.table_cells(cells)).isEmpty()
    lines = tables.table_lines(cells, headers, placed)
    assert lines.exceptAll(tables.table_lines(cells)).isEmpty() and tables.table_lines(cells).exceptAll(lines).isEmpty()
    assert sorted(r.line for r in lines.collect()) == sorted(
        ["source_page,table_id,a,a_1,b", "1,p1_t1,v0,v2,", "1,p1_t2,,,", "source_page,table_id,col", '1,p1_t1,"q"""']
    )


def test_a_batch_makes_its_cells_once(spark, tmp_path):
    """Cells are made once for the lines, the sinks and what is written; a batch read back is the one that was written."""
    cells = spark.createDataFrame([(1, 1, 0, r, c, f"v{r}{c}") for r in range(3) for c in range(2)] + [(9, 1, 0, 0, 0, "h"), (9, 1, 0, 1, 0, "v")], CELLS)
    made = spark.sparkContext.accumulator(0)
    inputs = batch.Inputs(
        spark.createDataFrame([(1, "/a/f.pdf"), (2, "/a/g.pdf")], "doc_id bigint, path string"),
        spark.createDataFrame([(1, "Subject: x\n\nbody of 5 units\n\nRegards", 1)], "doc_id bigint, raw_text string, num_pages bigint"),
        _counted(cells, made),
        spark.createDataFrame([], "file string, sheet_idx int, sheet string, row_idx int, row_text string"),
        spark.createDataFrame([(1, "m", "F1")], "row_idx bigint, model_name string, fsn string"),
        spark.createDataFrame([], "row_idx bigint, brand string"),
    )
    prepared = batch.prepare(inputs, "m")
    path = str(tmp_path / "out")
    batch.write(prepared, path)
    assert made.value == cells.count()
    resumed = batch.resume(spark, path)
    texts = {r.doc_id: r for r in resumed.texts.collect()}
    assert texts == {r.doc_id: r for r in prepared.texts.select(*resumed.texts.columns).collect()}
    assert set(prepared.texts.columns) == set(resumed.texts.columns) and texts[1].raw_text.startswith("Subject") and texts[2].raw_text is None
    assert readers.read_table(spark, path, "cells", "csv", header="true").count() == 5
    mails = readers.read_table(spark, path, "context/documents").where("section = 'mail' and doc_id = 1").orderBy("line_no").collect()
    assert "\n".join(r.line for r in mails) == texts[1].cleaned_text
    files = [f.name for f in (tmp_path / "out").rglob("part-*")]
    assert any(f.endswith(".zstd.parquet") or f.endswith(".zst.parquet") for f in files) and not any("snappy" in f for f in files)


def test_a_resumed_batch_needs_no_intermediate_tables(spark, sf_dir, monkeypatch):
    """What the first stage kept for itself is deleted once it is written."""
    kept = []
    discard = batch.discard
    monkeypatch.setattr(batch, "discard", lambda done: kept.extend(done.scratch) or discard(done))
    rows = batch_queries.batch_of_given_predictions(spark, sf_dir)
    assert kept and not [f for f in kept if pathlib.Path(f).exists()]
    assert not rows.isEmpty()
