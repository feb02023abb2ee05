"""The boundary to a user-supplied predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom import fixed_values as fixed
from claimloom.session import durable

PREDICTION_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in fixed.FIELD_DEFAULTS]
    + [T.StructField("reasonings", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("global_reasoning", T.StringType())]
    # Why there is no prediction; NULL where there is one.
    + [T.StructField("prediction_error", T.StringType())]
)

# Batch of inputs -> batch of predictions with the columns of PREDICTION_SCHEMA.
Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def predict(inputs: DataFrame, make_predictor: Callable[[], Predictor], keep: bool = True) -> DataFrame:
    """Predict from (doc_id, email_text, table_data, xlsx_data).

    ``make_predictor`` runs once per task, so a client or model is opened where it is used.
    Columns the predictor leaves out are NULL, and a document it leaves out gets a
    ``prediction_error``.  If it fails on a batch, or answers for documents it was not given
    or twice for one, each half of the batch goes through it again, down to the documents
    at fault, which get a ``prediction_error``.  With ``keep`` the predictions are written to the shared folder: a costly predictor must not
    run again for every sink.
    """
    names = PREDICTION_SCHEMA.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()

        def complete(found: pd.DataFrame) -> pd.DataFrame:
            absent = {name: None for name in names if name not in found.columns}
            return found.assign(**absent)[names]

        def failed(documents: pd.DataFrame, why: str) -> pd.DataFrame:
            return complete(documents[["doc_id"]].assign(prediction_error=why))

        def answered(documents: pd.DataFrame) -> pd.DataFrame:
            found = complete(predictor(documents))
            got, sent = found["doc_id"].value_counts(), documents["doc_id"].value_counts()
            if (got > sent.reindex(got.index, fill_value=0)).any():
                raise ValueError("unknown or repeated documents in the answer")
            return found

        def answers(documents: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                found = answered(documents)
            except Exception as error:
                if len(documents) < 2:
                    yield failed(documents, f"{type(error).__name__}: {error}")
                else:
                    half = len(documents) // 2
                    yield from answers(documents.iloc[:half])
                    yield from answers(documents.iloc[half:])
            else:
                yield found
                absent = documents[~documents["doc_id"].isin(found["doc_id"])]
                if len(absent):
                    yield failed(absent, "no prediction")

        for batch in batches:
            yield from answers(batch)

    predictions = inputs.select("doc_id", "email_text", "table_data", "xlsx_data").mapInPandas(
        run, PREDICTION_SCHEMA
    )
    return durable(predictions) if keep else predictions


def as_predictions(table: DataFrame) -> DataFrame:
    """Give precomputed predictions every column of the contract, NULL where absent."""
    return table.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in PREDICTION_SCHEMA
        ]
    )


def parse_predictions(table: DataFrame, json: str = "response") -> DataFrame:
    """Predictions from JSON responses (doc_id, response); unreadable ones have an error."""
    given = ("doc_id", "prediction_error")
    fields = T.StructType([f for f in PREDICTION_SCHEMA if f.name not in given]).add("_unread", "string")
    parsed = F.from_json(json, fields, {"columnNameOfCorruptRecord": "_unread"})
    return table.select("doc_id", parsed.alias("p")).select(
        "doc_id",
        *[F.col(f"p.{f.name}") for f in PREDICTION_SCHEMA if f.name not in given],
        F.when(F.col("p").isNull() | F.col("p._unread").isNotNull(), "the response cannot be read").alias("prediction_error"),
    )


def truncated(predictions: DataFrame) -> DataFrame:
    """Flag responses that ended before their first field."""
    return predictions.select("doc_id", F.col("scheme_type").isNull().alias("looks_truncated"))
