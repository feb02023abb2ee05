"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased; every run of characters that are no letters counts as one space, with
one before the first word and behind the last.  N-grams of one to three characters are hashed
into 2^15 features.  A feature's value is (1 + log of its count) times its inverse document
frequency, and a text's values have length one.  Document frequencies come from all documents
that may be learned from.

Training follows the regularised leader (FTRL-proximal) with an L1 and an L2 penalty, so
weights that little speaks for are exactly 0.  It takes at most ``per_lang`` distinct texts of
each of the ``langs`` most frequent languages, first in the order of a hash of the text: a
bounded sample that is the same in every run.  One in ``calibration`` of them does not train.
The features are written once, dealt to ``workers`` shares; in each of ``rounds`` rounds one
task a share updates the leader's sums, which are averaged.  Then one temperature is chosen that
makes the languages of the other texts likeliest (Platt's correction keeps it above 0 where all
are predicted right); scores are the largest probability at that temperature.
Prediction is one narrow pass over whole texts.

Defined results: a null text or one without a letter is ``und`` with score 1; if no row can be
learned from, all others are ``und`` with score 0; null ids, null languages and null texts are
not learned from; a null id is not held out; of equal probabilities the first language by code
point wins; repeated rows get equal results, and equal texts of a language train once; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimloom.llm import words as w
from claimloom.session import _shared_folder, durable

BITS = 15
LONGEST = 3
UNDETERMINED = "und"
#: Characters that are looked at in one step.
_SLICE = 1 << 20
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
TEMPERATURES = np.geomspace(0.05, 5.0, 200)


@dataclass(frozen=True)
class Training:
    per_lang: int = 2_000
    langs: int = 64
    calibration: int = 5
    workers: int = 4
    rounds: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row, feature and count of every different n-gram of every row, in order; and rows with a letter."""
    lower = [f" {(t or '').lower()} " for t in texts]
    lengths = np.array([len(t) for t in lower], np.int64)
    codes = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32)
    letter = letters()[codes]
    # Of characters that are no letters, the last before a word and the row's last one stay.
    kept = letter.copy()
    kept[:-1] |= letter[1:]
    kept[np.cumsum(lengths) - 1] = True
    chars = np.where(letter, codes, np.uint32(32))[kept].astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)[kept]
    seen = np.zeros(len(texts), bool)
    seen[row[chars != 32]] = True
    found = []
    for n in range(1, LONGEST + 1):
        count = max(0, len(chars) - n + 1)
        key = np.full(count, np.uint64(n))
        for k in range(n):
            key = (key + chars[k : k + count]) * _STEPS[k]
            key ^= key >> np.uint64(29)
        inside = row[:count] == row[n - 1 :] if n > 1 else chars != 32
        feature = ((key * _STEPS[0]) >> np.uint64(64 - BITS)).astype(np.uint32)
        found.append(((row[:count] << np.uint32(BITS)) | feature)[inside])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return keys >> np.uint32(BITS), keys & np.uint32((1 << BITS) - 1), counts, seen


def values(row: np.ndarray, feature: np.ndarray, counts: np.ndarray, rows: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values; those of a row have length one."""
    value = (1 + np.log(counts)) * idf[feature]
    length = np.sqrt(np.bincount(row, value * value, rows))
    return value / length[row]


def parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Whole rows, as many as one step takes."""
    for at, part in w.slices(texts, _SLICE):
        # A row number and a feature share 32 bits.
        for start in range(0, len(part), 1 << 16):
            yield at + start, part.slice(start, 1 << 16).to_pylist()


def leader(z: np.ndarray, n: np.ndarray, how: Training) -> np.ndarray:
    """The weights that the sums stand for."""
    pull = -(z - np.sign(z) * how.l1) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
    return np.where(np.abs(z) > how.l1, pull, 0.0)


def shares(logits: np.ndarray) -> np.ndarray:
    """Probabilities of the classes in the last axis."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def update(feature: np.ndarray, value: np.ndarray, label: int, z: np.ndarray, n: np.ndarray, how: Training) -> None:
    """One example; the tables have a row for each feature and a column for each class."""
    own, squares = leader(z[feature], n[feature], how), n[feature]
    error = shares(value @ own)
    error[label] -= 1
    g = value[:, None] * error
    after = squares + g * g
    z[feature] += g - (np.sqrt(after) - np.sqrt(squares)) / how.alpha * own
    n[feature] = after


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row of logits for each text, and which texts have a letter."""
        row, feature, counts, seen = grams(texts)
        value = values(row, feature, counts, len(texts), self.idf)
        found = [np.bincount(row, value * self.weights[feature, k], len(texts)) for k in range(len(self.langs))]
        return np.stack(found, axis=1) + self.weights[-1], seen


def frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and of those that hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, part in parts(batch.column(0)):
                total += np.bincount(grams(part)[1], minlength=1 << BITS)
        held = np.flatnonzero(total)
        feature = np.append(held, 1 << BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.append(total[held], rows))], ["feature", "n"])

    # One number for each feature, however many documents.
    sums = texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((1 << BITS) + 1)
    for r in sums:
        found[r["feature"]] = r["n"]
    return int(found[-1]), found[:-1]


_EXAMPLES = "place long, label int, features array<int>, shares array<double>"


def train(docs: DataFrame, how: Training = Training()) -> Model:
    """A model of ``docs (doc_id, text, lang)``, from the rows that are not held out."""
    spark = docs.sparkSession
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.langs).collect()
    langs = sorted(r["lang"] for r in counts)
    rows, held = frequencies(usable.select("text"))
    idf = np.log((1 + rows) / (1 + held)) + 1
    model = Model(langs, idf, np.zeros(((1 << BITS) + 1, len(langs))))
    if not langs:
        return model

    key = F.xxhash64("text").alias("key")
    usable = usable.where(F.col("lang").isin(langs)).select("lang", key, "text")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("key"))
    # At most langs * per_lang rows, so they may be sent to every task.
    chosen = usable.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= how.per_lang).drop("rank")
    # Copies combine before the shuffle.
    sample = usable.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    label = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
    place = F.xxhash64(F.lit(12), "key", "lang")
    sample = durable(sample.select(place.alias("place"), label.alias("label"), "text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch.column(2)):
                row, feature, count, _ = grams(part)
                value = values(row, feature, count, len(part), idf)
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                own = [np.append(feature[a:b], 1 << BITS).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                share = [np.append(value[a:b], 1.0) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(own, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float64()))],
                    ["place", "label", "features", "shares"],
                )

    path = f"{_shared_folder(spark)}/languages-{uuid.uuid4().hex}"
    worker = F.when(F.pmod("place", F.lit(how.calibration)) == 0, -1).otherwise(F.pmod(F.shiftright("place", 20), F.lit(how.workers))).cast("int")
    sample.mapInArrow(describe, _EXAMPLES).withColumn("worker", worker).write.partitionBy("worker").parquet(path)
    examples = spark.read.schema(f"{_EXAMPLES}, worker int").parquet(path)

    def share(k: int) -> DataFrame:
        return examples.where(F.col("worker") == k).drop("worker").coalesce(1)

    z, n = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    for _ in range(how.rounds):
        state = spark.sparkContext.broadcast((z, n))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not sum(x.num_rows for x in held):
                return
            z, n = (x.copy() for x in state.value)
            table = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("label", "ascending")])
            for feature, value, label in zip(table["features"], table["shares"], table["label"].to_pylist(), strict=True):
                update(feature.values.to_numpy(), value.values.to_numpy(), label, z, n, how)
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["z", "n"])

        learned = functools.reduce(DataFrame.union, [share(k).mapInArrow(learn, "z binary, n binary") for k in range(how.workers)]).collect()
        state.destroy()
        if not learned:
            break
        z = np.mean([np.frombuffer(r["z"]) for r in learned], axis=0).reshape(z.shape)
        n = np.mean([np.frombuffer(r["n"]) for r in learned], axis=0).reshape(n.shape)
    model.weights = leader(z, n, how)

    weights = spark.sparkContext.broadcast(model.weights)

    def doubt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((2, len(TEMPERATURES)))
        for batch in batches:
            rows += batch.num_rows
            for feature, value, label in zip(batch.column(2), batch.column(3), batch.column(1).to_pylist(), strict=True):
                total += doubts(value.values.to_numpy() @ weights.value[feature.values.to_numpy()], label)
        columns = [pa.array(np.arange(len(TEMPERATURES)), pa.int32()), pa.array(np.full(len(TEMPERATURES), rows)), *map(pa.array, total)]
        yield pa.RecordBatch.from_arrays(columns, ["k", "n", "own", "other"])

    left = examples.where("worker = -1").drop("worker").mapInArrow(doubt, "k int, n long, own double, other double")
    sums = left.groupBy("k").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.sum("other").alias("other")).orderBy("k").collect()
    weights.destroy()
    if len(langs) > 1 and any(r["n"] for r in sums):
        model.temperature = temperature(sums[0]["n"], np.array([r["own"] for r in sums]), np.array([r["other"] for r in sums]))
    return model


def doubts(logits: np.ndarray, label: int) -> np.ndarray:
    """Minus the log-likelihood at every temperature: of the label, and the mean of the others."""
    scaled = logits[None, :] / TEMPERATURES[:, None]
    top = scaled.max(axis=1)
    missing = (top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)))[:, None] - scaled
    own = missing[:, label]
    return np.stack([own, (missing.sum(axis=1) - own) / max(1, len(logits) - 1)])


def temperature(n: int, own: np.ndarray, other: np.ndarray) -> float:
    """The temperature with the least doubt, if one label in n + 2 is taken to be wrong.

    Without that, texts that are all predicted right would make every score 1.
    """
    wrong = 1 / (n + 2)
    return float(TEMPERATURES[np.argmin((1 - wrong) * own + wrong * other)])


def identified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", how: Training = Training()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    trained = train(rows, how)
    model = docs.sparkSession.sparkContext.broadcast(trained) if trained.langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in parts(batch.column(1)):
                if model is None:
                    seen = grams(part)[3]
                    best, score = np.zeros(len(part), int), np.zeros(len(part))
                else:
                    logits, seen = model.value.logits(part)
                    chance = shares(logits / model.value.temperature)
                    best, score = chance.argmax(axis=1), chance.max(axis=1)
                names = model.value.langs if model else [UNDETERMINED]
                found = [names[k] if s else UNDETERMINED for k, s in zip(best, seen, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(found, pa.string()), pa.array(np.where(seen, score, 1.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
