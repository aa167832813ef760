"""Operator 8: quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms: its words, the shapes of its words (letters, capitals, digits and signs, runs
taken once) and how often a word repeats the one before. Counts are square-rooted shares weighted by rarity; the
leading eigenvectors over the labelled sample give a space of DIMENSIONS latent axes. The labelled vectors (at most
SAMPLE rows, a documented bound) are broadcast, every document's cosine with each of them is computed in exact blocks,
and the NEIGHBOURS nearest vote with their similarity. Votes are weighted by the inverse of their class's sampling
rate, so that a balanced sample of a rare class does not shift the score.

Only the text enters a score. Cosines are rounded to PLACES decimals, and labelled rows that tie with the last of the
NEIGHBOURS vote too. Defined results: null and empty texts have no terms; they and texts that resemble nothing take the
vote of the labelled texts of fewest words (NEIGHBOURS of them and their ties), which is the evidence that there is on
texts with next to no words. With only one class labelled all scores are that class. Without any labels every score is
0.5. Labels of rows that share a doc_id are averaged, and of their texts the one of least hash is taken; null labels are
ignored. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table, without
from .wordhash import SPACED, byte_slices, hash_words, word_shapes

#: Most labelled rows of one class that are used; two classes.
SAMPLE = 2048
SHAPES, WORDS, DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 512, 512, 64, 25, 8, 0.3
#: Words tell topics apart more than quality, so they weigh less than shapes; repetition weighs more.
WORD_WEIGHT, REPEAT_WEIGHT = 0.3, 2.0
_TERMS = SHAPES + WORDS + 1
_BLOCK = 128
#: Decimal places of a cosine: beyond them texts count as equally near, however a block was cut.
PLACES = 9


def terms(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed terms, a row per text."""
    words, doc = hash_words(texts, SPACED)
    shapes = word_shapes(texts, SPACED)
    again = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])] if len(words) else np.zeros(0, bool)
    row = doc * _TERMS
    places = np.concatenate([row + (shapes % np.uint64(SHAPES)).astype(np.int64), row + SHAPES + (words % np.uint64(WORDS)).astype(np.int64), row[again] + _TERMS - 1])
    counts = np.bincount(places, minlength=len(texts) * _TERMS).reshape(len(texts), _TERMS)
    sizes = np.maximum(1, np.bincount(doc, minlength=len(texts)))
    return np.sqrt(counts / sizes[:, None]).astype(np.float32)


def word_counts(texts: list[bytes]) -> np.ndarray:
    return np.bincount(hash_words(texts, SPACED)[1], minlength=len(texts))


class Model:
    """Latent axes, and the labelled vectors with their labels and weights."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, sizes: np.ndarray | None = None):
        self.mean = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
        self.alike = self.mean
        if len(labels) and sizes is not None:
            # A text without terms has no direction; its neighbours are the labelled texts of fewest words.
            short = sizes <= np.sort(sizes)[min(NEIGHBOURS, len(sizes)) - 1]
            self.alike = float((labels * weights)[short].sum() / weights[short].sum())
        seen = (x > 0).sum(axis=0)
        self.scale = (np.log((1 + len(x)) / (1 + seen)) + 0.1).astype(np.float32)
        self.scale[SHAPES : SHAPES + WORDS] *= WORD_WEIGHT
        self.scale[-1] *= REPEAT_WEIGHT
        z = (x * self.scale).astype(np.float64)
        _, axes = np.linalg.eigh(z.T @ z)
        self.axes = axes[:, ::-1][:, :DIMENSIONS]
        self.vectors, self.labels, self.weights = self.project(x), labels, weights

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.scale).astype(np.float64) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.mean)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(x))
        v = self.project(x)
        for i in range(0, len(x), _BLOCK):
            near = np.round(v[i : i + _BLOCK] @ self.vectors.T, PLACES)
            least = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            vote = np.where(near >= least, np.clip(near, 0, None) ** SHARPNESS * self.weights, 0.0)  # all that tie with the last one vote
            total = vote.sum(axis=1)
            out[i : i + _BLOCK] = np.where(total > 0, vote @ self.labels / np.where(total > 0, total, 1), self.alike)
        return np.clip(out, 0.0, 1.0)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rows of each class; rows that are held out are never read."""
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label")).where("label is not null and id is not null").where(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.avg("label").alias("label")).withColumn("class", (F.col("label") >= 0.5).cast("int"))
    sizes = {r[0]: r[1] for r in usable.groupBy("class").count().collect()}
    picked = [usable.where(F.col("class") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in sorted(sizes)]
    if not picked:
        return Model(np.zeros((0, _TERMS), np.float32), np.zeros(0), np.zeros(0))
    chosen = picked[0].unionByName(picked[1]) if len(picked) > 1 else picked[0]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(x.tobytes(), n) for _, texts in byte_slices(b.column(1)) for x, n in zip(terms(texts), word_counts(texts).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64())], names=["label", "x", "n"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("id"))
    # Of rows that share an id the text of least hash is taken, combined before the shuffle.
    rows = rows.groupBy("id", "label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")).orderBy(F.xxhash64("id"), "id")
    rows = rows.select("label", "_text").mapInArrow(features, "label double, x binary, n bigint").collect()
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), _TERMS)
    y = np.array([r.label for r in rows])
    share = {c: n / max(1, int(((y >= 0.5) == bool(c)).sum())) for c, n in sizes.items()}
    return Model(x, y, np.array([share[int(v >= 0.5)] for v in y]), np.array([r.n for r in rows], np.int64))


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` plus ``out`` (replacing one of this name): no shuffle, and a broadcast of at most 2 * SAMPLE vectors."""
    docs = without(docs, out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            values = [sent.value.scores(terms(texts)) for _, texts in byte_slices(column)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(values) if values else np.zeros(0))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``."""
    name = free_name(docs, "_quality_score")
    return score(docs, fit(docs, labels), out=name).where(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL = None  # eigenvectors and neighbours have no SQL form; tests measure held-out accuracy and a brute-force vote
