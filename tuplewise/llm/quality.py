"""A quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A text's features are its words and word pairs, lower-cased (one pair for all repeats of a word), and the shape of each word (letters, capitals,
digits, punctuation by kind, without repeats), all hashed into one table. The value of a feature is its
count, damped by a square root and scaled to unit length. Per-coordinate FTRL-proximal updates with an L1
term leave a sparse weight table; a score is the sparse dot product with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordHashes, documents, held_out, materialise, mixed, sampled, shared

BITS = 20
#: At most so many labelled documents are used for training, the first in the order of a hash of their ids.
SAMPLE = 8000
#: The driver holds training rows of so many bytes at most. Beyond that it reads them again for each epoch.
HELD = 128 << 20
#: Executors send so many bytes of training rows at a time, or one row.
SENT = 4 << 20
#: Tasks that make the training rows.
TASKS = 32
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: The feature of a word that follows itself.
_AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_runs: dict[str, WordHashes] = {}
_SHAPES = re.compile(r"(.)\1+")
_CLASSES = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0")]


def shape(word: str) -> str:
    for pattern, mark in _CLASSES:
        word = pattern.sub(mark, word)
    return _SHAPES.sub(r"\1", word)


class _Words(WordHashes):
    """Hash of the lower-cased word; the hash of its shape is kept in ``shapes``."""

    def __init__(self):
        super().__init__(300_000)
        self.shapes: dict[str, int] = {}

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.most:
            self.clear()
            self.shapes.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        self.shapes[word] = xxhash.xxh3_64_intdigest(b"\0" + shape(word).encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, ascending, and their values; an empty text has one feature of its own."""
    words = (text or "").split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    table = _runs.setdefault("", _Words())
    one = table.array(words)
    kind = np.fromiter(map(table.shapes.__getitem__, words), np.uint64, len(words)) if all(map(table.shapes.__contains__, set(words))) else np.fromiter(((table[w], table.shapes[w])[1] for w in words), np.uint64, len(words))
    pairs = mixed(one[:-1] * _PAIR + one[1:])
    pairs[one[:-1] == one[1:]] = _AGAIN
    kinds = mixed(kind[:-1] * _PAIR + kind[1:] + np.uint64(1))
    ids, n = np.unique(np.concatenate((one, pairs, kind, kinds)) >> np.uint64(64 - BITS), return_counts=True)
    value = np.sqrt(n).astype(np.float32)
    return ids.astype(np.int64), value / np.sqrt((value * value).sum())


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        ids, value = features(text)
        return float(1 / (1 + np.exp(-(self.weights[ids] @ value + self.bias))))


def train(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """FTRL-proximal over (features, values, label), which ``rows`` gives once for each epoch, in a random order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for ids, x, y in rows():
            w = weight(z[ids], n[ids])
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-(w @ x + bias)))
            g = (p - y) * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
            gb = p - y
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * bias
            nb += gb * gb
    return Model(weight(z, n).astype(np.float32), float(bias))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = 4) -> Model:
    """Trains on at most ``sample`` rows with a label: all, or the first by a hash of the id.

    All features of whole texts are used; they come from executors. The driver holds HELD bytes of rows: all, in
    a new random order for each epoch, or else a part at a time of rows in the order of a hash of their ids, with
    a new order within each part. Without labels, every score is 0.5.
    """

    def featurise(batches):
        import pyarrow as pa

        def batch_of(rows):
            at, ids, values, labels = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.binary()), pa.array(values, pa.binary()), pa.array(labels, pa.int32())], ["at", "ids", "values", "label"])

        rows, size = [], 0
        for batch in batches:
            for at, text, label in zip(*batch.columns, strict=True):
                ids, value = features(text.as_py())
                rows.append((at.as_py(), ids.astype(np.uint32).tobytes(), value.tobytes(), label.as_py()))
                size += 8 * len(ids)
                if size >= SENT:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    few = sampled(labelled, id_col, label_col, sample, 4).select(F.xxhash64(F.lit(seed), id_col).alias("at"), text_col, F.col(label_col).cast("int").alias("label"))
    table = materialise(few.repartition(TASKS).mapInArrow(featurise, "at long, ids binary, values binary, label int"), "training")
    size = table.agg(F.sum(F.octet_length("ids") + F.octet_length("values"))).first()[0] or 0
    r = np.random.default_rng(seed)
    if size > HELD:  # partitions stay far below what the driver may get at once
        table = materialise(table.repartitionByRange(-(-4 * size // HELD), "at"), "training").sortWithinPartitions("at")

    def parts():
        part, held = [], 0
        for x in table.toLocalIterator():
            part.append((x.at, np.frombuffer(x.ids, np.uint32), np.frombuffer(x["values"], np.float32), x.label))
            held += len(x.ids) + len(x["values"])
            if size > HELD and held >= HELD // 4:
                yield part
                part, held = [], 0
        yield part

    def shuffled(part):
        for i in r.permutation(len(part)):
            yield part[i][1:]

    if size > HELD:
        return train(lambda: (x for part in parts() for x in shuffled(part)))
    whole = sorted(next(parts()), key=lambda x: x[0])
    return train(lambda: shuffled(whole))


def scored(df: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` and score, 0 to 1, of every whole text.

    Null and empty texts score alike, by a feature of their own. Every row has its own score: repeated rows and
    equal texts score alike, also under one id, and a score depends on nothing but the text, so ties are equal
    scores. An empty table gives an empty table; other columns are ignored.
    """
    sent = shared(df.sparkSession, model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sent.value.score(t.as_py()) for t in batch.column(len(id_cols))], pa.float64())], [*id_cols, "score"])

    kept = df.select(*id_cols, text_col)
    return kept.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", score double")


def op4_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labelled rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "quality")
    model = fit(docs.join(labels, "doc_id"))
    out = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
