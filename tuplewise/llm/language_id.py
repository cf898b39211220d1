"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes a space. Its subwords are the byte 2- to 5-grams
within words, word edges included, hashed into ``BUCKETS`` buckets. A text's vector is the mean of its
subwords' embeddings; a linear softmax over it gives the languages' probabilities. Embeddings and softmax
are trained by stochastic gradient descent in numpy. Temperature and rejection bar are then fitted on
sampled texts that training did not see.

As mean and softmax are linear, the trained model is one table of a logit per bucket and language, and
scoring adds table rows over all subwords of the whole text.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, held_out, sampled, shared

BUCKETS = 1 << 16
GRAMS = (2, 3, 4, 5)
DIMENSIONS = 16
#: At most so many labelled documents are used for fitting, the first in the order of a hash of their ids.
SAMPLE = 3000
#: Share of the calibration texts that may fall under the rejection bar.
REJECTED = 0.002
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PRIMES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
_CHUNK = 1 << 20


@cache
def _other_numbers() -> dict[int, str]:
    """Characters that are alphanumeric, but neither letters nor decimal digits, and a space for each."""
    return {cp: " " for cp in range(128, sys.maxunicode + 1) if (c := chr(cp)).isalnum() and not c.isalpha() and not c.isdecimal()}


def letters(text: str | None) -> bytes:
    """Lower-case words between single spaces, one at either end; empty if there is no letter.

    Letters are the characters for which ``isalpha()`` holds: numbers such as ½, ² or Ⅷ are none.
    """
    plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if plain and not plain.isascii() and not plain.replace(" ", "").isalpha():
        plain = " ".join(plain.translate(_other_numbers()).split())
    return f" {plain} ".encode("utf-8", "surrogatepass") if plain else b""


def buckets(data: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each gram length: the bucket of the gram at every position, and whether it is one of a word."""
    x = data.astype(np.uint32)
    space = data == 32
    spaces = np.concatenate(([0], np.cumsum(space)))
    out, masks, total = [], [], x * _PRIMES[0]
    for i in range(1, GRAMS[-1]):
        total = (total[:-1] ^ (total[:-1] >> np.uint32(15))) * _PRIMES[i] + x[i:] * _PRIMES[0]
        n = i + 1
        if n in GRAMS:
            out.append(((total ^ (total >> np.uint32(13))) * _PRIMES[4] >> np.uint32(16)).astype(np.int32))
            inside = spaces[n - 1 : len(x)] - spaces[1 : len(x) - n + 2]  # spaces but at the ends
            masks.append((inside == 0) & ~(space[: len(inside)] & space[n - 1 :] & (n == 2)))
    return out, masks


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords, ascending, and their counts."""
    data, total = np.frombuffer(letters(text), np.uint8), np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 1), _CHUNK):
        for b, m in zip(*buckets(data[at : at + _CHUNK + GRAMS[-1] - 1]), strict=True):
            total += np.bincount(b[m], minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    bar: float

    @cached_property
    def table(self) -> np.ndarray:
        """A contiguous row of logits for each language, with a zero at BUCKETS."""
        return np.vstack((self.logits, np.zeros((1, len(self.languages)), np.float32))).T.copy()

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """A row for each non-empty text, as letters() gives it."""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        edge = np.cumsum([0] + [len(t) for t in texts])
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(flat), _CHUNK):
            part = flat[at : at + _CHUNK + GRAMS[-1] - 1]
            lo = max(0, int(np.searchsorted(edge, at, "right")) - 1)
            starts = np.maximum(edge[lo : int(np.searchsorted(edge, min(at + _CHUNK, len(flat)), "left"))] - at, 0)
            for b, m in zip(*buckets(part), strict=True):
                b, m = b[:_CHUNK], m[:_CHUNK]  # a text ends in a space, so no gram of a word joins two texts
                first = starts[starts < len(m)]
                if len(first):
                    b = np.where(m, b, BUCKETS)
                    for k, row in enumerate(self.table):
                        total[lo : lo + len(first), k] += np.add.reduceat(row.take(b), first, dtype=np.float64)
                    n[lo : lo + len(first)] += np.add.reduceat(m, first, dtype=np.int64)
        return _softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 0.5, seed: int = 8) -> Model:
    """Fits a model to (buckets, counts, language) of texts with subwords; a fifth of them calibrates."""
    languages = sorted({x[2] for x in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    r = np.random.default_rng(seed)
    order = r.permutation(len(rows))
    hold = order[: len(rows) // 5] if len(rows) >= 50 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 50 else order
    emb = r.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    label = np.array([languages.index(x[2]) for x in rows])
    share = lambda i: (rows[i][1] / rows[i][1].sum()).astype(np.float32)
    out[:] = r.normal(0, 0.3, out.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in r.permutation(fit):
            ids, w = rows[i][0], share(i)
            h = w @ emb[ids]
            p = _softmax(h @ out + bias)
            p[label[i]] -= 1
            back = out @ p
            out -= step * np.outer(h, p)
            bias -= step * 0.1 * p
            emb[ids] -= (step * 100 * w)[:, None].clip(0, step) * back  # of a mean over many subwords, steps are scaled up
    table = emb @ out
    raw = np.array([share(i) @ table[rows[i][0]] + bias for i in hold])
    loss = lambda t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(hold)), label[hold]], 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    best = np.sort(_softmax(raw / temperature).max(axis=1))
    return Model(languages, np.ascontiguousarray(table, np.float32), bias.astype(np.float64), temperature, float(best[int(len(best) * REJECTED)]) * 0.9)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` rows with a language: all, or the first by a hash of the id.

    Texts are counted on executors, whole; what reaches the driver is at most BUCKETS counts a sampled row.
    """
    few = sampled(df, id_col, lang_col, sample, 8)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [counted(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.uint16).tobytes() for i, _ in rows], pa.binary()), pa.array([np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes() for _, c in rows], pa.binary()), batch.column(1)], ["ids", "counts", "lang"])

    got = few.select(text_col, lang_col).mapInArrow(count, "ids binary, counts binary, lang string").toLocalIterator()
    ids, counts, ends, langs = bytearray(), bytearray(), [0], []  # two large buffers, which the system gets back afterwards
    for x in got:
        if x.ids:
            ids += x.ids
            counts += x.counts
            ends.append(len(ids) // 2)
            langs.append(x.lang)
    flat, times = np.frombuffer(ids, np.uint16), np.frombuffer(counts, np.uint32)
    return train([(flat[a:b], times[a:b], lang) for a, b, lang in zip(ends, ends[1:], langs)])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, lang_score and lang_rejected.

    A null text, one without a letter, or any text where the model has no language, is ``und`` with score 0
    and rejected. Other texts get their likeliest language, and are rejected if its calibrated probability
    is under the model's bar. An empty table stays empty; columns of these three names are replaced.
    """
    sent = shared(df.sparkSession, model)
    names = ["lang_pred", "lang_score", "lang_rejected"]
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def score(batches):
        import pyarrow as pa

        m = sent.value
        where = kept_columns.index(text_col)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [letters(t.as_py()) for t in part.column(where)]
                full = [i for i, t in enumerate(texts) if t] if m.languages else []
                lang, value, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if full:
                    p = m.probabilities([texts[i] for i in full])
                    for i, k, v in zip(full, p.argmax(axis=1), p.max(axis=1).tolist(), strict=True):
                        lang[i], value[i], rejected[i] = m.languages[k], v, v < m.bar
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(value, pa.float64()), pa.array(rejected, pa.bool_())], [*kept_columns, *names])

    kept_columns = kept.columns
    return kept.mapInArrow(score, schema)


def op8_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from labelled rows that are not held out. Extra column: rejected."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
