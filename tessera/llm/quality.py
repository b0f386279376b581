"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, md5_hash, spread, table, tidy
from tessera.shipping import ship

#: Slots for hashed words; statistics follow them.
WORDS = 1 << 16
#: Parts into which a statistic's range is cut, each a feature of its own.
BINS = 8
STATS = ("words", "chars", "word_length", "upper", "digit", "punct", "newline", "distinct", "most_common", "repeated_pairs", "closed", "titled", "wide", "longest")
SIZE = WORDS + len(STATS) * (BINS + 1)

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_BYTES = np.stack([_UPPER, _DIGIT, _PUNCT, np.arange(256) == 10, np.arange(256) >= 128, ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122)], axis=1).astype(float)
_ENDS = re.compile(r"[.!?:;](?:\s|$)")


class Model(NamedTuple):
    bias: float
    linear: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x rank


class Slots(dict):
    """Word to slot; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return slot


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one whole text; null counts as empty. Statistics are on 0 to 1 and each also marks its part of that range."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n, m = max(1, len(words)), max(1, len(raw))
    upper, digit, punct, line, wide, letters = (np.bincount(raw, minlength=256) @ _BYTES).tolist() if len(raw) else (0,) * 6
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    values = (
        np.log1p(len(words)) / 12,
        np.log1p(len(raw)) / 14,
        min(1.0, len(raw) / n / 20),
        upper / max(1, letters),
        min(1.0, digit / m * 4),
        min(1.0, punct / m * 4),
        min(1.0, line / n * 4),
        len(counts) / n if words else 0.0,
        max(counts.values()) / n if words else 0.0,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        min(1.0, len(_ENDS.findall(text)) / n * 4),
        0.0 if not words else sum(map(str.isupper, counts)) / len(counts),
        wide / m,
        min(1.0, max(map(len, counts), default=0) / 60),
    )
    stats = np.clip(np.array(values), 0, 1)
    k = np.arange(len(STATS))
    at = WORDS + k * (BINS + 1)
    idx = np.concatenate([np.fromiter(map(slots.__getitem__, counts), dtype=np.int64, count=len(counts)), at, at + 1 + np.minimum((stats * BINS).astype(np.int64), BINS - 1)])
    tf = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    norm = np.sqrt((tf**2).sum()) or 1.0
    return idx, np.concatenate([tf / norm, stats, np.full(len(STATS), 0.5)]).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def logits(model: Model, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores of documents that begin at ``starts``, and their sums of v x.

    Pairs cost linear time: sum over i < j of <v_i, v_j> x_i x_j is half of (sum v x)**2 - sum (v x)**2, by factor.
    """
    vx = model.factors[idx] * val[:, None]
    s = _sums(vx, starts)
    z = model.bias + _sums(model.linear[idx] * val, starts) + 0.5 * (s * s - _sums(vx * vx, starts)).sum(axis=1)
    return z, s


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 5) -> Model:
    """Logistic loss by AdaGrad over minibatches in a seeded order. Without rows, or with one label only, all texts score that share of label 1 (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32)
    y = np.array([r[2] for r in rows], dtype=np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if rows else 0.5
    bias = float(np.log(share / (1 - share)))
    if not rows or y.min() == y.max():
        return Model(bias, w, np.zeros_like(v))
    gw, gv, gb = np.full(SIZE, 1e-3, dtype=np.float32), np.full((SIZE, rank), 1e-3, dtype=np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = [rows[j] for j in order[i : i + batch]]
            idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            n = np.array([len(r[0]) for r in part])
            starts = np.cumsum(n) - n
            z, s = logits(Model(bias, w, v), idx, val, starts)
            g = (1 / (1 + np.exp(-z)) - np.array([r[2] for r in part])) / len(part)
            each = np.repeat(g, n).astype(np.float32)
            dv = (each * val)[:, None] * (np.repeat(s, n, axis=0) - v[idx] * val[:, None])
            order_ = np.argsort(idx, kind="stable")
            slot, first = np.unique(idx[order_], return_index=True)
            dw_ = _sums((each * val)[order_], first) + decay * w[slot]
            dv_ = _sums(dv[order_], first) + decay * v[slot]
            gw[slot] += dw_**2
            gv[slot] += dv_**2
            w[slot] -= rate * dw_ / np.sqrt(gw[slot])
            v[slot] -= rate * dv_ / np.sqrt(gv[slot])
            gb += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / gb**0.5
    return Model(bias, w, v)


def scores(model: Model, texts: list[str | None], slots: Slots, step: int = 256) -> np.ndarray:
    out = []
    for i in range(0, len(texts), step):
        got = [features(t, slots) for t in texts[i : i + step]]
        n = np.array([len(g[0]) for g in got])
        z, _ = logits(model, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.cumsum(n) - n)
        out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, most_slots: int = 4_000_000) -> Model:
    """A model of labels.quality from at most ``sample`` labelled documents: those whose doc_id's MD5 is smallest, of all whose CRC-32 is not divisible by 5.

    Labels with null doc_id or quality are left out; of labels that repeat a doc_id the largest counts, of documents
    that repeat one the text whose hash is smallest. Texts enter whole, as their slots; in that order they are taken until they
    have ``most_slots`` slots together. So the driver receives ``sample`` rows and 8 x ``most_slots`` bytes at most.
    """
    ship(docs.sparkSession)
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    y = y.where(~held_out(F.col("doc_id"))).orderBy(md5_hash(F.col("doc_id")), "doc_id").limit(sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")  # at most sample rows
    d = d.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in batches:
            got = [features(t, slots) for t in b.column(2).to_pylist()]
            cols = [pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "y", "n", "idx", "val"])

    found = checkpoint(d.mapInArrow(tidy(extract), "doc_id long, y int, n long, idx binary, val binary").withColumn("h", md5_hash(F.col("doc_id"))))
    before = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most sample rows
    chosen = found.select("doc_id", F.sum("n").over(before).alias("sum")).where(F.col("sum") <= most_slots)
    rows = found.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("doc_id", "y", "idx", "val").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([(np.frombuffer(r.idx, dtype="<i4").astype(np.int64), np.frombuffer(r.val, dtype="<f4"), r.y) for r in rows])


def scorer(spark: SparkSession, model: Model):
    """A column function from text to score. The model (2 MB) is broadcast."""
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = Slots()
        for texts in parts:
            yield pd.Series(scores(Model(*shared.value), texts.tolist(), slots))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    The score is the machine's probability of label 1 from the whole text alone; null and empty texts have the score
    of a text without words. Null doc_ids hash as empty text. Equal texts have equal scores; a score equal to
    ``threshold`` counts as 1. Rows that repeat another stay. No rows: no rows. Other columns are not read. A very long
    text is scored whole, in the memory of its words and their counts.
    """
    score = scorer(docs.sparkSession, train(docs, labels, sample))
    out = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000) -> DataFrame:
    """Rows of docs whose score is at least ``threshold``, in the columns of docs; nulls, ties, long and repeated texts as in ``quality_scores``. No rows: no rows."""
    score = scorer(docs.sparkSession, train(docs, labels, sample))
    return spread(docs).withColumn("__score", score("text")).where(F.col("__score") >= threshold).drop("__score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
