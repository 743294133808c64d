"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character (code point) n-grams (3, 5 and 7) of the text with A-Z lowered, each as present
at least once, twice and four times.  On a
bounded sample of labelled rows, half of each class, each n-gram gets its log-count ratio between the classes; the
n-grams with the strongest evidence, scaled by that ratio, feed a logistic regression.  The
whole text is scored.

Defined results: null and empty texts score as the model's intercept; very long texts are scored
whole; repeated rows are scored each; without labelled rows of both classes every score is the share of toxic labels (0 where
there are none); an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import LOWER, crc_mod, labelled_sample, slices, summed_arrays, table, tidy

ORDERS = (3, 5, 7)
BUCKET_BITS = 19
#: An n-gram that stands this often in a text is a feature of its own.
LEVELS = (1, 2, 4)
#: Labelled rows that the model is fitted on, at most, and n-grams that it keeps.
MAX_TRAINING_ROWS = 10_000
KEPT_FEATURES = 12_000
_PARTS = 64
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_STEP, _PLANE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, A-Z lowered, and the place of each text's first one."""
    starts = (data & 0xC0) != 0x80
    points = np.frombuffer(LOWER[data].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != int(starts.sum()):  # not UTF-8: bytes count as characters
        return LOWER[data].astype(np.uint32), offsets
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=places[1:])
    return points, places[offsets]


def grams(points: np.ndarray):
    """Bucket of the n-gram that begins at each character, for each order in turn."""
    t = _TABLE[points & np.uint32(255)] ^ (points >> np.uint32(8)) * _PLANE
    h = np.zeros(len(t), np.uint32)
    factor = np.uint32(1)
    for j in range(max(ORDERS)):
        if len(t) <= j:
            return
        h = h[: len(t) - j] + t[j:] * factor
        factor = np.uint32((int(factor) * int(_STEP)) & 0xFFFFFFFF)
        if j + 1 in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * j)
            yield j + 1, x >> np.uint32(32 - BUCKET_BITS)


def present(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, level by level; no n-gram crosses two texts.

    A feature is ``level index << BUCKET_BITS | bucket``; with ``slot``, only those with a slot
    count and the slot is returned.
    """
    texts, buckets = [], []
    wanted = None if slot is None else (slot.reshape(len(LEVELS), -1) >= 0).any(0)
    points, offsets = characters(data, offsets)
    for n, bucket in grams(points):
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + n <= offsets[text + 1]
        texts.append(text[inside])
        buckets.append(bucket[at[inside]])
    if not texts:
        z = np.zeros(0, np.int64)
        return z, z
    pairs, count = np.unique(np.concatenate(texts) << BUCKET_BITS | np.concatenate(buckets), return_counts=True)
    mask = (1 << BUCKET_BITS) - 1
    text = np.concatenate([pairs[count >= c] >> BUCKET_BITS for c in LEVELS])
    feature = np.concatenate([(pairs[count >= c] & mask) | k << BUCKET_BITS for k, c in enumerate(LEVELS)])
    if slot is not None:
        feature = slot[feature].astype(np.int64)
        text, feature = text[feature >= 0], feature[feature >= 0]
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def _count(batches):
    """Documents of each class that hold each bucket, as packed parts."""
    size = len(LEVELS) << BUCKET_BITS
    whole = np.zeros((2, size), np.int32)
    for batch in batches:
        label = batch.column(2).to_numpy()
        for lo, hi, data, offsets in slices(batch, 1, 1 << 20):
            text, bucket = present(data, offsets, None)
            for y in (0, 1):
                whole[y] += np.bincount(bucket[label[lo:hi][text] == y], minlength=size).astype(np.int32)
    if whole.any():
        rows = whole.reshape(2, _PARTS, -1).transpose(1, 0, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "data"])


def _vectors(batches, slot):
    """Label and features of each row, two bytes a feature."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, 1, 1 << 20):
            text, feature = present(data, offsets, slot)
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            packed = [feature[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo).cast(pa.int32()), pa.array(packed, pa.binary())], ["label", "features"])


def log_count_ratio(counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each feature and the strength of its evidence.

    ``counts`` holds the rows of class 0 and 1 with each feature, ``totals`` the rows of each class.
    """
    share = (counts + 0.5) / (totals[:, None] + 1)
    strength = np.abs(share[1] - share[0]) / np.sqrt(share.mean(0) * (1 - share.mean(0)) + 1e-9)
    return np.log(share[1] / share[0]), np.where(counts.sum(0) >= 3, strength, 0)


def _descend(of: np.ndarray, row_at: np.ndarray, y: np.ndarray, r: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression on the features scaled by ``r``; rows go through in blocks of bounded size."""
    w, edges = np.zeros(len(r)), [0]
    while edges[-1] < len(y):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(row_at, row_at[edges[-1]] + (1 << 19), side="right")) - 1))
    m, v, lr = np.zeros(len(r) + 1), np.zeros(len(r) + 1), 0.05
    for t in range(1, 151):
        total, error, scaled = np.zeros(len(r)), 0.0, (w * r).astype(np.float32)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            f, row = of[row_at[a] : row_at[b]], np.repeat(np.arange(b - a, dtype=np.int32), np.diff(row_at[a : b + 1]))
            g = 1 / (1 + np.exp(-np.clip(np.bincount(row, scaled[f], b - a) + bias, -30, 30))) - y[a:b]
            total += np.bincount(f, g[row], len(r))
            error += g.sum()
        grad = np.append(r * total / len(y) + 1e-3 * w, error / len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = 5, held: int = 0, most: int = MAX_TRAINING_ROWS, kept: int = KEPT_FEATURES) -> dict:
    """Bucket slots, weights and intercept, fitted on at most ``most`` labelled rows."""
    with tidy(docs.sparkSession):
        return _fit(docs, labels, target, modulus, held, most, kept)


def _fit(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, most: int, kept: int) -> dict:
    sample, known = labelled_sample(docs, labels, target, modulus, held, most, balanced=True)
    # the sample is small: few tasks count it, each with an array of fixed size
    parts = summed_arrays(sample.repartition(16).mapInArrow(_count, "part int, data binary"), np.int32)
    none = {"slot": np.full(len(LEVELS) << BUCKET_BITS, -1, np.int16), "weights": np.zeros(1), "bias": -30.0}
    if len(parts) < _PARTS:
        return none
    counts = np.concatenate([parts[k].reshape(2, -1) for k in range(_PARTS)], axis=1).astype(float)
    seen = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    totals = np.asarray([seen.get(y, 0) for y in (0, 1)], float)
    if not totals.all():
        return none | {"bias": 30.0 if totals[1] else -30.0}
    ratio, evidence = log_count_ratio(counts, totals)
    best = np.sort(np.argsort(-evidence, kind="stable")[:kept])
    best = best[evidence[best] > 0]
    slot = np.full(len(LEVELS) << BUCKET_BITS, -1, np.int16)
    slot[best] = np.arange(len(best))
    # bound: `most` rows of at most `kept` features of two bytes
    rows = sample.mapInArrow(partial(_vectors, slot=slot), "label int, features binary").toArrow()
    y = rows.column("label").to_numpy().astype(np.float32)
    lists = rows.column("features").combine_chunks().cast(pa.large_binary())
    row_at = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(y) + 1] // 2
    of = np.frombuffer(lists.buffers()[2], np.uint16) if lists.buffers()[2] is not None else np.zeros(0, np.uint16)
    r = ratio[best]
    w, bias = _descend(of, row_at, y, r, float(np.log(totals[1] / totals[0])))
    # the sample is balanced: shift the odds back to those of all training labels
    shift = np.log(known[1] / known[0]) - np.log(totals[1] / totals[0])
    return {"slot": slot, "weights": w * r, "bias": float(bias + shift)}


def _score(batches, model):
    slot, weights, bias = (model.value[k] for k in ("slot", "weights", "bias"))
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, 1, 1 << 20):
            text, feature = present(data, offsets, slot) if slot.max() >= 0 else (np.zeros(0, np.int64),) * 2
            z = np.bincount(text, weights[feature], hi - lo) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row; the model has a fixed size."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, model=shared), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(batches, model, text: int, cut: float):
    slot, weights, bias = (model.value[k] for k in ("slot", "weights", "bias"))
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, text, 1 << 20):
            at, feature = present(data, offsets, slot) if slot.max() >= 0 else (np.zeros(0, np.int64),) * 2
            z = np.bincount(at, weights[feature], hi - lo) + bias
            keep = 1 / (1 + np.exp(-np.clip(z, -30, 30))) < cut
            yield batch.slice(lo, hi - lo).filter(pa.array(keep))


def clean_documents(docs: DataFrame, model: dict, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_clean, model=shared, text=docs.columns.index("text"), cut=cut), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
