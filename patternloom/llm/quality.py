"""Quality: random-indexing word vectors pooled per document, a two-layer network, temperature.

Tokens are runs of letters, of digits or of other marks; their hashes fall into a fixed number
of buckets.  Each bucket has a sparse random index vector; a bucket's word vector is the sum of
the index vectors of the tokens next to it, over all documents (per-task sums of fixed size,
added up on the executors).  A document is the mean and the spread of its tokens' unit vectors
with a few shares of token kinds.  A network of one hidden layer, fitted in numpy on a bounded
sample of labelled rows, gives a logit; a temperature fitted on rows kept from training
calibrates it.

Defined results: null and empty texts are pooled as zeros and scored like any other; very long
texts are pooled whole; repeated rows are scored each; without labelled rows of both classes every score is the share of label 1
(0.5 without labels); an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import LOWER, U64, _BYTE, _power_tables, crc_mod, labelled_sample, mix64, slices, summed_arrays, table

BUCKETS, DIMENSIONS, NONZERO = 1 << 13, 48, 4
WINDOW = 2
#: Labelled rows that the network is fitted on, at most.
MAX_TRAINING_ROWS = 12_000
HIDDEN, EPOCHS = 32, 40
_PARTS = 64
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each bucket's index vector."""
    r = np.random.Generator(np.random.PCG64(17))
    return r.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), r.choice(np.asarray([-1.0, 1.0]), (BUCKETS, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Bucket, kind (1 word, 2 number, 3 mark, 4 word in capitals) and length of each token; first per text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < n]] = True
    edge = np.flatnonzero(change)
    s, e = edge[:-1], edge[1:]
    s, e = s[kind[s] > 0], e[kind[s] > 0]
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[LOWER[data]] * power[:n], out=sums[1:])
    upper = np.zeros(n + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    loud = (kind[s] == 1) & (e - s > 1) & (upper[e] - upper[s] == e - s)
    k = kind[s].astype(np.int64) + 3 * loud
    h = mix64((sums[e] - sums[s]) * inverse[s])
    return (h % U64(BUCKETS)).astype(np.int64), k, e - s, np.searchsorted(s, offsets)


def _contexts(batches):
    """Sums of the neighbours' index vectors for each bucket, as packed parts."""
    dims, signs = index_vectors()
    whole = np.zeros(BUCKETS * DIMENSIONS)
    for batch in batches:
        for _, _, data, offsets in slices(batch, 0, 1 << 20):
            b, _, _, at = tokens(data, offsets)
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for d in range(1, WINDOW + 1):
                if len(b) <= d:
                    continue
                near = text[d:] == text[:-d]
                for x, y in ((b[:-d][near], b[d:][near]), (b[d:][near], b[:-d][near])):
                    for j in range(NONZERO):
                        whole += np.bincount(x * DIMENSIONS + dims[y, j], signs[y, j], len(whole))
    if whole.any():
        rows = whole.reshape(_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([r.astype(np.int64).tobytes() for r in rows], pa.binary())], ["part", "data"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vector of each bucket, from all documents."""
    parts = summed_arrays(docs.where(F.col(text).isNotNull()).select(text).mapInArrow(_contexts, "part int, data binary"), np.int64)
    if len(parts) < _PARTS:
        return np.zeros((BUCKETS, DIMENSIONS), np.float32)
    v = np.concatenate([parts[k] for k in range(_PARTS)]).reshape(BUCKETS, DIMENSIONS).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= v.mean(0)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its vectors, shares of kinds, length terms."""
    b, kind, size, at = tokens(data, offsets)
    n = np.diff(at)
    out = np.zeros((len(n), 2 * DIMENSIONS + 8), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        x = vectors[b]
        each = n[some][:, None]
        mean = np.add.reduceat(x, at[some], axis=0) / each
        x *= x
        out[some, :DIMENSIONS] = mean
        out[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(np.add.reduceat(x, at[some], axis=0) / each - mean**2, 0))
        text = np.repeat(np.arange(len(n)), n)
        for k in range(1, 5):
            out[:, 2 * DIMENSIONS + k - 1] = np.bincount(text, kind == k, len(n)) / np.maximum(n, 1)
        out[:, -4] = np.bincount(text, size, len(n)) / np.maximum(n, 1) / 10
        pair = np.unique(text * BUCKETS + b)
        out[:, -3] = np.bincount(pair // BUCKETS, minlength=len(n)) / np.maximum(n, 1)
    out[:, -2] = np.log1p(n) / 10
    out[:, -1] = 1.0
    return out


def _vectors_of(batches, vectors):
    v = vectors.value
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, 1, 1 << 20):
            rows = pooled(data, offsets, v)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo).cast(pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "x"])


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    hidden = np.maximum(((x - net["mean"]) / net["scale"]) @ net["w1"] + net["b1"], 0)
    return hidden @ net["w2"] + net["b2"]


def temperature(raw: np.ndarray, wanted: np.ndarray) -> float:
    """The divisor of logits, of a grid, with the least log loss on rows kept from training."""
    loss = lambda temp: float(np.logaddexp(0, np.where(wanted > 0, -raw, raw) / temp).mean())
    return min(np.geomspace(0.25, 8, 60).tolist(), key=loss)


def fit(docs: DataFrame, labels: DataFrame, vectors, target: str = "quality", modulus: int = 4, held: int = 2, most: int = MAX_TRAINING_ROWS) -> dict:
    """The network and its temperature, fitted on at most ``most`` labelled rows."""
    sample, known = labelled_sample(docs, labels, target, modulus, held, most)
    rows = sample.mapInArrow(partial(_vectors_of, vectors=vectors), "label int, x binary").toArrow()
    y = rows.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(y), -1)
    order = np.lexsort((*x.T[:3], y))  # the layout of the rows does not matter
    x, y = x[order], y[order]
    r = np.random.Generator(np.random.PCG64(23))
    mix = r.permutation(len(y))
    test, train = mix[: len(y) // 5], mix[len(y) // 5 :]
    net = {"mean": x[train].mean(0), "scale": x[train].std(0) + 1e-3, "w1": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), "b2": np.float32(0)}
    names = ("w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(net[k]) for k in names} for _ in range(2))
    z = ((x - net["mean"]) / net["scale"]).astype(np.float32)
    t = 0
    for _ in range(EPOCHS):
        for at in np.array_split(r.permutation(train), max(1, len(train) // 128)):
            h = np.maximum(z[at] @ net["w1"] + net["b1"], 0)
            e = (1 / (1 + np.exp(-np.clip(h @ net["w2"] + net["b2"], -30, 30))) - y[at]) / len(at)
            back = np.outer(e, net["w2"]) * (h > 0)
            grads = {"w1": z[at].T @ back + 1e-4 * net["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * net["w2"], "b2": e.sum()}
            t += 1
            for k in names:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
                net[k] = net[k] - (0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    net["temperature"] = temperature(logits(x[test], net), y[test])
    return net


def _score(batches, net, vectors):
    model, v = net.value, vectors.value
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, 1, 1 << 20):
            if "constant" in model:
                p = np.full(hi - lo, model["constant"])
            else:
                p = 1 / (1 + np.exp(-np.clip(logits(pooled(data, offsets, v), model).astype(float) / model["temperature"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # BUCKETS x DIMENSIONS floats
    net = context.broadcast(fit(docs, labels, vectors, target, modulus, held))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(partial(_score, net=net, vectors=vectors), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
