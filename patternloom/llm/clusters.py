"""Centroid clustering of integer vectors by Elkan's bounds.

Vectors are packed into blocks where they lie.  A block keeps, besides its vectors, each one's cluster,
an upper bound on the distance to its centroid and a lower bound on the distance to every centroid.
When centroids move, bounds move by as much; a distance is only taken where the bounds leave open
which centroid is nearest:

* a centroid whose lower bound is above the upper bound is not nearer,
* nor is one that is more than twice the upper bound away from the vector's own centroid.

Upper bounds are rounded up and lower bounds down at every step, and a centroid is skipped only
where it is strictly farther, so ties are always compared; the squared distances that decide are
exact integers.  The result is that of the plain method.

A round reads the blocks, writes them with their new bounds, and the round's table before goes.
Each block writes the sums of its clusters beside it, so new centroids come from that column alone:
blocks are added up on the executors, in two levels, and k rows reach the driver.  A block has a
fixed number of vectors; a cluster with a third of them is one sum per block.

Vectors whose components are beyond ``_PLAIN`` use Python's integers (same code, slower).  Defined
results: vectors of another length, null vectors and those with null or non-finite components are left
out, as are rows without an id; rows of one id are vectors of their own (of equal hashes the lesser
components come first); fewer vectors than k make as many clusters; a distance or inertia that no long
holds is null; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import Tables, table, tidy

K, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
BLOCK_ROWS = 8192
#: Components up to which squared distances of ``DIMENSIONS`` fit a long.
_PLAIN = 1 << 27
_GREATEST = int(np.finfo(np.float64).max)
_BLOCK = "ids binary, vectors binary, cluster binary, upper binary, lower binary, sums binary"


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def _pack(x: np.ndarray) -> bytes:
    return x.astype(np.int64).tobytes() if x.dtype != object else json.dumps(x.ravel().tolist()).encode()


def _unpack(x, dtype: type, width: int) -> np.ndarray:
    flat = np.frombuffer(x, np.int64) if dtype != object else np.array([*json.loads(bytes(x)), None], object)[:-1]
    return flat.reshape(-1, width)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(-1)


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, right to two units in the last place; callers round them outwards twice."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    # beyond the doubles the greatest one stands: outwards of it is infinity, inwards a lesser bound
    whole = [math.sqrt(v) if v < 1 << 106 else min(math.isqrt(v), _GREATEST) for v in squares.ravel().tolist()]
    return np.array(whole, np.float64).reshape(squares.shape)


def _between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down."""
    return _down(_down(_root(_squares(centroids[:, None, :], centroids[None, :, :])))) / 2


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move each vector to its nearest centroid (ties: the smaller number); bounds are kept up in place.

    Returns how many distances were taken.
    """
    half = _between(centroids)
    open_ = (lower <= upper[:, None]) & (half[cluster] <= upper[:, None])
    open_[np.arange(len(x)), cluster] = False
    rows = np.flatnonzero(open_.any(1))
    if not len(rows):
        return 0
    own = _squares(x[rows], centroids[cluster[rows]])
    upper[rows] = _up(_up(_root(own)))
    lower[rows, cluster[rows]] = _down(_down(_root(own)))
    taken, best = len(rows), own
    for j in range(len(centroids)):
        at, u = cluster[rows], upper[rows]
        near = np.flatnonzero((at != j) & open_[rows, j] & (lower[rows, j] <= u) & (half[at, j] <= u))
        if not len(near):
            continue
        taken += len(near)
        got = _squares(x[rows[near]], centroids[j])
        root = _root(got)
        lower[rows[near], j] = _down(_down(root))
        nearer = (got < best[near]) | ((got == best[near]) & (j < at[near]))
        near, got, root = near[nearer], got[nearer], root[nearer]
        best[near], cluster[rows[near]], upper[rows[near]] = got, j, _up(_up(root))
    return taken


def moved(old: np.ndarray, new: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
    """Widen the bounds by the way that each centroid has gone."""
    way = _up(_up(_root(_squares(old, new))))
    way[[bool((a == b).all()) for a, b in zip(old, new, strict=True)]] = 0.0
    upper[:] = _up(upper + way[cluster])
    lower[:] = _down(lower - way)


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> bytes:
    """Number and sum of a block's vectors by cluster, as text (of any size)."""
    found = {}
    for j in np.unique(cluster).tolist():
        mine = x[cluster == j]
        found[j] = [len(mine), *map(int, mine.sum(0))]
    return json.dumps(found).encode()


def _blocks(batches, dtype: type, rows: int):
    """Integer vectors in blocks of at most ``rows``; bounds are open."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSIONS)
            whole = np.floor(np.ldexp(flat, 6)).astype(np.int64) if dtype != object else np.array([[_floor(v) for v in r] for r in flat.tolist()], object).reshape(-1, DIMENSIONS)
            n = len(flat)
            yield pa.RecordBatch.from_arrays([
                pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([_pack(whole)], pa.binary()), pa.array([np.zeros(n, np.int32).tobytes()], pa.binary()),
                pa.array([np.full(n, np.inf).tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
            ], _BLOCK.replace(" binary", "").split(", "))


def _floor(v: float) -> int:
    """floor(64 * v), also where the product leaves the doubles."""
    a, b = v.as_integer_ratio()
    return SCALE * a // b


def _round(batches, dtype: type, centroids: list, before: list | None):
    """One assignment of blocks; ``before`` are the centroids that the bounds are of."""
    c = np.array(centroids, dtype).reshape(-1, DIMENSIONS)
    for batch in batches:
        for b in range(batch.num_rows):
            ids, vectors, cluster, upper, lower, _ = (batch.column(k)[b] for k in range(6))
            x = _unpack(vectors.as_buffer(), dtype, DIMENSIONS)
            cluster, upper = np.frombuffer(cluster.as_buffer(), np.int32).copy(), np.frombuffer(upper.as_buffer()).copy()
            lower = np.frombuffer(lower.as_buffer()).reshape(len(x), -1).copy() if lower.is_valid else np.zeros((len(x), len(c)))
            if before is not None:
                moved(np.array(before, dtype).reshape(-1, DIMENSIONS), c, cluster, upper, lower)
            assign(x, c, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids.as_py()], pa.binary()), pa.array([vectors.as_py()], pa.binary()), pa.array([cluster.tobytes()], pa.binary()), pa.array([upper.tobytes()], pa.binary()), pa.array([lower.tobytes()], pa.binary()), pa.array([_sums(x, cluster, len(c))], pa.binary()),
            ], _BLOCK.replace(" binary", "").split(", "))


def _final(batches, dtype: type, centroids: list):
    """Id, cluster and exact squared distance of each vector (null where no long holds it)."""
    c = np.array(centroids, dtype).reshape(-1, DIMENSIONS)
    for batch in batches:
        for b in range(batch.num_rows):
            x, cluster = _unpack(batch.column(1)[b].as_buffer(), dtype, DIMENSIONS), np.frombuffer(batch.column(2)[b].as_buffer(), np.int32)
            d = [v if v < 1 << 63 else None for v in _squares(x, c[cluster]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(0)[b].as_buffer(), np.int64)), pa.array(cluster), pa.array(d, pa.int64())], ["id", "cluster", "distance"])


def _added(batches):
    """The sums of a task's blocks in one row."""
    whole: dict[str, list[int]] = {}
    for batch in batches:
        for x in batch.column(0):
            for j, row in json.loads(x.as_py()).items():
                whole[j] = [p + q for p, q in zip(whole[j], row, strict=True)] if j in whole else row
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(whole).encode()], pa.binary())], ["sums"])


def _replaced(tables: Tables, state: DataFrame, centroids: list) -> list:
    """New centroids: the floor of each cluster's mean; an empty cluster keeps its own."""
    some = state.select("sums").mapInArrow(_added, "sums binary")
    # the rows of all tasks are added by 8 tasks, and theirs, 8 rows of fixed size, here
    rows = some.repartition(8).mapInArrow(_added, "sums binary").toArrow()
    out = list(centroids)
    for batch in _added(rows.to_batches()):
        for j, (n, *total) in json.loads(batch.column(0)[0].as_py()).items():
            out[int(j)] = [t // n for t in total]
    return out


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (integers)."""
    kind = vectors.schema[id].dataType
    x = F.col("vector")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & (F.size(x) == DIMENSIONS)).where(~F.exists(x, odd))
    with tidy(vectors.sparkSession) as tables:
        mark = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
        first = [r.vector for r in kept.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()]
        reach = kept.agg(F.max(F.array_max(F.transform(x, lambda v: F.abs(v))))).first()[0]
        dtype = np.int64 if reach is None or reach * SCALE < _PLAIN - 1 else object
        centroids, before = [[_floor(v) for v in r] for r in first], None
        state = tables.keep(kept.mapInArrow(partial(_blocks, dtype=dtype, rows=block_rows), _BLOCK))
        for turn in range(rounds + 1):
            new = tables.keep(state.mapInArrow(partial(_round, dtype=dtype, centroids=centroids, before=before), _BLOCK))
            tables.drop(state)
            state = new
            if turn < rounds:
                centroids, before = _replaced(tables, state, centroids), centroids
        rows = tables.keep(state.mapInArrow(partial(_final, dtype=dtype, centroids=centroids), "id long, cluster int, distance long"))
        tables.drop(state)
        wide = F.sum(F.col("distance").cast("decimal(38,0)"))
        whole = F.when(F.count(F.when(F.col("distance").isNull(), 1)) == 0, wide)
        sums = rows.groupBy("cluster").agg(whole.alias("own")).collect()  # k rows at most
    total = None if any(r.own is None for r in sums) else sum(int(r.own) for r in sums)
    fits = lambda v: None if v is None or int(v) >= 1 << 63 else int(v)
    facts = [(r.cluster, fits(r.own), fits(total), [str(v) for v in centroids[r.cluster]]) for r in sums]
    of = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return rows.join(F.broadcast(of), "cluster").select(F.col("id").cast(kind).alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of ``embeddings`` after three rounds."""
    out = cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", "centroid"), 256).alias("centroid_sha256"))


def _assigned(k: int) -> str:
    """Vectors with the nearest of the centroids ``c{k}``."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
      SELECT x.vec_id, c.j, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON x.i = c.i GROUP BY x.vec_id, c.j) q GROUP BY vec_id)"""


def _updated(k: int) -> str:
    return f"""c{k + 1} AS MATERIALIZED (SELECT c.j, c.i, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
      SELECT j, i, (s - ((s % n) + n) % n) // n AS v FROM (SELECT a.j, x.i, sum(x.v) AS s, count(*) AS n FROM x JOIN a{k} a USING (vec_id) GROUP BY a.j, x.i) s) m ON c.j = m.j AND c.i = m.i)"""


_STEPS = ",\n".join(f"{_assigned(k)},\n{_updated(k)}" for k in range(ROUNDS)) + ",\n" + _assigned(ROUNDS)
ORACLE = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIMENSIONS}),
x AS MATERIALIZED (SELECT vec_id, unnest(range({DIMENSIONS})) AS i, floor({SCALE} * unnest(embedding)::DOUBLE)::HUGEINT AS v FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {K}),
c0 AS MATERIALIZED (SELECT s.j, x.i, x.v FROM seeds s JOIN x USING (vec_id)),
{_STEPS},
prints AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN prints USING (j)"""
