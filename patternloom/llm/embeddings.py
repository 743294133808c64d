"""Exact embedding near-duplicates by int8 tile products with error bounds.

Equal vectors are one class with a multiplicity.  Each unit vector is stored as int8 with its
own scale; the norm of what quantisation lost is kept with it.  For a tile (block against
block) the integer product, scaled, is within ``|y_q| e_x + |x_q| e_y + e_x e_y`` of the
cosine: pairs whose upper bound stays below the threshold are no links, pairs whose lower bound
reaches it are links, and only those between are recomputed in double precision, a bounded
number at a time.  A tile is worked off in strips of rows; it returns the number of links per
vector and the edges of a spanning forest, never its pairs, so its memory does not depend on
how many pairs link.  Blocks have a fixed size; each unordered pair of blocks is one tile task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different length never link; equal vectors link with each other;
float components are kept as float, all others as double;
rows without an id are left out; an id yields one row, and of its different vectors the usable
one of the least SHA-256 print counts; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from patternloom.llm._common import checkpointed, connected_components, table

BLOCK_ROWS = 4096
#: Rows of a strip, and pairs recomputed at a time.
_STRIP, _RECHECK = 256, 1 << 14


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scale, and the norm of the error of each (rounded up)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12
    return q, scale, error


def _pack(key: tuple, got: pa.Table, dtype: type) -> pa.Table:
    """One block as packed arrays: ids, multiplicities and rows of the input's own precision."""
    got = got.sort_by("rep")
    rows = np.stack([np.asarray(r, np.float64) for r in got.column("vector").to_numpy()])
    return pa.table({
        "dim": pa.array([rows.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
        "ids": pa.array([got.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "copies": pa.array([got.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "rows": pa.array([rows.astype(dtype).tobytes()], pa.binary()),
    })


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _certain(fa, sa, ea, fb, sb, eb, threshold: float, dim: int):
    """Strips of a tile: first row, sure links and pairs to recompute (Boolean matrices)."""
    # float32 sums of int8 products are exact below 2**24; longer ones get their rounding error as slack
    slack = 1e-6 + (0 if dim <= 1024 else dim * 2.0**-23)
    na, nb = np.linalg.norm(fa, axis=1) * sa, np.linalg.norm(fb, axis=1) * sb
    for lo in range(0, len(fa), _STRIP):
        rows = slice(lo, min(lo + _STRIP, len(fa)))
        product = fa[rows] @ fb.T
        product *= sb.astype(np.float32)
        product *= sa[rows].astype(np.float32)[:, None]
        bound = (nb.max() * ea[rows] + na[rows] * eb.max() + ea[rows] * eb.max() + slack).astype(np.float32)[:, None]
        sure = product >= threshold + bound
        yield lo, sure, (product >= threshold - bound) & ~sure


def _links_of_tile(a_id, a_n, a, b_id, b_n, b, same: bool, threshold: float):
    """Links of each row of ``a`` and ``b`` (copies counted) and the edges of a spanning forest."""
    qa, sa, ea = _quantised(a)
    qb, sb, eb = (qa, sa, ea) if same else _quantised(b)
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    off = 0 if same else len(a)
    part = np.arange(len(a) + (0 if same else len(b)))
    src, dst = [], []
    column = np.arange(len(b))
    for lo, hit, maybe in _certain(qa.astype(np.float32), sa, ea, qb.astype(np.float32), sb, eb, threshold, a.shape[1]):
        if same:
            below = column[None, :] <= np.arange(lo, lo + len(hit))[:, None]
            hit[below] = maybe[below] = False
        i, j = np.nonzero(maybe)
        for at in range(0, len(i), _RECHECK):
            x, y = i[at : at + _RECHECK], j[at : at + _RECHECK]
            hit[x, y] = np.einsum("ij,ij->i", a[lo + x], b[y]) >= threshold
        rows = np.flatnonzero(hit.any(1))
        if not len(rows):
            continue
        links_a[lo : lo + len(hit)] += (hit @ b_n.astype(float)).astype(np.int64)
        links_b += (a_n[lo : lo + len(hit)].astype(float) @ hit).astype(np.int64)
        for r in rows.tolist():  # join the parts that the row links; one edge for each part but its own
            k = np.flatnonzero(hit[r])
            other = part[k + off]
            new = other != part[lo + r]
            if new.any():
                other, at = np.unique(other[new], return_index=True)
                src += [int(a_id[lo + r])] * len(at)
                dst += b_id[k[new][at]].tolist()
                part[np.isin(part, other)] = part[lo + r]
    return links_a, links_b, src, dst


def _tile(batches, threshold: float, dtype: type):
    for batch in batches:
        for k in range(batch.num_rows):
            dim, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            read = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)  # noqa: B023, E731
            a_id, a_n, a = read(2, np.int64), read(3, np.int64), _unit(read(4, dtype).reshape(-1, dim).astype(np.float64))
            b_id, b_n, b = (a_id, a_n, a) if same else (read(5, np.int64), read(6, np.int64), _unit(read(7, dtype).reshape(-1, dim).astype(np.float64)))
            links_a, links_b, src, dst = _links_of_tile(a_id, a_n, a, b_id, b_n, b, same, threshold)
            got_a, got_b = np.flatnonzero(links_a), np.flatnonzero(links_b)
            n = len(got_a) + len(got_b)
            if n:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((a_id[got_a], b_id[got_b], np.asarray(src, np.int64)))),
                    pa.array(np.concatenate((links_a[got_a], links_b[got_b], np.zeros(len(src), np.int64)))),
                    pa.array([None] * n + dst, pa.int64()),
                ], ["id", "links", "other"])


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector ``vec_id``, ``n_links``, ``component_id`` and ``kept``: links are cosines >= threshold."""
    kind = vectors.schema[id].dataType
    number, dtype = ("float", np.float32) if vectors.schema[vector].dataType.elementType == FloatType() else ("double", np.float64)
    base = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast(f"array<{number}>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0)
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast(number))  # -0.0 and 0.0 alike
    marked = base.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), plain))
    marked = marked.withColumn("print", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256))
    usable_print = F.when(F.col("vector").isNotNull(), F.struct("print", F.size("vector").alias("dim")))
    ids = checkpointed(marked.groupBy("id").agg(F.min(usable_print).alias("x")).select("id", "x.print", "x.dim"))
    classes = checkpointed(ids.where("print is not null").groupBy("print", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    shape = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    good = marked.where("vector is not null")
    heads = good.select(F.col("id").alias("rep"), "print", "vector").join(classes.drop("dim"), ["print", "rep"]).dropDuplicates(["rep"])
    out = None
    for dim, n in sorted(shape.items()):
        blocks = -(-n // block_rows)
        part = heads.where(F.size("vector") == dim).withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)))
        packed = checkpointed(
            part.select(F.lit(dim).alias("dim"), "block", "rep", "copies", "vector").groupBy("dim", "block")
            .applyInArrow(lambda key, got: _pack(key, got, dtype), "dim int, block long, ids binary, copies binary, rows binary")
        )
        spark = vectors.sparkSession
        tiles = blocks * (blocks + 1) // 2
        pairs = spark.range(blocks).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(blocks - 1))).alias("j"))
        left = packed.toDF("dim", "i", "a_ids", "a_copies", "a_rows")
        right = packed.toDF("dim_b", "j", "b_ids", "b_copies", "b_rows").drop("dim_b")
        dealt = pairs.join(left, "i").join(right, "j").repartition(min(tiles, 100_000), "i", "j")
        same = F.col("i") == F.col("j")
        none = F.lit(None).cast("binary")
        tile = dealt.select("dim", same.alias("same"), "a_ids", "a_copies", "a_rows", *[F.when(same, none).otherwise(F.col(c)).alias(c) for c in ("b_ids", "b_copies", "b_rows")])
        got = tile.mapInArrow(partial(_tile, threshold=threshold, dtype=dtype), "id long, links long, other long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "id long, links long, other long")
    out = checkpointed(out)
    links = out.where("other is null").groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    parts = connected_components(out.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), "a", "b").withColumnRenamed("id", "rep")
    done = ids.select("id", "print").join(classes.drop("dim").join(links, "rep", "left").join(parts, "rep", "left"), "print", "left")
    component = F.coalesce("component_id", "rep", "id")
    return done.select(
        F.col("id").cast(kind).alias(id),
        F.when(F.col("rep").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        component.cast("long").alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all ``embeddings`` and their components."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
