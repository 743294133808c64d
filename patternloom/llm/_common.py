"""Shared pieces: table access, checkpoints, byte-level hashing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.sources.shared import shared_folder, written

U64 = np.uint64
# freed batches go back to the system; an executor's memory is shared by its workers and the JVM
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def tidy(spark: SparkSession, batch_rows: int | None = None) -> Iterator[Tables]:
    """Tables of the jobs inside, whose shuffle files go as each job ends.

    Only for jobs that write tables or count: a DataFrame that is run again makes its shuffles anew.
    ``batch_rows`` bounds the rows that the jobs hand to Python at a time, where rows are wide.
    """
    new = {_SHUFFLE_FILES: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield Tables(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Tables:
    """Tables that an operator writes to the shared folder, each deleted once no step needs it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: columnar, without lineage, safe from lost executors."""
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(got)] = (path, got)
        return got

    def drop(self, *tables: DataFrame) -> None:
        """Delete the rows of tables that ``keep`` made (an empty table takes their place)."""
        for df in tables:
            path, _ = self.paths.pop(id(df))
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


# --------------------------------------------------------------------------- bytes and hashes

_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INV)):
            row = np.full(size, base, U64)
            row[0] = U64(1)
            _powers[k] = np.cumprod(row, dtype=U64)
    return _powers[0], _powers[1]


def slices(batch: pa.RecordBatch, text: int, max_bytes: int = 4 << 20):
    """Cut a record batch so that each piece holds about ``max_bytes`` of text (one row at least)."""
    col = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        to = min(to, len(col))
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, data[lo:hi], (offsets[at : to + 1] - lo)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts laid end to end, split at ASCII white space, A-Z lowered.

    Returns the 64-bit hash, first byte and end byte of each word and, per text, the index of
    its first word (one more entry than texts).
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    full = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = full.copy()
    begins[1:] &= ~full[:-1] | first[1:n]
    ends = full.copy()
    ends[:-1] &= ~full[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[LOWER[data]] * power[:n], out=sums[1:])
    h = mix64((sums[e] - sums[s]) * inverse[s])
    return h, s, e, np.searchsorted(s, offsets)


# --------------------------------------------------------------------------- graph


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Component of each vertex that has an edge: columns ``id`` and ``component_id`` (the least id).

    Alternating large-star and small-star steps.  The minimum of a neighbourhood is a partial
    aggregate, and it is written before the join back so that adaptive execution can split
    the rows of a vertex with very many neighbours over several tasks.  Tables of a step that is
    done are deleted.
    """
    with tidy(edges.sparkSession) as tables:

        def print_of(df: DataFrame) -> tuple:
            return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

        def step(df: DataFrame, large: bool) -> DataFrame:
            pairs = df.union(df.select("v", "u")).toDF("c", "n") if large else df.toDF("c", "n")
            least = tables.keep(pairs.groupBy("c").agg(F.min("n").alias("m")).select("c", F.least("c", "m").alias("m")))
            joined = pairs.join(least, "c")
            if large:
                out = joined.where("n > c and n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))
            else:
                out = joined.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v")).union(least.select("c", "m").toDF("u", "v"))
            got = tables.keep(out.where("u <> v").distinct())
            tables.drop(df, least)
            return got

        now = tables.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
        mark = print_of(now)
        while mark[0]:
            now = step(step(now, True), False)
            if mark == (mark := print_of(now)):
                break
    return now.toDF("id", "component_id").union(now.select("v", "v").distinct().toDF("id", "component_id"))


# --------------------------------------------------------------------------- labelled rows and small sums


def crc_mod(id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held: int, most: int, balanced: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` labelled rows outside the held-out remainder (doc_id, text, label), and
    the number of training labels of each class before sampling.

    Rows are chosen by a hash of the id, so the choice does not depend on the layout; with
    ``balanced`` each class gets half of the places.  The ids chosen (``most`` at most) are the
    only rows that may be broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).where(crc_mod("doc_id", modulus) != held)
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max(target).cast("int").alias("label"))
    )
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    pick = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = pick(known.where("label = 0"), most // 2).union(pick(known.where("label = 1"), most // 2)) if balanced else pick(known, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    return rows, totals


def summed_arrays(parts: DataFrame, dtype=np.int64) -> dict[int, np.ndarray]:
    """Add up rows ``(part, data)`` of packed arrays by part on the executors; fixed total size."""

    def add(key: tuple, got: pa.Table) -> pa.Table:
        whole = None
        for x in got.column("data"):
            row = np.frombuffer(x.as_buffer(), dtype)
            whole = row.copy() if whole is None else whole + row
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([whole.tobytes()], pa.binary())})

    # two levels, so that no group holds an array of every task
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    some = salted.groupBy("part", "salt").applyInArrow(add, "part int, data binary")
    # collected in one action: an iterator would still read shuffles that ``tidy`` deletes as its action ends
    rows = some.groupBy("part").applyInArrow(add, "part int, data binary").collect()
    return {r.part: np.frombuffer(bytes(r.data), dtype) for r in rows}


def most_frequent(counts: DataFrame, n: str, most: int) -> list:
    """The rows of greatest count, at most ``most``, cut between sixteenths of a power of two.

    A histogram of those steps (about a thousand rows) gives the cut, so no task sends its own
    top rows to the driver.
    """
    step = F.floor(F.log2(n) * 16)
    sizes = {r.step: r.c for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()}
    cut, total = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        cut = b
    return counts.where(step >= cut).collect()
