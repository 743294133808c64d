"""Exact dedup by progressive refinement: length, prefix hash, full hash.  DataFrame functions only.

Texts are equal when they are identical after each run of white space (``[\\x20\\x09-\\x0D]+``)
became one space.  Rows fall into ever finer groups, and only rows whose group holds another row
go on:

1. by the length of the normalised text in bytes,
2. by the hash of its first ``PREFIX`` characters,
3. by the SHA-256 of the whole text, which is taken of the rows left only.

The first two levels are read from one narrow table (length and prefix hash).  What is left after
each is a bitmap of fixed size (8 MB, so it is broadcast at any size of the corpus): of lengths
first, of length and prefix next.  A bit that two groups share only sends a row on for nothing; the
groups of the last level are exact.  Groups are partial aggregates, so a group with a third of all
rows costs one row per task; rows meet their group's facts in a join that adaptive execution
splits.  Texts are never shuffled by ``duplicates``; ``dedup`` moves the texts of surviving groups.

Defined results: null texts count as empty; very long texts are hashed whole; every input row comes
back, repeated rows too, and one row of each group stays: the least id, of repeated rows one; rows
without an id count in their group and stay only where no row of it has an id (``keep_id`` is null
then); an empty table yields no rows; columns of any name may stand beside id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm._common import Tables, table, tidy

#: Characters of the normalised text that the second level reads.
PREFIX = 256
#: Bits of the map of groups that go on, dealt over maps of 32,768: 2048 rows of 4 kB.
_BITS, _MAP = 1 << 26, 1 << 15


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bitmap(groups: DataFrame, bit: Column) -> DataFrame:
    """Rows ``part, bits``: a map of fixed size with a bit on for each row of ``groups``."""
    at = groups.select((bit + 1).alias("bit"))  # Spark counts bitmap places from 1
    return at.groupBy((F.bitmap_bucket_number("bit") - 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, bit: Column, name: str) -> DataFrame:
    """``rows`` with a flag whether their bit is on; the map has a fixed size."""
    place = F.pmod(bit, F.lit(_MAP))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    met = rows.withColumn("part", F.floor(bit / _MAP)).join(F.broadcast(bitmap), "part", "left")
    return met.withColumn(name, on).drop("part", "bits")


def _length_bit() -> Column:
    return F.pmod("n", F.lit(_BITS))


def _head_bit() -> Column:
    return F.pmod(F.xxhash64("n", "p"), F.lit(_BITS))


def _alive(tables: Tables, docs: DataFrame, text: str) -> DataFrame:
    """The map of (length, prefix) groups that hold two rows or more."""
    body = normalised(F.col(f"`{text}`"))
    seen = docs.select(F.octet_length(body).alias("n"), F.xxhash64(F.substring(body, 1, PREFIX)).alias("p"))
    heads = tables.keep(seen.groupBy("n", "p").agg(F.count(F.lit(1)).alias("c")))
    lengths = tables.keep(_bitmap(heads.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1"), _length_bit()))
    again = _marked(heads, lengths, _length_bit(), "on").where("on").groupBy("n", "p").agg(F.sum("c").alias("c")).where("c > 1")
    alive = tables.keep(_bitmap(again, _head_bit()))
    tables.drop(heads, lengths)
    return alive


def _refined(docs: DataFrame, alive: DataFrame, text: str, digests: bool) -> DataFrame:
    """``docs`` as ``row`` with ``lives`` (its group goes on) and ``full``, the hash of the whole text (of
    rows that live, of all with ``digests``)."""
    body = normalised(F.col("row")[text])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("n", F.octet_length(body)).withColumn("p", F.xxhash64(F.substring(body, 1, PREFIX)))
    rows = _marked(rows, alive, _head_bit(), "lives")
    full = F.sha2(body, 256)
    return rows.select("row", "n", "lives", (full if digests else F.when(F.col("lives"), full)).alias("full"))


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``full`` (SHA-256 of the
    normalised text; null for texts whose length or prefix is their own, unless ``digests``)."""
    with tidy(docs.sparkSession) as tables:
        alive = _alive(tables, docs, text)
        rows = tables.keep(_refined(docs, alive, text, digests).select(F.col("row")[id].alias("id"), "n", "lives", "full"))
        tables.drop(alive)
        # equal rows first: of repeated rows of an id one stays
        own = tables.keep(rows.where("lives").groupBy("full", "n", "id").agg(F.count(F.lit(1)).alias("copies")))
        groups = tables.keep(own.groupBy("full", "n").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1"))
    met = own.join(groups, ["full", "n"], "left")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)
    grouped = met.select("id", "keep_id", F.col("group_size").alias("size"), "full", each)
    one = F.lit(1).cast("long")
    alone = rows.where("not lives").select("id", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "full")
    return grouped.select("id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", one).alias("group_size"), (F.col("size").isNull() | stays).alias("kept"), "full").unionByName(alone).withColumnRenamed("id", id)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, unchanged: that of the least id."""
    with tidy(docs.sparkSession) as tables:
        rows = _refined(docs, _alive(tables, docs, text), text, False)
    own = F.col("row")[id]
    stays = rows.where("lives").groupBy("full", "n").agg(F.min_by("row", F.struct(own.isNull(), own)).alias("row"))
    both = rows.where("not lives").select("row").unionByName(stays.select("row"))
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays; ``text_sha256`` is of every normalised text."""
    out = duplicates(table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("full").alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, body, sha256(body) AS text_sha256 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents) a) b
WINDOW same AS (PARTITION BY body)"""
