"""Near-duplicate groups by exact Jaccard similarity of word n-gram sets.

The overlap of two documents is an entry of the product of the document by n-gram incidence
matrix with its transpose.  The product is taken in steps:

1. Documents with the same set are one class (a 128-bit print of the set); only the least id
   of a class goes on, so copies cost one row each.  A sketch of the set keeps, for each
   part of the hash range (about two parts a shingle), whether its number of shingles is odd;
   sets differ in at least as many shingles as their sketches differ in bits, which rules out
   most pairs exactly.
2. Columns of the product: with n shingles and threshold t, two sets can only reach t if they
   share one of the first ``n - ceil(t*n) + 1`` of each in any common order.  The order puts
   shingles that occur all over the corpus last, so boilerplate rarely is among the columns.
3. Rows of one column (n-gram) are first multiplied with one hub only, the least id; each
   document's hub of greatest accumulated overlap is verified.
4. After components are known, a column that lies in one component is done.  In the others a
   document is multiplied with each larger component as one row, not with its documents.  The
   columns a document shares with a component are at least those it shares with any document of
   it; where these and all shingles of the larger set outside the columns stay below the overlap
   that every size in the component asks for, none of its documents links.  Only the components
   left are taken apart into pairs.
5. The pairs left are multiplied in full, in blocks of the hash range (``_overlaps``): overlaps
   are accumulated block by block, and a pair goes as soon as what is left of its smaller set
   cannot make up the overlap that its sizes ask for.

No link between different sets is lost: a pair of rows in a column is skipped only when both
are already in one component, or when the bound rules it out.  Nothing is capped.  A column that
very many components share costs the square of their number in comparisons (joins split such a
column over tasks).

The rows of wanted ids (class heads, members of candidate pairs) are picked from the texts by a
bitmap while one of 32 MB suits their number, by a semi-join beyond; both give the same result.

Defined results: null, empty and white-space texts have no shingles and stand alone; very long
texts count whole; equal texts share a class; repeated rows of an id yield one row, which links as any of its texts does
and counts the shingles of the largest; rows without an id are left out; ids are whole numbers
(others raise a TypeError); an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm._common import U64, Tables, connected_components, mix64, most_frequent, slices, table, tidy, words

#: Most frequent shingles that are ordered last; bounds what is broadcast (8 bytes each).
HEAVY = 1 << 16
#: Bytes of text, or of packed sets, that a task works on at a time.
PIECE = 1 << 20
#: Rows handed to Python at a time: texts and packed sets are wide, and the JVM holds a batch as well.
BATCH_ROWS = 512
_FACTOR = (np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle."""
    h, _, _, at = words(data, offsets)
    n = len(h)
    full = np.zeros(max(0, n - k + 1), U64)
    for j in range(k if len(full) else 0):
        full += h[j : j + len(full)] * _FACTOR[j]
    full = mix64(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            u = np.sort(full[a : b - k + 1])
            yield u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif b > a:
            yield mix64((h[a:b] * _FACTOR[: b - a]).sum(dtype=U64, keepdims=True) + _FACTOR[64 - k + b - a])
        else:
            yield np.zeros(0, U64)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, U64).view(np.int64))


_FOLD = [f"f{k}" for k in range(8)]
_PRINT = ["kind", "id", "n", "p1", "p2", "sketch", *_FOLD]


def _sketch(u: np.ndarray) -> bytes:
    """Parity of the number of shingles in each part of the hash range; about two parts a shingle."""
    parts = 1 << max(9, (2 * len(u)).bit_length())
    return np.packbits((np.bincount((u & U64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)).tobytes()


def _folded(x: bytes) -> np.ndarray:
    """The sketch folded to 512 bits, as eight words."""
    a = np.frombuffer(x, np.uint64)
    while len(a) > len(_FOLD):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer is folded to the shorter, which keeps parities."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(batches, percent: int):
    """Pairs whose sketches leave the threshold possible; columns a, b, a_n, b_n and sketches."""
    for batch in batches:
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        differ = np.asarray([_differ(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
        # overlap is at most (total - differ) / 2; overlap / (total - overlap) must reach the threshold
        keep = (100 + percent) * (total - differ) >= 2 * percent * total
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def _prints(batches, k: int, keep: int):
    """Kind 0: id, size and print of a document's set.  Kind 1: shingle and count, the task's most frequent."""
    tokens, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, 1, PIECE):
            sets = list(shingle_sets(data, offsets, k))
            rows = batch.column(0).slice(lo, hi - lo)
            sketches = list(map(_sketch, sets))
            with np.errstate(over="ignore"):
                a = [mix64(u).sum(dtype=U64) for u in sets]
                b = [mix64(u ^ _FACTOR[1]).sum(dtype=U64) for u in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), rows.cast(pa.int64()), pa.array([len(u) for u in sets], pa.int64()), _signed(a), _signed(b), pa.array(sketches, pa.binary()), *map(_signed, np.asarray(list(map(_folded, sketches)), U64).T)], _PRINT)
            new, c = np.unique(np.concatenate(sets), return_counts=True)
            some = c > 1
            tokens, at = np.unique(np.concatenate((tokens, new[some])), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c[some])), len(tokens)).astype(np.int64)
            if len(tokens) > 2 * keep:
                best = np.sort(np.argpartition(counts, -keep)[-keep:])
                tokens, counts = tokens[best], counts[best]
    if len(tokens) > keep:
        best = np.argpartition(counts, -keep)[-keep:]
        tokens, counts = tokens[best], counts[best]
    if len(tokens):
        zero = pa.array(np.zeros(len(tokens), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), _signed(tokens), pa.array(counts), zero, zero, pa.nulls(len(tokens), pa.binary()), *[zero] * len(_FOLD)], _PRINT)


def _columns(batches, k: int, percent: int, heavy, bits):
    """The prefix of each set in the common order: rows (token, id, n); columns id, text, bit."""
    late, rank = heavy.value
    for batch in _wanted(batches, bits):
        for lo, hi, data, offsets in slices(batch, 1, PIECE):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            out_t, out_i, out_n = [], [], []
            for i, u in zip(ids, shingle_sets(data, offsets, k), strict=True):
                n = len(u)
                if not n:
                    continue
                p = n - (percent * n + 99) // 100 + 1
                if len(late):
                    at = np.minimum(np.searchsorted(late, u), len(late) - 1)
                    hit = late[at] == u
                    light = u[~hit]
                    if len(light) < p:
                        order = np.argsort(rank[at[hit]], kind="stable")
                        light = np.concatenate((light, u[hit][order]))
                    u = light
                out_t.append(u[:p])
                out_i.append(np.full(p, i, np.int64))
                out_n.append(np.full(p, n, np.int32))
            if out_t:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out_t)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_n))], ["token", "id", "n"])


def _needed(batches, k: int, bits):
    """Packed sets of the wanted documents; columns id, text, bit."""
    for part in _wanted(batches, bits):
        for lo, hi, data, offsets in slices(part, 1, PIECE):
            sets = [u.tobytes() for u in shingle_sets(data, offsets, k)]
            yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "members"])


#: Blocks of the hash range by which a product is accumulated, as a power of two.
_BLOCK_BITS = 3


def _overlaps(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of sets share ``need`` members or more.

    ``x`` and ``y`` hold the sets of all pairs end to end, ``nx`` and ``ny`` their sizes: two
    sparse matrices, whose row products are accumulated one block of columns at a time.
    """
    row_x, row_y = (np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (nx, ny))
    block_x, block_y = (z >> U64(64 - _BLOCK_BITS) for z in (x, y))
    shared, left_x, left_y = np.zeros(len(need), np.int64), nx.astype(np.int64), ny.astype(np.int64)
    live = np.minimum(left_x, left_y) >= need
    for block in range(1 << _BLOCK_BITS):
        in_x, in_y = (block_x == U64(block)) & live[row_x], (block_y == U64(block)) & live[row_y]
        row, column = np.concatenate((row_x[in_x], row_y[in_y])), np.concatenate((x[in_x], y[in_y]))
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        both = np.flatnonzero((column[1:] == column[:-1]) & (row[1:] == row[:-1]))
        shared += np.bincount(row[both], minlength=len(need))
        left_x -= np.bincount(row_x[in_x], minlength=len(need))
        left_y -= np.bincount(row_y[in_y], minlength=len(need))
        live &= shared + np.minimum(left_x, left_y) >= need
    return live


def _verify(batches, percent: int):
    """Pairs whose full overlap reaches the threshold; columns a, b and the packed sets of both."""
    for batch in batches:
        a_id, b_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        size = [pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) // 8 for c in (2, 3)]
        ends = np.cumsum(8 * (size[0] + size[1]))
        at = 0
        while at < len(a_id):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
            x, y = (np.frombuffer(b"".join(batch.column(c).slice(at, to - at).to_pylist()), U64) for c in (2, 3))
            nx, ny = size[0][at:to], size[1][at:to]
            keep = _overlaps(x, nx, y, ny, -(-percent * (nx + ny) // (100 + percent)))
            yield pa.RecordBatch.from_arrays([pa.array(a_id[at:to][keep]), pa.array(b_id[at:to][keep])], ["a", "b"])
            at = to


#: Bits of a map of wanted ids: 1 MB at least and 32 MB at most, whatever the corpus.
_LEAST_BITS, _MOST_BITS = 1 << 23, 1 << 28


def _bit(id: str, size: int):
    return F.pmod(F.xxhash64(id), F.lit(size))


def _picked(docs: DataFrame, ids: DataFrame, count: int) -> tuple[DataFrame, object]:
    """``docs`` with the bit of each id, and the map of the wanted ones; beyond its greatest size
    only their rows, and no map."""
    size = max(_LEAST_BITS, 1 << (16 * count).bit_length())
    if size > _MOST_BITS:
        return docs.join(ids.distinct(), "id", "left_semi").withColumn("bit", F.lit(0).cast("long")), None
    return docs.withColumn("bit", _bit("id", size)), docs.sparkSession.sparkContext.broadcast(_bits_of(ids, size))


def _wanted(batches, bits):
    """The rows whose bit (third column) is on; a few others may pass, which only cost their work."""
    for batch in batches:
        if bits is not None:
            at = batch.column(2).to_numpy()
            on = np.frombuffer(bits.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1
            batch = batch.take(pa.array(np.flatnonzero(on)))
        yield batch


def _bits_of(ids: DataFrame, size: int) -> bytes:
    """A bitmap of fixed size with a bit on for each ``id``; a few other ids may pass it."""
    at = ids.select((_bit("id", size) + 1).alias("bit"))
    parts = at.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros((size // 32768, 4096), np.uint8)
    # bound: the map itself; an iterator would still read shuffles that ``tidy`` deletes as its action ends
    for r in parts.collect():
        whole[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    return whole.tobytes()


def _links(tables: Tables, docs: DataFrame, prints: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that reach the threshold."""
    short = prints.select("id", "n", "sketch")
    near = pairs.join(short.toDF("a", "a_n", "a_sketch"), "a").join(short.toDF("b", "b_n", "b_sketch"), "b")
    near = near.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
    pairs = tables.keep(near.mapInArrow(partial(_possible, percent=percent), "a long, b long"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    some, bits = _picked(docs, ids, 2 * pairs.count())
    sets = some.select("id", "text", "bit").mapInArrow(partial(_needed, k=k, bits=bits), "id long, members binary")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    out = tables.keep(both.mapInArrow(partial(_verify, percent=percent), "a long, b long"))
    tables.drop(pairs)
    return out


def _met(named: DataFrame, percent: int) -> DataFrame:
    """A row for each column, document and larger component in it (by documents, then least id) of a possible size.

    ``named`` holds rows (token, id, n), each with its component ``c`` of ``w`` documents.  A document
    meets a component once in a column, whatever the number of the component's rows there.
    """
    per = named.groupBy("token", "c", "w").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    own = named.select("token", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("c").alias("a_c"), F.col("w").alias("a_w"))
    meets = F.expr(f"x.token = y.token AND (w > a_w OR w = a_w AND c < a_c) AND 100 * hi >= {percent} * a_n AND 100 * a_n >= {percent} * lo")
    return per.alias("x").join(own.alias("y"), meets).select("a", "a_n", "c", "lo", "hi")


def near_duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, heavy: int = HEAVY) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of k-word
    shingles; ``component_id`` is the least id reachable by links, the document's own included.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id} must hold whole numbers, not {kind.simpleString()}")
    base = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    with tidy(spark, BATCH_ROWS) as tables:
        prints = tables.keep(base.mapInArrow(partial(_prints, k=k, keep=heavy // 2), "kind int, id long, n long, p1 long, p2 long, sketch binary, " + ", ".join(f"{f} long" for f in _FOLD)))
        sets = prints.where("kind = 0")

        # bound: `heavy` rows of two longs
        top = most_frequent(prints.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where("n > 4"), "n", heavy)
        late = np.asarray([r.id for r in top], np.int64).view(U64)
        order = np.argsort(late)
        rank = np.asarray([r.n for r in top], np.int64)
        shared = spark.sparkContext.broadcast((late[order], rank[order]))

        classes = tables.keep(sets.where("n > 0").groupBy("n", "p1", "p2").agg(F.min("id").alias("rep")))
        heads, bits = _picked(base, classes.select(F.col("rep").alias("id")), classes.count())
        heads = heads.select("id", "text", "bit")
        columns = heads.mapInArrow(partial(_columns, k=k, percent=percent, heavy=shared, bits=bits), T.StructType([T.StructField("token", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType())]))
        hubs = tables.keep(columns.groupBy("token").agg(F.min("id").alias("hub"), F.min_by("n", "id").alias("hub_n"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
        rows = tables.keep(columns.join(hubs, "token"))

        near = f"100 * least(n, {{0}}) >= {percent} * greatest(n, {{0}})"
        first = (
            rows.where("id <> hub").where(near.format("hub_n")).groupBy("id", "hub").agg(F.count(F.lit(1)).alias("shared"))
            .groupBy("id").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("b")).select(F.col("id").alias("a"), "b")
        )
        first = tables.keep(first)
        links = _links(tables, base, sets, first, k, percent)
        tables.drop(first)
        parts = connected_components(links, "a", "b")

        sized = parts.join(parts.groupBy("component_id").agg(F.count(F.lit(1)).alias("w")), "component_id").select("id", F.col("component_id").alias("c"), "w")
        named = tables.keep(rows.select("token", "id", "n").join(sized, "id", "left").withColumn("c", F.coalesce("c", "id")).withColumn("w", F.coalesce("w", F.lit(1))))
        tables.drop(rows, hubs)
        met = _met(named, percent).groupBy("a", "a_n", "c").agg(F.count(F.lit(1)).alias("shared"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        met = met.withColumn("lo", F.expr(f"greatest(lo, ({percent} * a_n + 99) div 100)")).withColumn("hi", F.expr(f"least(hi, 100 * a_n div {percent})"))
        # convex in the partner's size, so one end of the sizes allows the most
        reach = " OR ".join(f"{100 + percent} * (100 * shared + {percent} * greatest(a_n, {x})) >= {100 * percent} * (a_n + {x})" for x in ("lo", "hi"))
        met = tables.keep(met.where(f"lo <= hi AND ({reach})").select("a", "a_n", "c"))
        # the folded sketches go along, so that a pair the bound rules out is never made
        member = tables.keep(named.select("id", "n", "c").distinct().join(sets.select("id", "n", *_FOLD), ["id", "n"]))
        tables.drop(named)
        whom = met.join(member.select(F.col("id").alias("a"), F.col("n").alias("a_n"), *[F.col(f).alias(f"a_{f}") for f in _FOLD]), ["a", "a_n"])
        differ = " + ".join(f"bit_count({f} ^ a_{f})" for f in _FOLD)
        bound = f"{100 + percent} * (n + a_n - ({differ})) >= {2 * percent} * (n + a_n)"
        pairs = member.alias("x").join(whom.alias("y"), F.expr(f"x.c = y.c AND {near.format('a_n')} AND {bound}"))
        more = tables.keep(pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())
        tables.drop(met, member)
        links = links.unionByName(_links(tables, base, sets, more, k, percent))
        tables.drop(more)
        # an id with several texts joins their classes
        whole = tables.keep(sets.select("id", "n", "p1", "p2").join(classes, ["n", "p1", "p2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
        tables.drop(prints, classes)
        one = whole.where("n > 0").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("id", "a")
        parts = connected_components(links.unionByName(whole.join(one, "id").where("rep <> a").select("a", F.col("rep").alias("b"))), "a", "b")

    out = whole.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id")).select(F.col("id").cast(kind).alias(id), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets have a Jaccard similarity of at least 0.75."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
