"""Line dedup: later copies of repeated line runs are deleted.  DataFrame functions only.

Each text is a sequence of line ids (128 bits of the trimmed line; blank lines are left out of
the sequence).  A suffix begins at each line.  Distributed prefix doubling ranks the suffixes by
their first 1, 2, 4, ... lines: a round joins the rank of a line's run with that of the run
behind it and ranks the sorted pairs (``suffix_ranks``).  Suffixes alone in their interval are
settled and drop out, so after the first round only lines that stand twice are moved.

A run counts when it has at least ``min_words`` words.  Every such run is covered by its
shortest long-enough runs: the one that begins at each line and the one that ends at each line.
The suffixes that share the first n lines of a run are an interval of the suffix array whose
common prefix is n lines or longer; the ranks of the two doubled runs that overlap to n lines,
the one that begins it and the one that ends it, name that interval.  In each interval with two
places or more the place of the least (id, line) stays and the lines of the others are deleted;
overlapping and touching deletions merge to the maximal repeated runs.  So every line of a
repeated run of at least ``min_words`` words whose run also stands earlier is deleted, and no
other.

Words of a line are its spaces plus one after trimming.  Defined results: null and empty texts
lose nothing; repeated rows of one id and text are one document and lose the same lines; of two
texts of one id the one of the lesser hash comes first; rows without an id lose nothing and
count as no copy; an empty table yields no rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.llm._common import Tables, free_name, table, tidy

MIN_WORDS = 50


def _line_ids(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows ``id, t, i, at, w, h, g``: the i-th non-blank line of a text, its line number ``at``,
    words ``w`` and 128 bits ``h, g``; ``t`` tells texts of one id apart."""
    trimmed = F.transform(F.split(F.col(text), "\n", -1), lambda x, k: F.struct(k.alias("at"), F.trim(x, F.lit(" \t\r\x0b\x0c")).alias("line")))
    base = docs.where(F.col(id).isNotNull() & (F.length(text) > 0)).select(F.col(id).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.filter(trimmed, lambda x: F.length(x["line"]) > 0)).alias("i", "x"))
    line = F.col("x.line")
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return base.select("id", "t", "i", F.col("x.at").alias("at"), (spaces + 1).alias("w"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def _ranked(tables: Tables, keys: DataFrame, *by: str) -> DataFrame:
    """A rank for each key that occurs twice or more: its place in their sorted order."""
    shared = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*by)
    return tables.keep(shared.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def suffix_ranks(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, tables: Tables | None = None) -> tuple[DataFrame, list[str]]:
    """Lines that stand twice or more, with the ranks of their suffixes, and the ranks' names.

    Rows ``id, t, i, at, w, part, r0, r1, ...``: ``part`` numbers stretches of such lines and
    ``rK`` ranks the suffix by its first 2^K lines (null: no other suffix shares them).
    """
    tables = tables or Tables(docs.sparkSession)
    lines = _line_ids(docs, id, text)
    ranks = _ranked(tables, lines.select("h", "g"), "h", "g")
    shared = lines.join(ranks.withColumnRenamed("rank", "r0"), ["h", "g"]).select("id", "t", "i", "at", "w", "r0").dropDuplicates(["id", "t", "i"])
    rows = tables.keep(shared.withColumn("part", F.col("i") - F.row_number().over(Window.partitionBy("id", "t").orderBy("i"))))
    tables.drop(ranks)
    names, order = ["r0"], Window.partitionBy("id", "t", "part").orderBy("i")
    while 1 << len(names) <= min_words:  # a run of enough words has at most min_words lines
        half, last, name = 1 << (len(names) - 1), names[-1], f"r{len(names)}"
        pairs = rows.withColumn("behind", F.lead(last, half).over(order))
        ranks = _ranked(tables, pairs.where(F.col(last).isNotNull() & F.col("behind").isNotNull()).select(last, "behind"), last, "behind")
        more = tables.keep(pairs.join(ranks.withColumnRenamed("rank", name), [last, "behind"], "left").select("id", "t", "i", "at", "w", "part", *names, name))
        tables.drop(rows, ranks)  # what a finished round has read goes at once
        rows = more
        names.append(name)
    return rows, names


def _runs(rows: DataFrame, names: list[str], min_words: int) -> DataFrame:
    """Rows ``id, t, n, a, z, start, stop``: the shortest runs of enough words that may stand twice.

    ``n, a, z`` name the interval of the suffix array: the number of lines and the ranks of the
    doubled runs that begin and end the run.
    """
    order = Window.partitionBy("id", "t", "part").orderBy("i")
    rows = rows.withColumn("e", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.col("e") - F.col("w"))
    begun = F.struct("at", "b", *names)  # ranks of the doubled runs that begin at a line ...
    ended = F.struct("at", "e", *[F.lag(x, (1 << k) - 1).over(order).alias(x) for k, x in enumerate(names)])  # ... and that end there
    rows = rows.select("id", "t", "part", "b", "e", begun.alias("begun"), ended.alias("ended"))
    # words before and up to a line grow with it, so frames of min_words words are ranges of them
    ahead = Window.partitionBy("id", "t", "part").orderBy("b").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("id", "t", "part").orderBy("e").rangeBetween(1 - min_words, 0)
    rows = rows.withColumn("n_ahead", F.count(F.lit(1)).over(ahead)).withColumn("last", F.last("ended").over(ahead))
    rows = rows.withColumn("n_behind", F.count(F.lit(1)).over(behind)).withColumn("first", F.first("begun").over(behind))

    def run(first: str, last: str, n: str) -> Column:
        a = z = None
        for k, x in reversed(list(enumerate(names))):
            a, z = ((F.col(c)[x] if own is None else F.when(F.col(n) < 2 << k, F.col(c)[x]).otherwise(own)) for c, own in ((first, a), (last, z)))
        valid = (F.col(last)["e"] - F.col(first)["b"] >= min_words) & a.isNotNull() & z.isNotNull()
        return F.when(valid, F.struct(F.col(n).alias("n"), a.alias("a"), z.alias("z"), F.col(first)["at"].alias("start"), (F.col(last)["at"] + 1).alias("stop")))

    return rows.select("id", "t", F.inline(F.array_compact(F.array(run("begun", "last", "n_ahead"), run("first", "ended", "n_behind")))))


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: ``id``, ``t`` (hash of the text) and ``cuts``, ascending disjoint [start, stop) line numbers."""
    with tidy(docs.sparkSession) as tables:
        rows, names = suffix_ranks(docs, id, text, min_words, tables)
        runs = tables.keep(_runs(rows, names, min_words))
        tables.drop(rows)
        place = F.struct("id", "t", "start")
        first = tables.keep(runs.groupBy("n", "a", "z").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
        later = tables.keep(runs.join(first, ["n", "a", "z"]).where(place > F.col("first")).groupBy("id", "t", "start").agg(F.max("stop").alias("stop")))
        tables.drop(runs, first)
    # runs that overlap or touch merge; a window over one document's own runs
    order = Window.partitionBy("id", "t").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = later.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("g", F.sum("opens").over(order))
    merged = merged.groupBy("id", "t", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))


def _cut(docs: DataFrame, id: str, text: str, min_words: int) -> DataFrame:
    """Rows ``row`` (a struct of the columns), ``cuts`` and ``left`` (the text without them)."""
    cuts = repeated_lines(docs, id, text, min_words).withColumnRenamed("id", "cut_id").withColumnRenamed("t", "cut_t")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own, whole = F.col("row")[id], F.col("row")[text]
    both = rows.join(cuts, (own == F.col("cut_id")) & (F.xxhash64(whole) == F.col("cut_t")), "left")
    lines = F.split(whole, "\n", -1)

    def kept(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("cuts", k - 1)["stop"])
        stop = F.when(k == F.size("cuts"), F.size("lines")).otherwise(F.get("cuts", k)["start"])
        return F.slice("lines", begin + 1, stop - begin)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), kept)), "\n")
    both = both.withColumn("lines", F.when(F.col("cuts").isNotNull(), lines))
    return both.select("row", "cuts", F.when(F.col("cuts").isNull(), whole).otherwise(left).alias("left"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies cut from ``text``, and the column ``cuts`` (null: nothing cut;
    named ``cuts_`` where ``docs`` has a column ``cuts``)."""
    out = _cut(docs, id, text, min_words)
    whole = [F.col("left" if c == text else f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*whole, F.col("cuts").alias(free_name(docs, "cuts")))


def clean_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies, and without texts of which nothing but white space is
    left; a column ``length`` gets the new number of characters of texts that were cut."""
    out = _cut(docs, id, text, min_words).where("cuts is null or left rlike '\\\\S'")
    new = {text: F.col("left")}
    if length:
        kind = docs.schema[length].dataType
        new[length] = F.when(F.col("cuts").isNull(), F.col("row")[length]).otherwise(F.length("left").cast(kind))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut from every document of ``documents`` and the hash of the text left.

    Columns: ``doc_id``, ``n_lines``, ``n_cut``, ``cuts`` (``start-stop`` line numbers, comma-joined)
    and ``text_sha256``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long")
    out = dedup_lines(docs.withColumn("n_lines", n_lines))
    spans = F.transform("cuts", lambda c: F.concat_ws("-", c["start"].cast("string"), c["stop"].cast("string")))
    cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + (c["stop"] - c["start"]))
    return out.select("doc_id", "n_lines", F.coalesce(cut, F.lit(0).cast("long")).alias("n_cut"), F.coalesce(F.array_join(spans, ","), F.lit("")).alias("cuts"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
