"""Filter interaction audit: what each filter removes in every order, by lattice-edge aggregation.

Filters applied so far are a node of the lattice of subsets, the next filter an edge: five filters
make 80 edges.  A document's outcome on an edge follows from the set of filters that it fails, so
documents are first counted by part, failed set and labels (at most 128 rows a part), and these
counts contribute to the 80 edges.  An order of the filters is a path of five edges; the 600 steps of
the 120 orders are joined to the aggregated edges.

The last filter asks for the least id of equal texts table-wide.  It is settled by aggregation, not by
bringing copies together: rows are counted by text hash (SHA-256), part and labels with their least
id, and of each hash only the rows of the least id pass.  A group with a third of all rows is a row
per task.

Defined results: null texts and parts count as empty; very long texts are judged whole; rows of one
id with one text are each counted and none of them repeats another; rows without an id repeat nothing
and nothing repeats them, and have no labels; of several labels of an id the greatest counts; an empty
table yields no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.llm._common import table, tidy

NAMES = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The failed filters of a text as bits, but for the one that asks for other documents."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0))


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``part, failed, good, toxic, n``: documents by part, failed set and labels."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("failed"), F.sha2(text, 256).alias("print"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    key = ["part", "failed", "good", "toxic"]
    known = rows.where("id is not null").join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    # rows lie by id after the join, so repeated rows are counted where they are
    each = known.groupBy("id", "print", *key).agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct("id", "n"))
    copies = each.groupBy("print", *key).agg(F.sum("n").alias("n"), least["id"].alias("id"), least["n"].alias("first"))
    # a text hash has one row for each part and pair of labels
    texts = copies.withColumn("least", F.min("id").over(Window.partitionBy("print")))
    passing = F.when(F.col("id") == F.col("least"), F.col("first")).otherwise(0)
    split = texts.select("part", "good", "toxic", F.inline(F.array(F.struct("failed", passing.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - passing).alias("n")))))
    no = F.lit(False)
    loose = rows.where("id is null").select("part", no.alias("good"), no.alias("toxic"), "failed", F.lit(1).cast("long").alias("n"))
    return split.unionByName(loose).groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0")


def edges(counts: DataFrame) -> DataFrame:
    """Sums of each part on the 80 edges (``applied`` set, ``nxt`` filter)."""
    lattice = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: F.struct(s.alias("applied"), f.alias("nxt"))))), lambda e: F.getbit(e["applied"], e["nxt"]) == 0)
    on = counts.select("*", F.inline(lattice))
    fails, gone = F.getbit("failed", "nxt") == 1, F.col("failed").bitwiseAND(F.col("applied")) != 0
    count = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    return on.groupBy("part", "applied", "nxt").agg(
        count(~gone & ~fails, "kept"), count(~gone & fails, "removed"), count(gone & fails, "redundant"), count(F.col("failed") == F.expr("shiftleft(1, nxt)"), "unique_fails"),
        count(~gone & fails & F.col("good"), "good_lost"), count(~gone & fails & F.col("toxic"), "toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: documents kept, removed, redundant, and what is lost."""
    spark = docs.sparkSession
    with tidy(spark) as tables:
        on = tables.keep(edges(classes(docs, labels)))
    # an edge from a set of s filters lies on s! * (4 - s)! orders
    orders = F.element_at(F.array(*[F.lit(factorial(s) * factorial(4 - s)).cast("long") for s in range(5)]), F.bit_count("applied") + 1)
    shares = on.groupBy("part", "nxt").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    paths = [("".join(p), k + 1, sum(1 << NAMES.index(c) for c in p[:k]), NAMES.index(p[k])) for p in permutations(NAMES) for k in range(5)]
    steps = spark.createDataFrame(paths, "filter_order string, step int, applied int, nxt int")  # 600 rows, whatever the corpus
    out = on.join(shares, ["part", "nxt"]).join(F.broadcast(steps), ["applied", "nxt"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters in all 120 orders over whole ``documents``, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TESTS = ["len(w) < 100", "100 * len(list_distinct(w)) < 80 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > first"]
ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM texts),
judged AS MATERIALIZED (SELECT part, [{', '.join(f'coalesce({x}, false)' for x in _TESTS)}] AS fails, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM worded d LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
sets AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
walked AS (
  SELECT s.*, o.filter_order, g.step, s.fails[ascii(o.filter_order[g.step]) - 64] AS failing, len(list_filter(s.fails, lambda f: f)) AS failures,
    len(list_filter(range(1, g.step), lambda k: s.fails[ascii(o.filter_order[k]) - 64])) > 0 AS gone
  FROM sets s, orders o, (SELECT unnest(range(1, 6)) AS step) g),
stepped AS MATERIALIZED (
  SELECT part, filter_order, cast(step AS int) AS step, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
    coalesce(sum(n) FILTER (failing AND failures = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM stepped"""
