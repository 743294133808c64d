"""Exact dedup, filter audit and centroid clusters against brute force, with odd inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.llm import audit, clusters, exact

LONG = "word " * 40_000
TEXTS = [
    "a b", "a\t\n b", " a b", "a b ", "a  b", "", None, " ", "\n\n", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1", "ab c", "a bc", LONG, LONG + "end", LONG.replace(" ", "\n"), "é b", "A b", "a b", "a\x0bb", "a\x1cb",
]


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def documents(spark):
    rows = [(i + 5, t, i) for i, t in enumerate(TEXTS)] + [(3, "é b", 0), (3, "é b", 1), (40, "é b", 2), (None, "é b", 3), (None, "alone", 4), (None, "alone", 5), (41, "one of its kind", 6)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row int")


@pytest.mark.parametrize("digests", [True, False])
def test_exact_duplicates_equal_brute_force(spark, digests):
    rows, docs = documents(spark)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[plain(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i != keep, i is None, i or 0))):
            want[(i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in exact.duplicates(docs, digests=digests).select("doc_id", "keep_id", "group_size", "kept", "full").collect())
    if not digests:  # only texts that share length and prefix are hashed whole
        assert all(r[4] is not None for r in got if r[2] > 1) and any(r[4] is None for r in got)
        want, got = (Counter(r[:4] for r in x.elements()) for x in (want, got))
    assert got == want


def test_exact_dedup_keeps_rows_of_the_least_id_and_all_columns(spark):
    rows, docs = documents(spark)
    names = ["n", "p", "bits", "full", "lives"]
    out = exact.dedup(docs.select("*", *[F.lit(k).alias(k) for k in names]))
    assert out.columns == ["doc_id", "text", "row", *names]
    got = out.collect()
    assert sorted(plain(r.text) for r in got) == sorted({plain(t) for _, t, _ in rows})
    least = {}
    for i, t, _ in rows:
        least.setdefault(plain(t), []).append(i)
    assert all(r.doc_id == min((i for i in least[plain(r.text)] if i is not None), default=None) and (r.doc_id, r.text, r.row) in rows for r in got)
    assert exact.duplicates(docs.limit(0)).count() == 0 and exact.dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ filter audit


def test_filter_audit_equals_brute_force(spark):
    wide = " ".join(f"w{k}" for k in range(120))
    texts = [wide, wide, wide + " $", "few", None, "", "ABC DEF", wide.upper(), "w " * 150, "w " * 150 + "& B", wide + " new", wide + " new", "few", None, " \n", "few"]
    rows = [(i, t, [None, "", "en", "de"][i % 4], i) for i, t in enumerate(texts)] + [(None, "few", "en", 0), (None, wide, "en", 0), (3, "few", "de", 0), (3, "few", "de", 1), (100, wide * 400, "fr", 0)]
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (4, 1, None), (7, 1, 1), (9, None, 1), (9, 0, 0), (12, 1, 1), (None, 1, 1), (3, 1, 0), (999, 1, 1)]
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marks = defaultdict(lambda: (False, False))
    for i, q, x in labels:
        if i is not None:
            marks[i] = (marks[i][0] or q == 1, marks[i][1] or x == 1)

    def fails(i, t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}

    docs = [(p or "", fails(i, t or ""), *(marks[i] if i is not None else (False, False))) for i, t, p, _ in rows]
    want, parts = {}, {d[0] for d in docs}
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            for k, f in enumerate(order):
                mine = [d for d in docs if d[0] == part]
                gone = [any(d[1][g] for g in order[:k]) for d in mine]
                here = [d for d, g in zip(mine, gone) if not g and d[1][f]]
                want[part, order, k + 1] = [sum(not g and not d[1][f] for d, g in zip(mine, gone)), len(here), sum(g and d[1][f] for d, g in zip(mine, gone)), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)]
    shapley = defaultdict(int)
    for (part, order, k), v in want.items():
        shapley[part, order[k - 1]] += v[1]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, print int")
    got = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(want) == 600 * len(parts)
    for r in got:
        key = (r.part, r.filter_order, r.step)
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[key] and r.shapley == shapley[r.part, r.filter_order[r.step - 1]], key
    assert audit.audit(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_has_eighty_edges(spark):
    on = audit.edges(spark.createDataFrame([("x", 0, False, False, 1)], "part string, failed int, good boolean, toxic boolean, n long"))
    assert on.count() == 80 and on.select("applied", "nxt").distinct().count() == 80


# ------------------------------------------------------------------ clusters


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e15 else 64 * int(x) for x in map(float, v)], v) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    centroids = [x for _, x, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[2]))[:k]]
    for turn in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x, _ in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x, _), a in zip(kept, at) if a == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    d = [far(x, centroids[a]) for (_, x, _), a in zip(kept, at)]
    fit = lambda v: v if v < 1 << 63 else None
    own = [sum(y for y, b in zip(d, at) if b == a) for a in at]
    return sorted(((i, a, fit(y), fit(o), fit(sum(d)), [str(c) for c in centroids[a]]) for (i, _, _), a, y, o in zip(kept, at, d, own)), key=str)


def made(spark, rows, kind="double"):
    out = clusters.cluster(spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string"), block_rows=37)
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()), key=str)


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=64) / 8]) for i in range(150)]
    rows += [(200 + i, [float(i % 2)] * 64) for i in range(40)]  # ties
    rows += [(300, None), (301, [0.5] * 63), (302, [0.5] * 63 + [None]), (303, [0.5] * 63 + [float("nan")]), (304, [float("inf")] * 64), (305, []), (None, [0.1] * 64), (7, [0.25] * 64), (7, rows[7][1]), (310, [-0.0] * 64), (311, [-1e-9] * 64)]
    assert made(spark, rows, "float") == made(spark, rows) == brute_clusters(rows)
    assert made(spark, rows[:5]) == brute_clusters(rows[:5])
    assert made(spark, []) == []


def test_clusters_of_great_numbers_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=64) * 10.0 ** (i % 12)]) for i in range(40)] + [(50, [1e300] * 64), (51, [-1e300] * 64), (52, [1e300] * 64)]
    assert made(spark, rows) == brute_clusters(rows)


def test_bounds_skip_distances_and_lose_nothing():
    r = np.random.default_rng(6)
    middle = r.integers(-400, 400, (8, 64))
    x = (middle[r.integers(0, 8, 3000)] + r.integers(-9, 10, (3000, 64))).astype(np.int64)
    c = x[:16].copy()
    cluster, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), 16))
    taken = []
    for turn in range(4):
        taken.append(clusters.assign(x, c, cluster, upper, lower))
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()  # the first of equal ones
        exact_root = np.sqrt(d.astype(float))
        assert (upper >= exact_root[np.arange(len(x)), cluster]).all() and (lower <= exact_root).all()
        new = c.copy()
        for j in range(16):
            if (cluster == j).any():
                new[j] = x[cluster == j].sum(0) // (cluster == j).sum()
        clusters.moved(c, new, cluster, upper, lower)
        c = new
    assert taken[0] < 0.7 * x.shape[0] * 16 and max(taken[2:]) < 0.3 * x.shape[0] * 16
