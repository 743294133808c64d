"""Benchmark decontamination: BM25 over the test items, block-max pruned, then verified.

The items (a small, size-checked set) become an inverted index.  A posting's impact is its BM25
weight divided by the item's own total, so an item scores 1 on a passage that holds all of its
words and one threshold serves all items.  Items lie in blocks; each term stores its greatest
impact per block.  Every training passage (overlapping windows of the whole text, longer than
any item of the whole benchmark) is a query: terms' overall maxima first rule out passages, block maxima then rule out
blocks, and only the postings of the blocks left are summed.  All items at or above the
threshold are retrieved; none is cut by rank.

A retrieved item counts as contamination when enough 3-word shingles of its question (the text
up to the last line break, else up to the last sentence) and of its answer (the rest) stand in
the window; a part of fewer than eight words is judged with its neighbours.  Case is ignored.

Defined results: null and empty texts hold no item; items without words match nothing; very
long texts are read whole; repeated rows and rows without an id are judged each; an empty benchmark
marks nothing; an empty table yields no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from patternloom.llm._common import U64, _BYTE, _power_tables, mix64, slices, table, written

THRESHOLD = 0.5
COVERAGE = 0.5
BLOCK = 32
#: The index must fit a worker: at most so many bytes of item text are broadcast at once.
MAX_ITEM_BYTES = 64 << 20
_K1, _B = 1.2, 0.75
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash of each run of letters, digits and non-ASCII bytes (lowered before), and first index per text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    full = _WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1] | first[1:n]
    ends[:-1] &= ~full[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix64((sums[e] - sums[s]) * inverse[s]), np.searchsorted(s, offsets)


def _of(text: str) -> np.ndarray:
    data = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), np.uint8)
    return tokens(data, np.asarray([0, len(data)]))[0]


def _shingles(h: np.ndarray, k: int = 3) -> np.ndarray:
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * U64(0x9E3779B97F4A7C15)
    return np.unique(mix64(out))


def question_and_answer(text: str) -> tuple[str, str]:
    """Split at the last line break, else before the last sentence; without either, both are the text."""
    text = text.strip()
    if "\n" in text:
        q, _, a = text.rpartition("\n")
    else:
        cut = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
        q, a = (text[: cut[-1]], text[cut[-1] :]) if cut else (text, text)
    return (q, a) if q.strip() and a.strip() else (text, text)


class Facts:
    """Items, words, longest item and document frequencies of a benchmark, added up item by item."""

    def __init__(self):
        self.items = self.words = self.longest = 0
        self.terms, self.df, self._new = np.zeros(0, U64), np.zeros(0, np.int64), []

    @classmethod
    def of(cls, texts) -> Facts:
        facts = cls()
        for text in texts:
            facts.add(text)
        return facts.settle()

    def add(self, text: str) -> None:
        h = _of(text)
        self.items, self.words, self.longest = self.items + 1, self.words + len(h), max(self.longest, len(h))
        self._new.append(np.unique(h))
        if len(self._new) >= 4096:
            self.settle()

    def settle(self) -> Facts:
        terms, at = np.unique(np.concatenate([self.terms, *self._new]), return_inverse=True)
        counts = np.concatenate([self.df, np.ones(len(at) - len(self.df), np.int64)])
        self.terms, self.df, self._new = terms, np.bincount(at, counts, len(terms)).astype(np.int64), []
        return self


class Index:
    """Impact-ordered terms of the items with block maxima, in flat arrays.

    Weights and window size come from ``facts`` of the whole benchmark (the items, if not given), so they do not depend
    on how its items are split over indexes.
    """

    def __init__(self, items: list[tuple[int, str]], facts: Facts | None = None):
        facts = facts or Facts.of(t for _, t in items)
        self.ids = np.asarray([i for i, _ in items], np.int64)
        docs = [_of(t) for _, t in items]
        lengths = np.asarray([len(d) for d in docs] or [0])
        self.longest = facts.longest
        self.parts = []
        for _, t in items:  # a part of a few words is judged with the words next to it
            q, a = (_of(p) for p in question_and_answer(t))
            whole = _of(t)
            self.parts.append((_shingles(whole[: max(len(q), 8)]), _shingles(whole[-max(len(a), 8) :])))
        term, item, tf = [], [], []
        for k, d in enumerate(docs):
            u, c = np.unique(d, return_counts=True)
            term.append(u), item.append(np.full(len(u), k)), tf.append(c)
        term = np.concatenate([*term, np.zeros(0, U64)])
        item, tf = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (item, tf))
        self.terms, t = np.unique(term, return_inverse=True)
        df = facts.df[np.searchsorted(facts.terms, self.terms)]
        idf = np.log1p((facts.items - df + 0.5) / (df + 0.5))
        impact = idf[t] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * lengths[item] / max(1.0, facts.words / max(1, facts.items))))
        impact /= np.bincount(item, impact, len(items))[item]
        block = item // BLOCK
        order = np.lexsort((item, block, t))
        self.t, self.item, self.impact, block = t[order], item[order], impact[order], block[order]
        self.best = np.zeros(len(self.terms))
        np.maximum.at(self.best, self.t, self.impact)
        edge = np.flatnonzero(np.diff(self.t, prepend=-1) | np.diff(block, prepend=-1)) if len(self.t) else np.zeros(0, np.int64)
        self.list_term, self.list_block = self.t[edge], block[edge]
        self.list_best = np.maximum.reduceat(self.impact, edge) if len(edge) else np.zeros(0)
        self.list_at = np.append(edge, len(self.t))
        self.term_at = np.searchsorted(self.list_term, np.arange(len(self.terms) + 1))
        self.blocks = len(items) // BLOCK + 1
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms & U64((1 << 20) - 1)).astype(np.int64)] = True

    def retrieve(self, h: np.ndarray, window: np.ndarray, count: int, threshold: float):
        """(window, item, score) of all items that reach the threshold; ``window`` per hit is sorted."""
        maybe = np.flatnonzero(self.filter[(h & U64((1 << 20) - 1)).astype(np.int64)])
        h, window = h[maybe], window[maybe]
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[t] == h
        pair = np.unique(window[hit] * len(self.terms) + t[hit])
        window, t = pair // len(self.terms), pair % len(self.terms)
        live = np.bincount(window, self.best[t], count) >= threshold  # no item can do better
        keep = live[window]
        window, t = window[keep], t[keep]
        lists, owner = _expand(self.term_at[t], self.term_at[t + 1])
        key = window[owner] * self.blocks + self.list_block[lists]
        blocks, at = np.unique(key, return_inverse=True)
        bound = np.bincount(at, self.list_best[lists], len(blocks))
        keep = bound[at] >= threshold
        lists, window = lists[keep], window[owner[keep]]
        posts, owner = _expand(self.list_at[lists], self.list_at[lists + 1])
        key = window[owner] * len(self.ids) + self.item[posts]
        pairs, at = np.unique(key, return_inverse=True)
        score = np.bincount(at, self.impact[posts], len(pairs))
        keep = score >= threshold
        return pairs[keep] // len(self.ids), pairs[keep] % len(self.ids), score[keep]


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = hi - lo
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), owner


def _search(x: Index, data: np.ndarray, offsets: np.ndarray, threshold: float, coverage: float) -> dict[int, dict[int, float]]:
    """Verified items of each text and their best score."""
    size, stride = max(128, 2 * x.longest), max(64, x.longest)
    h, at = tokens(data, offsets)
    found: dict[int, dict[int, float]] = {}
    if not len(h) or not len(x.terms):
        return found
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(h)) - at[text]
    # windows of a text begin at 0, stride, 2 * stride ...; a word lies in two of them
    per = np.maximum(1, -(-(np.diff(at) - (size - stride)) // stride))
    base = np.cumsum(per) - per
    last = np.minimum(place // stride, per[text] - 1)
    before = np.flatnonzero((last > 0) & (place - (last - 1) * stride < size))
    w = np.concatenate((base[text] + last, (base[text] + last - 1)[before]))
    window, item, score = x.retrieve(np.concatenate((h, h[before])), w, int(per.sum()), threshold)
    owner = np.searchsorted(base, window, side="right") - 1
    shingles: dict[int, np.ndarray] = {}
    for win, k, s, d in zip(window.tolist(), item.tolist(), score.tolist(), owner.tolist(), strict=True):
        if win not in shingles:
            begin = at[d] + (win - base[d]) * stride
            shingles[win] = _shingles(h[begin : min(begin + size, at[d + 1])])
        if all(np.isin(p, shingles[win]).mean() >= coverage for p in x.parts[k] if len(p)):
            got = found.setdefault(d, {})
            got[k] = max(s, got.get(k, 0.0))
    return found


def _lowered(batch: pa.RecordBatch, k: int):
    """Pieces of about 1 MB of lower-case text, like ``slices``; memory does not follow the batch."""
    for lo, hi, *_ in slices(batch, k, 1 << 20):
        part = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(k).slice(lo, hi - lo))], ["text"])
        for a, b, data, offsets in slices(part, 0, 1 << 40):
            yield lo + a, lo + b, data, offsets


def _judge(batches, index, threshold: float, coverage: float):
    x: Index = index.value
    for batch in batches:
        for lo, hi, data, offsets in _lowered(batch, 1):
            found = _search(x, data, offsets, threshold, coverage)
            rows = [found.get(d, {}) for d in range(hi - lo)]
            items = [sorted(int(x.ids[k]) for k in r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(map(str, r)) for r in items], pa.string()), pa.array([max(r.values(), default=None) for r in rows], pa.float64())],
                ["doc_id", "n_items", "item_ids", "max_score"],
            )


def _clean(batches, index, text: int, threshold: float, coverage: float):
    x: Index = index.value
    for batch in batches:
        for lo, hi, data, offsets in _lowered(batch, text):
            found = _search(x, data, offsets, threshold, coverage)
            yield batch.slice(lo, hi - lo).filter(pa.array([d not in found for d in range(hi - lo)], pa.bool_()))


def _indexes(benchmark: DataFrame):
    """Broadcast indexes of the items, each over at most about MAX_ITEM_BYTES of text."""
    from pyspark.sql import functions as F

    # written: the iterators below must read no shuffle, which ``tidy`` deletes as an iterator is made
    items = written(benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct())
    pieces = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // MAX_ITEM_BYTES) or 1
    facts = None if pieces == 1 else Facts.of(r.text for r in items.toLocalIterator())
    for k in range(pieces):
        part = items if pieces == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(pieces)) == k)
        rows = sorted((r.item_id, r.text) for r in part.toLocalIterator())
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows, facts))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged."""
    for index in _indexes(benchmark):
        docs = docs.mapInArrow(partial(_clean, index=index, text=docs.columns.index("text"), threshold=threshold, coverage=coverage), docs.schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id``, ``n_items``, ``item_ids`` (ascending, comma-joined) and the best score, per row."""
    from pyspark.sql import functions as F

    kind = docs.schema["doc_id"].dataType.simpleString()
    indexes = list(_indexes(benchmark))
    judged = lambda docs, key, index: docs.select(key, "text").mapInArrow(partial(_judge, index=index, threshold=threshold, coverage=coverage), f"doc_id {kind if key == 'doc_id' else 'long'}, n_items long, item_ids string, max_score double")
    if len(indexes) == 1:
        return judged(docs, "doc_id", indexes[0])
    # a larger benchmark is searched in pieces, put together by a number of each row, not by its id
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    out = reduce(DataFrame.unionByName, [judged(rows, "row", index) for index in indexes]).withColumnRenamed("doc_id", "row")
    # an id may stand in several items of a piece, so lists are joined whole; a piece holds all items of its ids
    ids = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(F.when(F.col("item_ids") != "", F.transform(F.split("item_ids", ","), lambda x: x.cast("long")))))), lambda x: x.cast("string")), ",")
    found = out.groupBy("row").agg(F.sum("n_items").alias("n_items"), ids.alias("item_ids"), F.max("max_score").alias("max_score"))
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every whole text of ``documents``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
