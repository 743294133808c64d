"""Odd rows and columns: repeated rows, null ids, extra columns named like the operators' own."""

import numpy as np
import pyarrow as pa

from patternloom.llm import decontaminate, licences, ngram, pii, urls
from patternloom.llm._common import summed_arrays, tidy


def test_sums_and_bitmaps_run_their_source_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def parts(batches):
        runs.add(1)
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([np.ones(2000, np.int64).tobytes()] * 64, pa.binary())], ["part", "data"])

    def ids(batches):
        runs.add(1)
        yield from batches

    with tidy(spark):
        got = summed_arrays(spark.range(0, 8, 1, 4).mapInArrow(parts, "part int, data binary"))
        assert sorted(got) == list(range(64)) and all((x == 4).all() for x in got.values()) and runs.value == 4
        bits = ngram._bits_of(spark.range(0, 1000, 1, 4).mapInArrow(ids, "id long"), 1 << 23)
    assert 900 < np.unpackbits(np.frombuffer(bits, np.uint8)).sum() <= 1000 and runs.value == 8


def test_pii_repeated_rows_and_null_ids_are_scanned_each(spark):
    text = "write to ann@example.com or +49 170 1234567"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (2, "")], "doc_id long, text string")
    rows = pii.find_spans(docs).collect()
    found = [tuple((s["kind"], s["start"], s["stop"]) for s in r.base_spans) for r in rows]
    assert len(rows) == 5 and sorted(map(len, found)) == [0, 0, 2, 2, 2] and len({f for f in found if f}) == 1


def test_contamination_with_columns_of_its_own_names(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    benchmark = spark.createDataFrame([(7, item, "x", 1)], "item_id long, text string, doc_id string, n_items int")
    docs = spark.createDataFrame([(1, f"so {item} it goes", "a", 9, 0.5, 3), (2, "nothing here", None, None, None, None)], "doc_id long, text string, item_ids string, n_items int, max_score double, row int")
    assert {r.doc_id: (r.n_items, r.item_ids) for r in decontaminate.contamination(docs, benchmark).collect()} == {1: (1, "7"), 2: (0, "")}
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.schema == docs.schema and [tuple(r) for r in clean.collect()] == [(2, "nothing here", None, None, None, None)]


def test_contamination_in_pieces_with_columns_of_its_own_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 40)
    item = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    benchmark = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {item} it goes", 5, "a"), (None, item, 6, "b")], "doc_id long, text string, row int, item_ids string")
    got = {(r.doc_id, r.n_items, r.item_ids) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got == {(1, 2, "7,8"), (None, 2, "7,8")}


def test_urls_with_columns_of_its_own_names_and_null_ids(spark):
    pages = spark.createDataFrame(
        [(None, "https://a.org/x", "h", "p", "k", 1, "r", "v"), (3, "https://b.com/de/", "h", None, None, None, None, None), (3, "https://b.com/de/", "h", None, None, None, None, None)],
        "page_id long, url string, host string, path string, key string, size int, rule string, verdict string",
    )
    rows = sorted(map(str, map(tuple, urls.judge(pages, urls.RULES).collect())))
    assert rows == sorted(map(str, [(None, "a.org", "/x", "org/", "allow")] + 2 * [(3, "b.com", "/de/", "com/de/", "block")]))


def test_licences_with_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "released under the MIT license", 5, "a", "b", 2.0, 7)], "doc_id long, text string, n_words int, labels string, base_labels string, score double, n_base int")
    row = licences.scan(docs).first()
    assert (row.n_words, row.n_base, row.first_word, row.base_labels) == (5, 1, 1, "mit")
