"""Delimited text, stores, planning and wording."""

import pytest
from pyspark.sql import functions as F

from patternloom.functions import wording
from patternloom.operators import search
from patternloom.sources import delimited, stores
from patternloom.streaming.bars import stream_bars


def test_delimited_text_to_bars(spark, tmp_path):
    (tmp_path / "01_DJ30.R_15.csv").write_text("Time;Open;High;Low;Close;Vol;Signal A;Signal A\n2026-01-05T09:45:00Z;1,001;1002;999;1001.5;7;0.5;x\n2026-01-05T09:30:00Z;1000;1001;998;1000.5;;;y\nbad;1;1;1;1;1;1;z\n")
    raw = delimited.read_delimited(spark, str(tmp_path))
    assert delimited.column_types(raw) == {"time": "time", "open": "ohlcv", "high": "ohlcv", "low": "ohlcv", "close": "ohlcv", "vol": "ohlcv", "signal_a": "numeric", "signal_a__2": "unknown"}
    rows = delimited.to_bars(raw, F.lit("d")).orderBy("bar_index").collect()
    assert [(r.bar_index, r.open, r.volume, r.signal_a) for r in rows] == [(0, 1000.0, 0.0, None), (1, 1001.0, 7.0, 0.5)] and rows[0].ts_ms == 1_767_605_400_000


def _file(folder, name, text):
    """A file that appears whole."""
    (folder / f".{name}.part").write_text(text)
    (folder / f".{name}.part").rename(folder / name)


def test_streamed_folder_gives_the_rows_of_the_batch_scan(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    key = lambda df: sorted((r.dataset_id.rsplit("/", 1)[-1], r.bar_index, r.ts_ms, r.open, r.close, r.volume, r.rsi) for r in df.collect())
    _file(folder, "a.csv", "time,open,high,low,close,volume,rsi\n2026-01-05T09:45:00Z,2,3,1,2.5,7,40\n2026-01-05T09:30:00Z,1,2,1,2,,30\n")
    _file(folder, "notes.json", '{"time": 1}\n{"close": 2}\n')
    _file(folder, "empty.csv", "")
    _file(folder, "head.txt", "time,close\n")
    delimited.stream_folder(spark, str(folder), out, state).awaitTermination()
    assert key(delimited.streamed_bars(spark, out)) == [("a.csv", 0, 1_767_605_400_000, 1.0, 2.0, 0.0, 30.0), ("a.csv", 1, 1_767_606_300_000, 2.0, 2.5, 7.0, 40.0)]
    _file(folder, "B.TXT", "\nclose;date\n5;1767605400\n6;1767606300\n")
    _file(folder, "c.md", "time,open,high,low,close,volume,rsi\n2026-01-05T09:30:00Z,1,2,1,2,3,x\n")
    _file(folder, "words.txt", "no table here\njust words\n")
    delimited.stream_folder(spark, str(folder), out, state, files_per_batch=1).awaitTermination()
    files = [str(folder / n) for n in ("a.csv", "B.TXT", "c.md", "empty.csv", "head.txt", "words.txt")]
    assert key(delimited.streamed_bars(spark, out)) == key(delimited.folder_bars(spark, files))
    assert [r[0] for r in key(delimited.streamed_bars(spark, out))] == ["B.TXT", "B.TXT", "a.csv", "a.csv", "c.md"]
    delimited.stream_folder(spark, str(folder), out, state).awaitTermination()
    assert delimited.streamed_bars(spark, out).count() == 5


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    _file(folder, "a.csv", "time,close\n1767605400,2\n")
    for state in ("one", "two"):  # the second run knows nothing of the first: batch 0 is done again
        delimited.stream_folder(spark, str(folder), out, str(tmp_path / state)).awaitTermination()
    assert delimited.streamed_bars(spark, out).count() == 1


def test_folder_scan_reads_data_files_only(spark, tmp_path):
    _file(tmp_path, "a.csv", "time,close\n1767605400,2\n")
    _file(tmp_path, "a.log", "time,close\n1767605400,3\n")
    assert [r.close for r in delimited.read_delimited(spark, str(tmp_path)).collect()] == ["2"]


def test_instrument_key():
    assert {delimited.instrument_key(f"01_DJ30.R_{t}.csv") for t in ("1D", "1h", "15")} == {"dj30_r"}


def test_sniff_and_headers():
    assert delimited.sniff("a\tb\tc,d") == "\t" and delimited.unique_keys(["A b", "a-B", ""]) == ["a_b", "a_b__2", "column"]


def test_chart_json(spark):
    df = spark.createDataFrame([('{"timestamp":[1,2],"open":[1,2],"high":[1,2],"low":[1,null],"close":[1,2],"volume":[5,6]}',)], "doc string")
    assert [r.ts_ms for r in delimited.chart_json(df, "doc").collect()] == [1000]


def test_sample_bars(spark):
    bars = delimited.sample_bars(spark, days=3)
    assert bars.count() == 3 * 78 and bars.where("high < greatest(open, close) OR low > least(open, close)").isEmpty()


def test_run_store(spark, tmp_path):
    store = stores.RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(PermissionError):
        store.save(None, {}, {})
    a, b = store.save("ann", {"name": "one"}, {}), store.save("ann", {"name": "two"}, {})
    other = store.save("bob", {"name": "three"}, {})
    assert [r.id for r in store.list("ann").collect()] == [b, a] and store.list(None).isEmpty()
    assert [r.id for r in store.get("ann", [a, other, 99, b]).collect()] == [a, b]
    assert store.execute("ann", '{"entity": "savedRun", "limit": 1}')["hasMore"]
    assert store.delete("ann", a) and not store.delete("ann", a) and not store.delete("ann", other)
    assert [r.id for r in store.list("ann").collect()] == [b]


def test_definition_store(spark, tmp_path):
    store = stores.DefinitionStore(spark, str(tmp_path / "definitions"))
    assert store.get("ann") is None
    with pytest.raises(PermissionError):
        store.save(None, {})
    store.save("ann", {"rsi": 1})
    store.save("ann", {"rsi": 2})
    store.save("bob", [])
    assert store.get("ann") == {"rsi": 2} and store.get("bob") == [] and store.get(None) is None
    store.delete("ann")
    assert store.get("ann") is None and store.get("bob") == []


def test_migrations_add_columns_with_defaults(spark):
    old = spark.createDataFrame([(1, "ann")], "id long, owner string")
    assert [tuple(r) for r in stores.migrated(old, 0).collect()] == [(1, "ann", False, 1)]
    assert stores.migrated(old.selectExpr("*", "true AS deleted"), 1).first().asDict() == {"id": 1, "owner": "ann", "deleted": True, "version": 1}


def test_archive_round_trip():
    assert stores.decode_run(stores.encode_run({"name": "x", "bars": [1]})) == {"name": "x"}
    with pytest.raises(ValueError):
        stores.decode_run("{}")


def test_combinations():
    from itertools import combinations

    assert sorted(search.unrank(i, 6, 3) for i in range(20)) == sorted(combinations(range(6), 3))
    assert len(set(search.enumerate_combinations(30, 3, 100))) == 100
    assert (0, 1, 2) in search.priority_combinations([(0, "a")], [(1, "b"), (2, "c")], 20)
    kept = search.retained([{"id": i, "score": -i, "family": "f" if i < 3 else "g"} for i in range(4)], cap=3)
    assert {p["family"] for p in kept} == {"f", "g"}


def test_wording():
    assert wording.sentence([("box_event", "=", "Breakout Up"), ("rvol", ">", 1.5)]) == "box event is Breakout Up and rvol is above 1.5"
    assert wording.duration(4, 900_000) == "1 hour" and wording.fnv1a("") == "811c9dc5"
    got = wording.source_parameters('//@version=5\nindicator("T")\nlength = input.int(21, "Length")\nm = input.float(2.5)\nx = ta.ema(close, length) + ta.atr(14)')
    assert got["version"] == 5 and [i["default"] for i in got["inputs"]] == ["21", "2.5"] and got["functions"] == ["atr", "ema"]


def test_stream_bars_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars_test").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bars_test").count() == stream_bars(events).count()
