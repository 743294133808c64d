"""Delimited text to bars, vendor JSON to bars, a seeded sample, and file sinks."""

from __future__ import annotations

import csv
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Header names of the standard columns, matched without spaces, ``_`` and ``-``.
ALIASES = {
    "timestamp": ("timestamp", "time", "date", "datetime", "ts"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c", "adjclose", "price"), "volume": ("volume", "vol", "v"),
}
SEPARATORS = (",", "\t", ";", "|")
SAMPLE_ROWS = 200


def normalized(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_")


def unique_keys(headers: list[str]) -> list[str]:
    """Normalized keys; repeats get ``__2``, ``__3`` ..."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        key = normalized(h) or "column"
        seen[key] = seen.get(key, 0) + 1
        out.append(key if seen[key] == 1 else f"{key}__{seen[key]}")
    return out


def sniff(line: str) -> str:
    """The separator that occurs most in a header line."""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


#: Names of the files that a folder scan reads, in either case.
DATA_FILES = "*.{[cC][sS][vV],[tT][xX][tT],[mM][dD]}"


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text under unique normalized keys, and ``source_file``; files of one header.

    Of a folder, the files named ``.csv``, ``.txt`` or ``.md`` are read.
    """
    paths = [paths] if isinstance(paths, str) else paths
    head = spark.read.option("pathGlobFilter", DATA_FILES).text(paths).where("length(trim(value)) > 0").first()[0]
    return _read_under(spark, paths, head)


def _read_under(spark: SparkSession, paths: list[str], head: str) -> DataFrame:
    sep = sniff(head)
    keys = unique_keys(next(csv.reader([head], delimiter=sep)))
    raw = spark.read.option("header", True).option("sep", sep).option("pathGlobFilter", DATA_FILES).schema(", ".join(f"`{k}` string" for k in keys)).csv(paths)
    return raw.withColumn("source_file", F.input_file_name())


def layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by header line (the first line with text); files without a line after it are left out.

    One job reads the first block of each file; what returns is a line and a name per file.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at")).where("block = 0 AND length(trim(value)) > 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    found: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        found.setdefault(row.head.lstrip("\ufeff").strip(), []).append(row.file)
    return found


def folder_bars(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Bars of files that may differ in header: one dataset per file, columns that a file lacks are null.

    A layout without times or numbers makes no bars; None where no file makes any.
    """
    parts = []
    for head, files in layouts(spark, paths).items():
        raw = _read_under(spark, files, head)
        types = column_types(raw)
        roles = detected(list(types))
        if "timestamp" in roles and ("close" in roles or "numeric" in types.values()):
            parts.append(to_bars(raw))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def stream_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 64, **trigger) -> StreamingQuery:
    """Watch a folder: bars of each arriving ``.csv``, ``.txt`` or ``.md`` file go to ``out``, once.

    The stream carries only names of files, ``files_per_batch`` at a time; each batch is read and written by
    Spark like a batch scan, under ``out/batch=<id>``, and a batch that is repeated after a failure takes the
    place of its own output.  ``trigger`` is that of ``DataStreamWriter.trigger``, by default all that is there.
    """
    names = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", DATA_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    )

    def arrived(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        bars = folder_bars(batch.sparkSession, paths) if paths else None
        if bars is not None:
            bars.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return names.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streamed_bars(spark: SparkSession, out: str) -> DataFrame:
    """The bars that ``stream_folder`` has written so far."""
    return spark.read.option("mergeSchema", True).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def detected(columns: list[str]) -> dict[str, str]:
    """First column that matches each alias."""
    compact = {c: re.sub(r"[\s_-]", "", c.lower()) for c in columns}
    return {k: next(c for c in columns if compact[c] in names) for k, names in ALIASES.items() if any(compact[c] in names for c in columns)}


def parsed_number(name: str) -> Column:
    """Thousands commas go; empty, unreadable and NaN are null."""
    return F.expr(f"CASE WHEN NOT isnan(try_cast(nullif(regexp_replace(trim(`{name}`), ',', ''), '') AS double)) THEN try_cast(nullif(regexp_replace(trim(`{name}`), ',', ''), '') AS double) END")


def parsed_time(name: str) -> Column:
    """Epoch milliseconds: digits below 1e11 are seconds, others milliseconds, else an ISO time (UTC)."""
    return F.expr(
        f"CASE WHEN trim(`{name}`) RLIKE '^[0-9]+([.][0-9]+)?$' THEN CAST(CASE WHEN CAST(trim(`{name}`) AS double) < 1e11 THEN CAST(trim(`{name}`) AS double) * 1000 ELSE CAST(trim(`{name}`) AS double) END AS bigint) "
        f"ELSE unix_millis(try_to_timestamp(`{name}`)) END"
    )


def column_types(raw: DataFrame) -> dict[str, str]:
    """time, ohlcv, numeric or unknown, from aliases and the first 200 rows (one small job)."""
    names = [c for c in raw.columns if c != "source_file"]
    roles = {c: k for k, c in detected(names).items()}
    row = raw.limit(SAMPLE_ROWS).agg(*[F.max(parsed_number(c).isNotNull()).alias(c) for c in names]).first()
    return {c: "time" if roles.get(c) == "timestamp" else "ohlcv" if c in roles else "numeric" if row[c] else "unknown" for c in names}


def to_bars(raw: DataFrame, dataset_id: str | Column = "source_file") -> DataFrame:
    """Bars from text columns: rows without time or price go, the rest is ordered by time.

    Without a full set of prices the outcome column (close, else the first numeric) stands for
    all four; a missing volume is 0.  Other numeric columns follow.
    """
    types = column_types(raw)
    roles = detected(list(types))
    outcome = roles.get("close") or next(c for c, t in types.items() if t == "numeric")
    full = all(k in roles for k in ("open", "high", "low", "close"))
    price = {k: parsed_number(roles[k] if full else outcome).alias(k) for k in ("open", "high", "low", "close")}
    extra = [parsed_number(c).alias(c) for c, t in types.items() if t == "numeric" and c not in roles.values()]
    volume = F.coalesce(parsed_number(roles["volume"]), F.lit(0.0)) if "volume" in roles else F.lit(0.0)
    own = F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id
    out = raw.select(own.alias("dataset_id"), parsed_time(roles["timestamp"]).alias("ts_ms"), *price.values(), volume.alias("volume"), *extra, F.monotonically_increasing_id().alias("_row"))
    out = out.where("ts_ms IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    order = Window.partitionBy("dataset_id").orderBy("ts_ms", "_row")
    return out.withColumn("bar_index", (F.row_number().over(order) - 1).cast("long")).drop("_row")


def instrument_key(name: str) -> str:
    """File name without extension, timeframe and leading number: the key that timeframes share."""
    stem = re.sub(r"\.(csv|txt|md)$", "", name.rsplit("/", 1)[-1], flags=re.I)
    parts = [p for p in re.split(r"[_\s-]+", stem) if p and not re.fullmatch(r"\d+[smhdwMSHDW]?|[mhdwMHDW]\d+", p)]
    return normalized("_".join(parts))


def chart_json(df: DataFrame, column: str) -> DataFrame:
    """Rows of a vendor's chart document: parallel arrays zipped; rows with a missing price go."""
    shape = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
    doc = F.from_json(column, shape)
    row = F.explode(F.arrays_zip(*[doc[k].alias(k) for k in ("timestamp", "open", "high", "low", "close", "volume")])).alias("r")
    return df.select(row).select((F.col("r.timestamp") * 1000).alias("ts_ms"), *[F.col(f"r.{k}").alias(k) for k in ("open", "high", "low", "close", "volume")]).dropna(subset=["ts_ms", "open", "high", "low", "close"])


def sample_bars(spark: SparkSession, days: int = 250, per_day: int = 78, seed: int = 20240117) -> DataFrame:
    """Seeded five-minute bars with volatility regimes and a U-shaped volume (UTC)."""
    r = np.random.Generator(np.random.PCG64(seed))
    n = days * per_day
    regime = np.repeat(np.where(r.random(-(-days // 10)) < 0.3, 2.0, 1.0), 10)[:days].repeat(per_day)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.0009, n) * regime))
    open_ = np.concatenate(([100.0], close[:-1]))
    spread = np.abs(r.normal(0, 0.0006, (2, n))) * regime * close
    slot = np.tile(np.linspace(-1, 1, per_day), days)
    day = np.repeat(np.arange(days), per_day)
    ts = 1_704_205_800_000 + (day // 5 * 7 + day % 5) * 86_400_000 + np.tile(np.arange(per_day), days) * 300_000
    frame = pd.DataFrame({"dataset_id": "sample", "bar_index": np.arange(n), "ts_ms": ts, "open": open_, "high": np.maximum(open_, close) + spread[0], "low": np.minimum(open_, close) - spread[1], "close": close, "volume": np.round(1000 * (1 + slot**2) * regime)})
    return spark.createDataFrame(frame)


def write_csv(bars: DataFrame, path: str) -> None:
    """ISO times and prices with five decimals, one header per file."""
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    bars.select(iso.alias("time"), *[F.format_string("%.5f", c).alias(c) for c in ("open", "high", "low", "close")], "volume").write.mode("overwrite").option("header", True).csv(path)
