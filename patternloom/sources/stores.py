"""Per-owner run store, definition store, archives, reports.

Runs are an append-only table of events (saved or deleted); the last event of an id is its
state, so saves and deletes never rewrite data.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "id long, owner string, saved_ns long, config string, report string, deleted boolean, version int"
VERSION = 2
PREFIX = "patternloom-run:"


class RunStore:
    """Saved runs under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _events(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)
        except Exception as e:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RUN_SCHEMA)

    def _runs(self, owner: str | None) -> DataFrame:
        last = Window.partitionBy("id").orderBy(F.desc("saved_ns"), F.desc("deleted"))
        live = self._events().where(F.col("owner") == F.lit(owner or "")).withColumn("_n", F.row_number().over(last))
        return live.where("_n = 1 AND NOT deleted").drop("_n", "deleted")

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def save(self, owner: str | None, config: dict, report: dict, id: int | None = None) -> int:
        """Save or replace a run; anonymous callers are rejected."""
        if not owner:
            raise PermissionError("an anonymous caller cannot save")
        if id is None:
            id = (self._events().agg(F.max("id")).first()[0] or 0) + 1
        self._append(id, owner, time.time_ns(), json.dumps(config), json.dumps(report), False, VERSION)
        return id

    def list(self, owner: str | None) -> DataFrame:
        return self._runs(owner).orderBy(F.desc("saved_ns"), F.desc("id"))

    def summaries(self, owner: str | None) -> DataFrame:
        return self.list(owner).select("id", "saved_ns", F.concat_ws(" / ", F.get_json_object("config", "$.name"), F.get_json_object("config", "$.direction")).alias("summary"))

    def get(self, owner: str | None, ids: list[int]) -> DataFrame:
        """Runs in the order asked for; missing and foreign ids are left out."""
        asked = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos long, id long")
        return asked.join(self._runs(owner), "id").orderBy("pos").drop("pos")

    def delete(self, owner: str | None, id: int) -> bool:
        if self.get(owner, [id]).isEmpty():
            return False
        self._append(id, owner, time.time_ns(), None, None, True, VERSION)
        return True

    def execute(self, owner: str | None, request: str) -> dict:
        """``{"entity": "savedRun", "limit": n}`` over the caller's rows; one row more tells ``hasMore``."""
        asked = json.loads(request)
        if asked.get("entity") != "savedRun":
            raise ValueError("unknown entity")
        n = int(asked.get("limit", 50))
        rows = self.list(owner).limit(n + 1).collect()
        return {"rows": [[{"name": k, "value": v} for k, v in r.asDict().items()] for r in rows[:n]], "hasMore": len(rows) > n}


class DefinitionStore:
    """One document of definitions per owner, as an appended log: the newest entry of an owner counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, owner: str | None, document: str | None) -> None:
        if not owner:
            raise PermissionError("an anonymous caller has no definitions")
        self.spark.createDataFrame([(owner, time.time_ns(), document)], "owner string, saved_ns long, document string").coalesce(1).write.mode("append").parquet(self.path)

    def save(self, owner: str | None, document: dict | list) -> None:
        self._append(owner, json.dumps(document))

    def delete(self, owner: str | None) -> None:
        self._append(owner, None)

    def get(self, owner: str | None):
        """The owner's document, or None."""
        try:
            log = self.spark.read.schema("owner string, saved_ns long, document string").parquet(self.path)
        except Exception as e:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        row = log.where(F.col("owner") == F.lit(owner or "")).agg(F.max_by("document", "saved_ns").alias("document"), F.max_by(F.col("document").isNull(), "saved_ns").alias("gone")).first()
        return None if row.gone or row.document is None else json.loads(row.document)


#: Columns that each version of the run table added, with the value that older rows get.
MIGRATIONS: dict[int, dict[str, object]] = {1: {"deleted": False}, 2: {"version": 1}}


def migrated(runs: DataFrame, version: int) -> DataFrame:
    """A run table of an older version with the columns of all later ones."""
    for step in sorted(v for v in MIGRATIONS if v > version):
        for name, default in MIGRATIONS[step].items():
            value = F.lit(default)
            runs = runs.withColumn(name, value if name not in runs.columns else F.coalesce(F.col(name), value))
    return runs


def encode_run(run: dict) -> str:
    """Archive text of a run; bars are left out."""
    return PREFIX + json.dumps({"version": VERSION, "run": {k: v for k, v in run.items() if k != "bars"}})


def decode_run(text: str) -> dict:
    if not text.startswith(PREFIX):
        raise ValueError("not a run archive")
    doc = json.loads(text[len(PREFIX) :])
    if doc.get("version", 1) > VERSION:
        raise ValueError("a newer version wrote this archive")
    return doc["run"]


def merged_definitions(*tables: DataFrame) -> DataFrame:
    """Union of definition tables (key, updated_at, body, confidence): the newest of a key stays."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    newest = whole.groupBy("key").agg(F.max_by(F.struct(*[c for c in whole.columns if c != "key"]), "updated_at").alias("d")).select("key", "d.*")
    return newest.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))


def markdown_report(patterns: DataFrame, title: str = "Research report", most: int = 10) -> str:
    """Sections over the best patterns; ``most`` rows reach the driver."""
    rows = patterns.orderBy(F.desc("win_rate"), "pattern_id").limit(most).collect()
    lines = [f"# {title}", "", f"{patterns.count()} patterns were evaluated.", "", "## Best patterns", "", "| pattern | direction | samples | win rate | mean move |", "|-|-|-|-|-|"]
    lines += [f"| {r.pattern_id} | {r.direction} | {r.n} | {r.win_rate:.1f} % | {r.avg_move:.2f} % |" for r in rows]
    return "\n".join(lines) + "\n"


def write_bundle(path: str, **parts: DataFrame) -> None:
    """Each part as a JSON-lines folder; bars never belong to a bundle."""
    for name, df in parts.items():
        df.drop("bars").write.mode("overwrite").json(f"{path}/{name}")


def save_workspace(path: str, **parts: DataFrame) -> None:
    """Checkpoint of named tables with a version marker."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    next(iter(parts.values())).sparkSession.createDataFrame([(VERSION, ",".join(parts))], "version int, parts string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def load_workspace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    head = spark.read.json(f"{path}/_manifest").first()
    if head.version != VERSION:
        raise ValueError("the workspace has another version")
    return {name: spark.read.parquet(f"{path}/{name}") for name in head.parts.split(",")}
