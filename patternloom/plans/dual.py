"""Operators as relational text that Spark and DuckDB both run.

An operator is a function of a dialect and the names of its inputs that returns one SELECT.
``on`` plans it over DataFrames with Spark SQL (so Catalyst optimises the whole composition);
``text`` spells it for DuckDB, for tests and oracles.  Dialects differ only in the few
constructs below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Dialect:
    """Constructs whose spelling differs; this one is Spark's."""

    duck = False
    text_type = "string"

    def last(self, x: str, over: str) -> str:
        """Last non-null value of a window."""
        return f"last_value({x}, true) OVER ({over})"

    def items(self, x: str) -> str:
        """Array aggregate of non-null values."""
        return f"collect_list({x})"

    def count_in(self, array: str, test: str) -> str:
        """Number of elements ``v`` of an array for which ``test`` holds."""
        return f"cast(size(filter({array}, v -> {test})) AS bigint)"

    def local(self, ms: str, zone: str) -> str:
        """Wall-clock timestamp of epoch milliseconds in a zone."""
        return f"convert_timezone('UTC', '{zone}', timestampadd(MILLISECOND, {ms}, timestamp_ntz'1970-01-01 00:00:00'))"

    def epoch_ms(self, ts: str) -> str:
        return f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"

    def div(self, a: str, b: str) -> str:
        """Integer quotient rounded down, of non-negative integers."""
        return f"({a} DIV {b})"

    def slope(self, y: str, x: str) -> str:
        return f"regr_slope({y}, {x})"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def at(self, array: str, k: str) -> str:
        """Element ``k``, counted from 1."""
        return f"element_at({array}, cast({k} AS int))"

    def sorted(self, array: str) -> str:
        return f"sort_array({array})"

    def size(self, array: str) -> str:
        return f"cast(size({array}) AS bigint)"

    def weekday(self, d: str) -> str:
        """1 for Sunday to 7 for Saturday."""
        return f"dayofweek({d})"

    def json_long(self, x: str, key: str) -> str:
        return f"cast(get_json_object({x}, '$.{key}') AS bigint)"

    def series(self, lo: int, hi: str) -> str:
        """A relation ``g(k)`` to join laterally: integers from lo to hi."""
        return f"LATERAL explode(sequence({lo}, {hi})) AS g(k)"

    def values(self, rows: list[tuple], names: str) -> str:
        def lit(v):
            return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else f"cast({v} AS bigint)"

        return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names}))"


class Duck(Dialect):
    duck = True
    text_type = "varchar"

    def last(self, x, over):
        return f"last_value({x} IGNORE NULLS) OVER ({over})"

    def items(self, x):
        return f"list({x}) FILTER (WHERE {x} IS NOT NULL)"

    def count_in(self, array, test):
        return f"cast(len(list_filter({array}, lambda v: {test})) AS bigint)"

    def local(self, ms, zone):
        return f"(make_timestamp(({ms}) * 1000) AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')"

    def epoch_ms(self, ts):
        return f"(epoch_us({ts}) // 1000)"

    def div(self, a, b):
        return f"({a} // {b})"

    def quantile(self, x, q):
        return f"quantile_cont({x}, {q})"

    def at(self, array, k):
        return f"({array})[cast({k} AS bigint)]"

    def sorted(self, array):
        return f"list_sort({array})"

    def size(self, array):
        return f"cast(len({array}) AS bigint)"

    def weekday(self, d):
        return f"(dayofweek({d}) + 1)"

    def json_long(self, x, key):
        return f"cast(json_extract_string({x}, '$.{key}') AS bigint)"

    def series(self, lo, hi):
        return f"LATERAL (SELECT unnest(range({lo}, cast({hi} AS bigint) + 1)) AS k) AS g"


SPARK, DUCKDB = Dialect(), Duck()
Operator = Callable[..., str]


def on(operator: Operator, *inputs: DataFrame, **options) -> DataFrame:
    """Plan an operator over DataFrames."""
    names = [f"in{k}" for k in range(len(inputs))]
    text = operator(SPARK, *["{" + n + "}" for n in names], **options)
    return inputs[0].sparkSession.sql(text, **dict(zip(names, inputs, strict=True)))


def text(operator: Operator, *inputs: str, **options) -> str:
    """The operator as DuckDB text; an input is a relation's name or a parenthesised SELECT."""
    return operator(DUCKDB, *inputs, **options)


def rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
