"""Windows over blocks of bars, so that one dataset is many tasks.

Bars are cut into blocks of ``BLOCK`` places.  A frame of bounded length runs within blocks whose edges
are widened by the bars that it reaches (``split``).  A running sum or last value runs within blocks
and takes up what the blocks before hold: the state of each block is one row, a scan over those rows
gives each block its carry, and carry and own state are combined (``carried``).  Only the rows of
blocks, not the bars, are ordered by one task per dataset.

DuckDB gets the plain window over the whole dataset, so the two engines check each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from patternloom.plans.dual import Dialect

#: Places of a block.
BLOCK = 1024
ORDER = "PARTITION BY dataset_id ORDER BY bar_index"


def split(d: Dialect, bars: str, back: int, build: Callable[[str], str], ahead: int = 0, at: str = "bar_index", unit: int = 1) -> str:
    """``build`` over blocks of bars with ``back`` places before and ``ahead`` behind them.

    ``build`` takes a relation and returns a SELECT with ``dataset_id`` and the place ``at``; its frames
    must reach no farther.  ``unit`` is the step of places.
    """
    if d.duck:
        return build(bars)
    size = BLOCK * unit
    first = at if not ahead else f"greatest({at} - {ahead}, 0)"
    wide = f"(SELECT named_struct('own', dataset_id, 'block', block_) AS dataset_id, * EXCEPT (dataset_id, block_) FROM (SELECT *, explode(sequence({first} DIV {size}, ({at} + {back}) DIV {size})) AS block_ FROM {bars}) h) w"
    return f"SELECT dataset_id.own AS dataset_id, * EXCEPT (dataset_id) FROM ({build(wide)}) o WHERE {at} DIV {size} = dataset_id.block"


def bounded(back: int, ahead: int = 0) -> Callable:
    """Run an operator whose frames reach ``back`` and ``ahead`` bars in blocks."""

    def wrap(operator: Callable[..., str]) -> Callable[..., str]:
        @wraps(operator)
        def run(d: Dialect, bars: str, *names: str, **options) -> str:
            return split(d, bars, back, lambda b: operator(d, b, *names, **options), ahead)

        return run

    return wrap


def carried(d: Dialect, rows: str, at: str = "bar_index", unit: int = 1, block: str | None = None, **columns: tuple[str, ...]) -> str:
    """A SELECT of ``rows`` (a SELECT) with running columns: name=(``last`` or ``sum``, expression[, ``before``]).

    ``last`` is the last non-null value so far, ``sum`` the running sum (0 of nothing), with ``before``
    up to the bar before.  ``block`` names the blocks where they are not stretches of ``at``; it must
    not fall as ``at`` grows.
    """
    reach = {n: f"ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if 'before' in c else 'CURRENT ROW'}" for n, c in columns.items()}

    def running(n: str, partition: str) -> str:
        kind, x = columns[n][:2]
        over = f"{partition} {reach[n]}"
        return d.last(x, over) if kind == "last" else f"coalesce(sum({x}) OVER ({over}), 0)"

    if d.duck:
        return f"SELECT *, {', '.join(f'{running(n, f"PARTITION BY dataset_id ORDER BY {at}")} AS {n}' for n in columns)} FROM ({rows}) r"
    keyed = f"(SELECT *, {block or f'{at} DIV {BLOCK * unit}'} AS block_ FROM ({rows}) r)"
    local = ", ".join(f"{running(n, f'PARTITION BY dataset_id, block_ ORDER BY {at}')} AS {n}_own" for n in columns)
    state = ", ".join(f"max_by({c[1]}, {at}) FILTER (WHERE ({c[1]}) IS NOT NULL) AS {n}_end" if c[0] == "last" else f"sum({c[1]}) AS {n}_end" for n, c in columns.items())
    earlier = "OVER (PARTITION BY dataset_id ORDER BY block_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = ", ".join(f"last_value({n}_end, true) {earlier} AS {n}_carry" if c[0] == "last" else f"coalesce(sum({n}_end) {earlier}, 0) AS {n}_carry" for n, c in columns.items())
    both = ", ".join(f"coalesce({n}_own, {n}_carry) AS {n}" if c[0] == "last" else f"{n}_own + {n}_carry AS {n}" for n, c in columns.items())
    spent = ", ".join(f"{n}_own, {n}_carry" for n in columns)
    return f"""
    SELECT * EXCEPT (block_, {spent}), {both} FROM (
      SELECT l.*, {', '.join(f's.{n}_carry' for n in columns)} FROM (SELECT *, {local} FROM {keyed} k) l
      JOIN (SELECT dataset_id, block_, {carry} FROM (SELECT dataset_id, block_, {state} FROM {keyed} k GROUP BY dataset_id, block_) e) s ON l.dataset_id = s.dataset_id AND l.block_ = s.block_
    ) c"""


def numbered(d: Dialect, rows: str, unit: int) -> str:
    """Bars with their number in time order, from 0; ``unit`` is the usual step of time."""
    if d.duck:
        return f"SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts_ms) - cast(1 AS bigint) AS bar_index FROM ({rows}) r"
    return carried(d, rows, at="ts_ms", unit=unit, bar_index=("sum", "cast(1 AS bigint)", "before"))
