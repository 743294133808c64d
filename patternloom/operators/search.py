"""Driver-side planning of the pattern search: candidates, combinations, budgets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

def candidates(name: str, kind: str, buckets: list[str] | None = None, cuts: list[float] | None = None, override: dict | None = None) -> list[tuple]:
    """Conditions of one feature: equality per bucket, below and above each cut; overrides replace cuts."""
    if kind == "categorical":
        return [(name, "=", b) for b in buckets or []]
    override = override or {}
    if override.get("ranges"):
        return [(name, "between", tuple(r)) for r in override["ranges"]]
    if override.get("range"):
        lo, hi = override["range"]
        cuts = [lo + (hi - lo) * k / 5 for k in (1, 2, 3, 4)]
    cuts = override.get("thresholds") or cuts or []
    return list(dict.fromkeys((name, op, float(c)) for c in cuts for op in ("<", ">")))


def unrank(rank: int, n: int, k: int) -> tuple[int, ...]:
    """The combination of ``k`` of ``n`` with a rank in the combinatorial number system."""
    out = []
    for j in range(k, 0, -1):
        c = j - 1
        while comb(c + 1, j) <= rank and c + 1 < n:
            c += 1
        out.append(c)
        rank -= comb(c, j)
    return tuple(reversed(out))


def enumerate_combinations(n: int, k: int, cap: int) -> Iterator[tuple[int, ...]]:
    """All combinations in order or, above the cap, evenly strided ranks."""
    total = comb(n, k)
    if total <= cap:
        yield from combinations(range(n), k)
    else:
        for i in range(cap):
            yield unrank(i * total // cap, n, k)


def budgets(n: int, depth: int, cap: int) -> dict[int, int]:
    """Share of the cap for each depth, in proportion to the number of combinations."""
    totals = {k: comb(n, k) for k in range(1, depth + 1)}
    whole = sum(totals.values())
    return {k: min(t, max(1, cap * t // whole)) for k, t in totals.items()} if whole > cap else totals


def research_plan(bars: list[int], features: int) -> dict:
    """Automatic sample size, depth and budget."""
    smallest = min(bars, default=0)
    return {"min_sample": min(100, max(30, smallest // 100)), "depth": 2 if sum(bars) > 150_000 or features > 300 else 3, "max_combinations": 50_000}


def interleaved(*lists: list) -> Iterator:
    """Round robin over ordered lists, shortest exhausted first."""
    live = [iter(x) for x in lists]
    while live:
        for it in list(live):
            try:
                yield next(it)
            except StopIteration:
                live.remove(it)


def priority_combinations(triggers: list[tuple[int, str]], contexts: list[tuple[int, str]], cap: int) -> list[tuple[int, ...]]:
    """Trigger with contexts of other sources: pairs and triples, dealt in turn per trigger."""
    lists = []
    for t, source in triggers:
        other = [(c, s) for c, s in contexts if s != source and c != t]
        triples = [tuple(sorted((t, a, b))) for (a, sa), (b, sb) in combinations(other, 2) if sa != sb]
        lists.append([tuple(sorted((t, c))) for c, _ in other] + triples)
    return list(dict.fromkeys(interleaved(*lists)))[:cap]


def probe_order() -> list[dict]:
    """Loosest-first grid of the maximal-data probe."""
    return [{"win_rate": w, "sample": s, "depth": d} for w in (50, 52, 55, 60) for s in (10, 15, 20, 30) for d in (2, 3, 4)]


def retained(patterns: list[dict], cap: int = 500) -> list[dict]:
    """Best-first retention; above the cap the weakest of the fullest family makes room for a new family."""
    kept: list[dict] = []
    sizes: dict[str, int] = {}
    for p in sorted(patterns, key=lambda p: (-p["score"], p["id"])):
        if len(kept) < cap:
            kept.append(p)
        elif not sizes.get(p["family"]):
            crowded = max(sizes, key=lambda f: (sizes[f], f))
            out = next(q for q in reversed(kept) if q["family"] == crowded)
            kept.remove(out)
            sizes[crowded] -= 1
            kept.append(p)
        else:
            continue
        sizes[p["family"]] = sizes.get(p["family"], 0) + 1
    return kept


def confluent(sources: list[str], least: int) -> bool:
    return len(set(sources)) >= least


def horizon_choice(curve: list[dict]) -> int | None:
    """Eligible horizon of the greatest score; of equals the shorter."""
    best = [c for c in curve if c.get("eligible", True)]
    return min(best, key=lambda c: (-c["score"], c["horizon"]))["horizon"] if best else None
