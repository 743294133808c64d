"""DuckDB statements written apart from the operators, from the rules alone.

They read ``ev`` (one row per bar) and share no text with ``operators``: combinations come from
joins of condition rows, ranks and folds from counting, match sets are compared as lists.
"""

from __future__ import annotations

from patternloom.operators import trades as tr
from patternloom.operators import uploads as up
from patternloom.operators.catalogue import inferred
from patternloom.operators.patterns import CONDITIONS, evaluated
from patternloom.plans.dual import DUCKDB
from patternloom.sources.bars import tick_bars

_HITS = """
one AS (SELECT dataset_id AS ds, bar_index AS b, c, dx, r12 AS r, u12 AS u, w12 AS w, unnest(conds) + 1 AS k FROM ev),
hit AS (
  SELECT ds, b, c, dx, r, u, w, k AS pid FROM one
  UNION ALL SELECT x.ds, x.b, x.c, x.dx, x.r, x.u, x.w, 21 * x.k + y.k FROM one x, one y WHERE x.ds = y.ds AND x.b = y.b AND x.k < y.k
  UNION ALL SELECT x.ds, x.b, x.c, x.dx, x.r, x.u, x.w, 441 * x.k + 21 * y.k + z.k FROM one x, one y, one z WHERE x.ds = y.ds AND x.b = y.b AND x.k < y.k AND y.ds = z.ds AND y.b = z.b AND y.k < z.k),
pat AS (
  SELECT s.*, CASE WHEN up >= dn THEN 'bullish' ELSE 'bearish' END AS dir, CASE WHEN up >= dn THEN 100.0 * up / n ELSE 100.0 * dn / n END AS win, CASE WHEN up >= dn THEN bu ELSE bd END AS bl
  FROM (SELECT ds, pid, count(*) AS n, count(*) FILTER (WHERE r > 0) AS up, count(*) FILTER (WHERE r < 0) AS dn, avg(r) AS mv FROM hit WHERE r IS NOT NULL GROUP BY ds, pid) s
  JOIN (SELECT dataset_id AS ds, 100.0 * count(*) FILTER (WHERE r12 > 0) / count(*) AS bu, 100.0 * count(*) FILTER (WHERE r12 < 0) / count(*) AS bd FROM ev WHERE r12 IS NOT NULL GROUP BY dataset_id) t USING (ds))"""
_TAIL = """
tail AS (
  SELECT *, least(1.0, greatest(0.0, 2 * 0.3989423 * exp(-z * z / 2) * (0.3193815 * t - 0.3565638 * t ** 2 + 1.781478 * t ** 3 - 1.821256 * t ** 4 + 1.330274 * t ** 5))) AS p
  FROM (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM (SELECT *, abs(win / 100 - q0) / sqrt(q0 * (1 - q0) / n) AS z FROM (SELECT *, greatest(0.000001, least(0.999999, bl / 100)) AS q0 FROM pat) a) b) c)"""
_SIDES = """
won AS (SELECT h.*, p.dir, CASE p.dir WHEN 'bullish' THEN h.r > 0 ELSE h.r < 0 END AS good, h.b >= floor(0.7e0 * h.c) AS late FROM hit h JOIN pat p USING (ds, pid) WHERE h.r IS NOT NULL),
side AS (
  SELECT ds, pid, dir, count(*) FILTER (WHERE late) AS n1, count(*) FILTER (WHERE NOT late) AS n0, coalesce(100.0 * count(*) FILTER (WHERE late AND good) / nullif(count(*) FILTER (WHERE late), 0), 0) AS w1,
    coalesce(100.0 * count(*) FILTER (WHERE NOT late AND good) / nullif(count(*) FILTER (WHERE NOT late), 0), 0) AS w0, coalesce(avg(r) FILTER (WHERE late), 0) AS m1, coalesce(sum(dx) FILTER (WHERE late), 0) AS d1
  FROM won GROUP BY ds, pid, dir),
edge AS (SELECT ds, c, f, floor(c * (0.4e0 + 0.6e0 * f / 4)) AS lo, floor(c * (0.4e0 + 0.6e0 * (f + 1) / 4)) AS hi FROM (SELECT DISTINCT dataset_id AS ds, c FROM ev) x, (SELECT unnest([0, 1, 2, 3]) AS f) y),
fold AS (
  SELECT p.ds, p.pid, p.dir, e.f, count(w.b) AS n, coalesce(100.0 * count(*) FILTER (WHERE w.good) / nullif(count(w.b), 0), 0) AS rate, coalesce(avg(w.r), 0) AS mv
  FROM pat p JOIN edge e USING (ds) LEFT JOIN won w ON w.ds = p.ds AND w.pid = p.pid AND w.b >= e.lo AND w.b < e.hi GROUP BY p.ds, p.pid, p.dir, e.f),
walk AS (SELECT *, n >= 5 AND rate >= 50 AND CASE dir WHEN 'bullish' THEN mv > 0 ELSE mv < 0 END AS ok FROM fold),
held AS (
  SELECT s.ds, s.pid, k.ok, k.mean, k.worst,
    CASE WHEN s.n1 < 20 THEN 'few occurrences' WHEN s.w1 <= 50 THEN 'win rate' WHEN s.w0 - s.w1 > 10 THEN 'degraded' WHEN (s.dir = 'bullish' AND s.m1 <= 0) OR (s.dir = 'bearish' AND s.m1 >= 0) THEN 'direction' WHEN k.ok < 3 OR k.mean <= 50 THEN 'folds' ELSE 'none' END AS why
  FROM side s JOIN (SELECT ds, pid, count(*) FILTER (WHERE ok) AS ok, avg(rate) AS mean, min(rate) AS worst FROM walk GROUP BY ds, pid) k USING (ds, pid))"""

P_VALUES = f"WITH {_HITS}, {_TAIL} SELECT ds AS dataset_id, pid AS pattern_id, n, z, p FROM tail"
# the q-value of a test is the least p * tests / (tests at or below p) over the tests of its p or more
Q_VALUES = f"""
WITH {_HITS}, {_TAIL}, ranks AS (SELECT x.ds, x.pid, x.p, count(*) AS k FROM tail x JOIN tail y ON x.ds = y.ds AND y.p <= x.p GROUP BY x.ds, x.pid, x.p)
SELECT x.ds AS dataset_id, x.pid AS pattern_id, x.p, least(1.0, min(y.p * 298 / y.k)) AS q FROM ranks x JOIN ranks y ON x.ds = y.ds AND y.p >= x.p GROUP BY x.ds, x.pid, x.p"""
SCORES = f"""
WITH {_HITS}, bands(lo, hi, edge, name) AS (VALUES (30, 100, 15, 'moderate'), (100, 300, 8, 'moderate'), (100, 300, 12, 'high'), (300, 1000000000, 6, 'moderate'), (300, 1000000000, 10, 'high'), (300, 1000000000, 15, 'very high'))
SELECT ds AS dataset_id, pid AS pattern_id, n, 0.1 * log10(greatest(n, 10)) + 0.024 * greatest(0, win - bl) AS score, coalesce((SELECT arg_max(name, edge) FROM bands WHERE n >= lo AND n < hi AND win - bl >= edge), 'low') AS confidence FROM pat"""
WALK_FORWARD = f"WITH {_HITS}, {_SIDES} SELECT ds AS dataset_id, pid AS pattern_id, f AS fold, n, rate AS win_rate, mv AS move, ok AS passed FROM walk"
HELD_UP = f"WITH {_HITS}, {_SIDES} SELECT ds AS dataset_id, pid AS pattern_id, ok AS passed, mean AS mean_win, worst AS worst_win, why AS failure, CASE why WHEN 'none' THEN 'held' ELSE 'degraded' END AS status FROM held"
PER_CONDITION = f"""
WITH {_HITS}, all_rows AS (SELECT ds, k, CASE WHEN b < floor(0.7e0 * c) THEN 'in' ELSE 'out' END AS side, coalesce(r, 0) AS r FROM one)
SELECT p.ds AS dataset_id, p.pid AS pattern_id, a.k - 1 AS cond, a.side, count(*) AS n, 100.0 * count(*) FILTER (WHERE CASE p.dir WHEN 'bullish' THEN a.r > 0 ELSE a.r < 0 END) / count(*) AS win_rate, avg(a.r) AS move
FROM pat p JOIN all_rows a ON a.ds = p.ds AND a.k IN (p.pid % 21, (p.pid // 21) % 21, p.pid // 441) GROUP BY p.ds, p.pid, a.k, a.side"""
SURVIVAL = f"""
WITH {_HITS}, {_SIDES}, pairs AS (SELECT t.ds, t.pid, t.dir, t.n1, d.ds AS other FROM side t, (SELECT DISTINCT dataset_id AS ds FROM ev) d WHERE d.ds <> t.ds OR t.n1 > 0),
-- every pair of a target's pattern and a dataset is one evaluation; a dataset without late matches fails
seen AS (SELECT p.*, coalesce(s.n1 > 0 AND CASE p.dir WHEN 'bullish' THEN s.d1 > 0 ELSE s.d1 < 0 END, false) AS good FROM pairs p LEFT JOIN side s ON s.ds = p.other AND s.pid = p.pid)
SELECT ds AS dataset_id, pid AS pattern_id, count(*) AS evaluated, count(*) FILTER (WHERE good) * 1.0 / count(*) AS survival FROM seen GROUP BY ds, pid"""
ADDS_VALUE = f"""
WITH {_HITS}, less AS (SELECT ds, pid, CASE WHEN pid >= 441 THEN unnest([pid // 21, pid % 441, (pid // 441) * 21 + pid % 21]) ELSE unnest([pid // 21, pid % 21, pid % 21]) END AS parent FROM pat WHERE pid >= 21)
SELECT p.ds AS dataset_id, p.pid AS pattern_id, p.win AS win_rate, max(CASE p.dir WHEN 'bullish' THEN q.up ELSE q.dn END * 100.0 / q.n) AS best_part, bool_and(p.win >= CASE p.dir WHEN 'bullish' THEN q.up ELSE q.dn END * 100.0 / q.n + 0.5) AS adds_value
FROM pat p JOIN less l USING (ds, pid) JOIN pat q ON q.ds = l.ds AND q.pid = l.parent GROUP BY p.ds, p.pid, p.win"""
_COLUMN = str([c[0] for c in CONDITIONS])
_KEPT = f"""
sets AS (SELECT ds, pid, list(b ORDER BY b) AS bars, list_sort(list_filter([pid % 21, (pid // 21) % 21, pid // 441], lambda k: k > 0).list_transform(lambda k: {_COLUMN}[k])) AS family FROM hit WHERE r IS NOT NULL GROUP BY ds, pid),
more AS (SELECT * FROM (SELECT ds, pid, CASE WHEN pid >= 441 THEN unnest([pid // 21, pid % 441, (pid // 441) * 21 + pid % 21]) ELSE unnest([pid // 21, pid % 21, pid % 21]) END AS parent FROM pat WHERE pid >= 21)),
kept AS (
  SELECT p.* FROM pat p WHERE n >= 30 AND win >= 52 AND win - bl >= 3
    AND NOT EXISTS (SELECT 1 FROM more m JOIN pat q ON q.ds = m.ds AND q.pid = m.parent WHERE m.ds = p.ds AND m.pid = p.pid AND p.win < CASE p.dir WHEN 'bullish' THEN q.up ELSE q.dn END * 100.0 / q.n + 0.5)
    AND NOT EXISTS (SELECT 1 FROM sets a JOIN sets z ON a.ds = z.ds AND a.bars = z.bars AND a.family = z.family AND z.pid < a.pid WHERE a.ds = p.ds AND a.pid = p.pid))"""
RATIO_SEARCH = f"""
WITH {_HITS}, {_KEPT}, rated AS (SELECT k.*, (SELECT CASE k.dir WHEN 'bullish' THEN CASE WHEN avg(w) > 0 THEN avg(u) / avg(w) WHEN avg(u) > 0 THEN 1e9 ELSE 0 END ELSE CASE WHEN avg(u) > 0 THEN avg(w) / avg(u) WHEN avg(w) > 0 THEN 1e9 ELSE 0 END END FROM hit h WHERE h.ds = k.ds AND h.pid = k.pid AND h.r IS NOT NULL) AS ratio FROM kept k),
grid AS (SELECT DISTINCT ds, g FROM rated, (SELECT unnest([0, 0.5, 1, 1.25, 1.5, 2, 2.5, 3, 4, 5]::DOUBLE[]) AS g) t),
sums AS (SELECT grid.ds, g, count(pid) AS patterns, sum(win * n) AS total, sum(n) AS samples FROM grid LEFT JOIN rated ON rated.ds = grid.ds AND ratio >= g GROUP BY grid.ds, g),
valued AS (SELECT ds, g, patterns, CASE WHEN patterns = 0 THEN -1 ELSE greatest(0, total / samples - 50) * log10(greatest(10, samples)) + 0.01 * patterns END AS v FROM sums)
SELECT ds AS dataset_id, g AS threshold, patterns, v AS set_score, g = min(g) FILTER (WHERE v >= top - 1e-9) OVER (PARTITION BY ds) AS best FROM (SELECT *, max(v) OVER (PARTITION BY ds) AS top FROM valued) x"""
FILTERED = f"""
WITH {_HITS}, {_KEPT}
SELECT p.ds AS dataset_id, CASE WHEN p.n < 30 THEN '1 few samples' WHEN p.win < 52 THEN '2 win rate' WHEN p.win - p.bl < 3 THEN '3 lift' WHEN EXISTS (SELECT 1 FROM more m JOIN pat q ON q.ds = m.ds AND q.pid = m.parent WHERE m.ds = p.ds AND m.pid = p.pid AND p.win < CASE p.dir WHEN 'bullish' THEN q.up ELSE q.dn END * 100.0 / q.n + 0.5) THEN '4 redundant condition'
  WHEN EXISTS (SELECT 1 FROM kept k WHERE k.ds = p.ds AND k.pid = p.pid) THEN 'kept' ELSE '5 duplicate' END AS reason, count(*) AS patterns FROM pat p GROUP BY ALL"""
_HOLDS = """
hz AS MATERIALIZED (
  SELECT x.ds, x.pid, k.dir, k.n AS n12, k.win AS win12, k.bl AS bl12, x.b, t.h, CASE k.dir WHEN 'bullish' THEN t.r ELSE -t.r END AS mv
  FROM hit x JOIN kept k USING (ds, pid) JOIN (SELECT dataset_id AS ds, bar_index AS b, unnest([{'h': 1, 'r': r1}, {'h': 2, 'r': r2}, {'h': 3, 'r': r3}, {'h': 5, 'r': r5}, {'h': 8, 'r': r8}, {'h': 12, 'r': r12}, {'h': 21, 'r': r21}, {'h': 34, 'r': r34}], recursive := true) FROM ev) t USING (ds, b) WHERE x.b < x.c - 1),
after AS MATERIALIZED (SELECT a.ds, a.pid, a.h, a.b, z.b AS nb FROM hz a ASOF JOIN hz z ON a.ds = z.ds AND a.pid = z.pid AND a.h = z.h AND a.b + a.h <= z.b),
chain AS (SELECT ds, pid, h, min(b) AS b FROM hz GROUP BY ds, pid, h UNION ALL SELECT a.ds, a.pid, a.h, a.nb FROM chain c JOIN after a ON a.ds = c.ds AND a.pid = c.pid AND a.h = c.h AND a.b = c.b),
taken AS (SELECT ds, pid, h, mv, mv - 0.05 AS net, row_number() OVER w AS i, count(*) OVER (PARTITION BY ds, pid, h) AS k, sum(mv - 0.05) OVER w AS eq FROM hz JOIN chain USING (ds, pid, h, b) WHERE mv IS NOT NULL WINDOW w AS (PARTITION BY ds, pid, h ORDER BY b)),
eq AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY ds, pid, h ORDER BY i)) - eq AS fall FROM taken),
net AS (
  SELECT ds, pid, h, count(*) AS trades, 100.0 * count(*) FILTER (WHERE mv > 0) / count(*) AS tw, avg(net) AS an, coalesce(stddev_samp(net), 0) AS sd, max(fall) AS dd,
    abs(coalesce(100.0 * count(*) FILTER (WHERE net > 0 AND i <= k // 2) / nullif(count(*) FILTER (WHERE i <= k // 2), 0), 0) - coalesce(100.0 * count(*) FILTER (WHERE net > 0 AND i > k // 2) / nullif(count(*) FILTER (WHERE i > k // 2), 0), 0)) AS delta FROM eq GROUP BY ds, pid, h),
whole AS (SELECT ds, pid, dir, n12, win12, bl12, h, count(mv) AS n, 100.0 * count(*) FILTER (WHERE mv > 0) / count(mv) AS win, avg(mv) AS mean FROM hz GROUP BY ALL HAVING count(mv) > 0),
bas AS (SELECT ds, h, 100.0 * count(*) FILTER (WHERE r > 0) / count(r) AS bu, 100.0 * count(*) FILTER (WHERE r < 0) / count(r) AS bd FROM (SELECT dataset_id AS ds, unnest([{'h': 1, 'r': r1}, {'h': 2, 'r': r2}, {'h': 3, 'r': r3}, {'h': 5, 'r': r5}, {'h': 8, 'r': r8}, {'h': 12, 'r': r12}, {'h': 21, 'r': r21}, {'h': 34, 'r': r34}], recursive := true) FROM ev) x GROUP BY ds, h),
hold AS (
  SELECT *, trades >= 30 AND an > 0 AND tw - base >= 5 AND tw >= 52 AS fits, (CASE WHEN sd > 1e-6 THEN an / sd WHEN an > 0 THEN 100 * an ELSE an END) * sqrt(trades) * (20 / (20 + delta)) * (1 / (1 + dd / greatest(0.05, abs(an)))) * h ** -0.5 + greatest(0, tw - base) / 100 AS rec
  FROM (SELECT w.*, n.trades, n.tw, n.an, n.sd, n.dd, n.delta, CASE w.dir WHEN 'bullish' THEN b.bu ELSE b.bd END AS base FROM whole w JOIN net n USING (ds, pid, h) JOIN bas b USING (ds, h)) j),
best AS (SELECT * FROM hold QUALIFY row_number() OVER (PARTITION BY ds, pid ORDER BY fits DESC, floor(rec * 1e9) DESC, h) = 1),
final AS (
  SELECT *, 0.5 * (0.1 * log10(greatest(n12, 10)) + 0.024 * greatest(0, win12 - bl12)) + 0.5 * (exp(rec / 5) - 1) / (exp(rec / 5) + 1) AS score FROM best WHERE n >= 30 AND win >= 52 AND win - base >= 5),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY ds ORDER BY floor(score * 1e9) DESC, n DESC, pid) AS rk FROM final f)"""
_SEARCH = f"WITH RECURSIVE {_HITS}, {_KEPT}, {_HOLDS.replace('bas AS', 'hbas AS').replace('JOIN bas b', 'JOIN hbas b')}"
HORIZONS = f"{_SEARCH} SELECT ds AS dataset_id, pid AS pattern_id, h, n, win AS win_rate, mean AS mean_move, trades, tw AS trade_win, an AS avg_net, dd AS max_drawdown, delta, base, rec, fits AS eligible FROM hold"
RANKED = f"""{_SEARCH}, tail AS (
  SELECT *, least(1.0, greatest(0.0, 2 * 0.3989423 * exp(-z * z / 2) * (0.3193815 * t - 0.3565638 * t ** 2 + 1.781478 * t ** 3 - 1.821256 * t ** 4 + 1.330274 * t ** 5))) AS p
  FROM (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM (SELECT *, abs(win / 100 - q0) / sqrt(q0 * (1 - q0) / n) AS z FROM (SELECT *, greatest(0.000001, least(0.999999, base / 100)) AS q0 FROM placed) a) b) c),
ranks AS (SELECT x.ds, x.pid, x.p, count(*) AS k FROM tail x JOIN tail y ON x.ds = y.ds AND y.p <= x.p GROUP BY x.ds, x.pid, x.p),
qs AS (SELECT x.ds, x.pid, least(1.0, min(y.p * 298 / y.k)) AS q FROM ranks x JOIN ranks y ON x.ds = y.ds AND y.p >= x.p GROUP BY x.ds, x.pid)
SELECT ds AS dataset_id, pid AS pattern_id, h, n, win AS win_rate, win - base AS lift, score, rk, q FROM placed JOIN qs USING (ds, pid)"""
#: Conditions 3 to 5 are box events, 1 and 2 candle directions, 10 to 12 numeric.
PRIORITY = f"""{_SEARCH}, parts AS (SELECT ds, pid, unnest([pid % 21, (pid // 21) % 21, pid // 441]) AS k FROM placed)
SELECT ds AS dataset_id, pid AS pattern_id, 15 + sum(CASE WHEN k IN (3, 4, 5) THEN 10 WHEN k IN (1, 2) THEN 10 WHEN k BETWEEN 6 AND 9 THEN 2 WHEN k >= 10 THEN -2 ELSE 0 END) + least(20, greatest(0, any_value(score))) AS priority FROM parts JOIN placed USING (ds, pid) GROUP BY ds, pid"""
SHORTLIST = f"""{_SEARCH}, {_SIDES}, listed AS (SELECT p.ds, p.pid, p.score + log10(p.n + 1) + log10(p.trades + 1) + greatest(0, p.win - p.base) / 20 - 0.08 * CASE WHEN p.pid >= 441 THEN 3 WHEN p.pid >= 21 THEN 2 ELSE 1 END AS v FROM placed p JOIN held h USING (ds, pid) WHERE h.why = 'none')
SELECT ds AS dataset_id, pid AS pattern_id, v AS priority, row_number() OVER (PARTITION BY ds ORDER BY floor(v * 1e9) DESC, pid) AS pos FROM listed"""

# ------------------------------------------------------------------ trades

_LEVELS = tr.levels(DUCKDB, f"({tick_bars(DUCKDB, 'events')}) b")
_CFG = DUCKDB.values(tr.SETTINGS, tr.FIELDS)
_WALK = f"""
lv AS MATERIALIZED ({_LEVELS}),
bar AS MATERIALIZED (SELECT lv.*, conds, lag(x) OVER o AS px, lag(conds) OVER o AS pc FROM lv JOIN ev USING (dataset_id, bar_index) WINDOW o AS (PARTITION BY dataset_id ORDER BY bar_index)),
sys AS MATERIALIZED (SELECT p.ds, p.pid, p.dir FROM placed f JOIN held h USING (ds, pid) JOIN pat p USING (ds, pid) WHERE h.why = 'none'),
sig AS MATERIALIZED (
  SELECT s.ds, s.pid, CASE s.dir WHEN 'bullish' THEN 1 ELSE -1 END AS d, x.b AS i, x.c - 2 AS last, CASE s.dir WHEN 'bullish' THEN l.pds_low ELSE l.pds_high END AS lim, (l.pds_low + l.pds_high) / 2 AS mid,
    CASE s.dir WHEN 'bullish' THEN l.level_low ELSE l.level_high END AS behind, CASE s.dir WHEN 'bullish' THEN l.level_high ELSE l.level_low END AS beyond, [k - 1 FOR k IN [s.pid % 21, (s.pid // 21) % 21, s.pid // 441] IF k > 0] AS need, g.*
  FROM sys s JOIN hit x USING (ds, pid) JOIN lv l ON l.dataset_id = x.ds AND l.bar_index = x.b CROSS JOIN {_CFG} g WHERE x.b <= x.c - 2),
filled AS MATERIALIZED (
  SELECT s.*, CASE entry WHEN 'signal-close' THEN i WHEN 'next-open' THEN i + 1 ELSE f.at END AS ei
  FROM sig s LEFT JOIN (SELECT s.ds, s.pid, s.cfg, s.i, min(l.bar_index) AS at FROM sig s JOIN lv l ON l.dataset_id = s.ds AND l.bar_index > s.i AND l.bar_index <= least(s.last, s.i + s.expiry) AND l.low <= s.lim AND l.high >= s.lim WHERE s.entry = 'box-boundary-limit' GROUP BY ALL) f USING (ds, pid, cfg, i)),
priced AS (SELECT f.*, CASE entry WHEN 'signal-close' THEN l.close WHEN 'next-open' THEN l.open ELSE lim END AS price, coalesce(l.atr, abs(CASE entry WHEN 'signal-close' THEN l.close WHEN 'next-open' THEN l.open ELSE lim END) * CASE stop_mode WHEN 'fixed-percent' THEN stop_v ELSE 10 END / 100) AS a FROM filled f LEFT JOIN lv l ON l.dataset_id = f.ds AND l.bar_index = f.ei),
risked AS (SELECT *, CASE stop_mode WHEN 'fixed-percent' THEN price - d * price * stop_v / 100 WHEN 'atr-multiple' THEN price - d * price * (a * stop_v / abs(price)) ELSE behind END AS stop FROM priced),
aimed AS (
  SELECT *, abs(price - stop) / abs(price) * 100 AS pct, CASE target_mode WHEN 'fixed-percent' THEN price + d * price * target_v / 100 WHEN 'risk-multiple' THEN price + d * price * target_v * abs(price - stop) / abs(price) WHEN 'atr-multiple' THEN price + d * a * target_v WHEN 'price-level' THEN beyond WHEN 'box-midpoint' THEN mid END AS goal FROM risked),
ready AS MATERIALIZED (
  SELECT *, ei IS NOT NULL AND price IS NOT NULL AND coalesce(stop_mode <> 'price-level' OR ((price - stop) * d > 0 AND pct >= 0.001), false) AND coalesce(target_mode NOT IN ('price-level', 'box-midpoint') OR (goal - price) * d > 0, false) AS ok,
    CASE entry WHEN 'signal-close' THEN ei + 1 ELSE ei END AS f0, least(last, ei + hold) AS f1 FROM aimed),
steps AS MATERIALIZED (SELECT r.ds, r.pid, r.cfg, r.i, unnest(range(r.f0, r.f1 + 1)) AS at FROM ready r WHERE r.ok),
touch AS MATERIALIZED (
  SELECT r.ds, r.pid, r.cfg, r.i, min(l.bar_index) FILTER (WHERE CASE WHEN d > 0 THEN l.low <= stop ELSE l.high >= stop END) AS s_at, min(l.bar_index) FILTER (WHERE CASE WHEN d > 0 THEN l.high >= goal ELSE l.low <= goal END) AS t_at,
    min(l.bar_index) FILTER (WHERE CASE WHEN target_mode = 'signal-invalidation' THEN NOT list_has_all(l.conds, need) WHEN target_mode <> 'feature-event' THEN false WHEN event = 'eq' THEN list_contains(l.conds, event_v) AND NOT list_contains(l.pc, event_v) WHEN event = 'cross-above' THEN l.px <= event_v AND l.x > event_v ELSE l.px >= event_v AND l.x < event_v END) AS e_at
  FROM steps JOIN ready r USING (ds, pid, cfg, i) JOIN bar l ON l.dataset_id = r.ds AND l.bar_index = steps.at GROUP BY r.ds, r.pid, r.cfg, r.i),
ended AS MATERIALIZED (
  SELECT r.ds, r.pid, r.cfg, r.i, r.ok, r.d, r.price, r.pct, coalesce(least(s_at, t_at, e_at), f1) AS x_at, CASE WHEN least(s_at, t_at, e_at) IS NULL THEN 'time' WHEN s_at = t_at AND s_at <= coalesce(e_at, s_at) THEN 'ambiguous' WHEN s_at = least(s_at, t_at, e_at) THEN 'stop' WHEN t_at = least(s_at, t_at, e_at) THEN 'target' WHEN target_mode = 'feature-event' THEN 'feature-exit' ELSE 'invalidation' END AS how, stop, goal
  FROM ready r LEFT JOIN touch t USING (ds, pid, cfg, i)),
paid AS MATERIALIZED (
  SELECT e.*, l.ts_ms AS x_ms, (d * (CASE WHEN how IN ('ambiguous', 'stop') THEN stop WHEN how = 'target' THEN goal ELSE l.close END - price) / abs(price) * 100 - 0.05) / pct AS r
  FROM ended e LEFT JOIN lv l ON l.dataset_id = e.ds AND l.bar_index = e.x_at),
go AS MATERIALIZED (SELECT a.ds, a.pid, a.cfg, a.i, z.i AS ni FROM (SELECT *, CASE WHEN ok THEN x_at ELSE i END + 1 AS free FROM paid) a ASOF JOIN paid z ON a.ds = z.ds AND a.pid = z.pid AND a.cfg = z.cfg AND a.free <= z.i),
seen AS (SELECT ds, pid, cfg, min(i) AS i FROM paid GROUP BY ds, pid, cfg UNION ALL SELECT g.ds, g.pid, g.cfg, g.ni FROM seen s JOIN go g ON g.ds = s.ds AND g.pid = s.pid AND g.cfg = s.cfg AND g.i = s.i),
book AS MATERIALIZED (SELECT p.*, CASE WHEN s.i IS NULL THEN 'overlapping' WHEN p.ok THEN 'trade' ELSE 'unfilled' END AS state FROM paid p LEFT JOIN seen s USING (ds, pid, cfg, i))"""
_BOOK = f"{_SEARCH}, {_SIDES}, {_WALK}"
TRADES = f"{_BOOK} SELECT ds AS dataset_id, pid AS pattern_id, cfg, i, x_at AS exit_index, state, how AS result, r FROM book WHERE state = 'trade'"
_ACCOUNT = """
cash AS (SELECT *, 50000 * product(1 + r / 100) OVER (PARTITION BY ds, pid, cfg ORDER BY i) AS eq, make_timestamp(x_ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local FROM book WHERE state = 'trade'),
gain AS (SELECT *, eq - eq / (1 + r / 100) AS pnl, greatest(50000, max(eq) OVER (PARTITION BY ds, pid, cfg ORDER BY i)) - eq AS fall FROM cash),
fact AS (
  SELECT ds, pid, cfg, count(*) AS trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE how = 'ambiguous') AS ambiguous, avg(r) AS er, sum(pnl) FILTER (WHERE pnl > 0) AS g, -sum(pnl) FILTER (WHERE pnl <= 0) AS l, max(100 * fall / (fall + eq)) AS dd, sum(pnl) AS net FROM gain GROUP BY ds, pid, cfg),
daily AS (SELECT ds, pid, cfg, max(greatest(0, b - low)) AS day_dd FROM (SELECT ds, pid, cfg, local::DATE AS day, arg_min(eq - pnl, i) AS b, min(eq) AS low FROM gain GROUP BY ALL) x GROUP BY ds, pid, cfg),
sums AS (
  SELECT b.*, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(ambiguous, 0) AS ambiguous, coalesce(100.0 * wins / trades, 0) AS win_rate, coalesce(er, 0) AS er, CASE WHEN l > 0 THEN coalesce(g, 0) / l END AS pf, coalesce(dd, 0) AS dd, coalesce(day_dd, 0) AS day_dd, coalesce(net, 0) AS net
  FROM (SELECT ds, pid, cfg, count(*) AS signals, count(*) FILTER (WHERE state = 'unfilled') AS unfilled, count(*) FILTER (WHERE state = 'overlapping') AS overlapping FROM book GROUP BY ds, pid, cfg) b LEFT JOIN fact USING (ds, pid, cfg) LEFT JOIN daily USING (ds, pid, cfg))"""
SIMULATED = f"{_BOOK}, {_ACCOUNT} SELECT ds AS dataset_id, pid AS pattern_id, cfg, signals, unfilled, overlapping, trades, wins, ambiguous, win_rate, er AS expectancy_r, pf AS profit_factor, dd AS max_drawdown_pct, day_dd AS max_daily_drawdown, net AS net_profit FROM sums"
OBJECTIVE = f"""{_BOOK}, {_ACCOUNT}, cost(kind, mode, v) AS (VALUES ('entry', 'signal-close', 0.08), ('entry', 'box-boundary-limit', 0.08), ('target', 'box-midpoint', 0.04), ('target', 'time-only', -0.03), ('target', 'atr-multiple', 0.02), ('target', 'price-level', 0.03), ('target', 'feature-event', 0.05), ('target', 'signal-invalidation', 0.02), ('stop', 'atr-multiple', 0.02), ('stop', 'price-level', 0.03)),
hard AS (SELECT g.cfg, coalesce(sum(v), 0) + CASE WHEN hold > 21 THEN 0.04 ELSE 0 END AS v FROM {_CFG} g LEFT JOIN cost c ON (c.kind = 'entry' AND c.mode = g.entry) OR (c.kind = 'target' AND c.mode = g.target_mode) OR (c.kind = 'stop' AND c.mode = g.stop_mode) GROUP BY g.cfg, hold)
SELECT ds AS dataset_id, pid AS pattern_id, cfg, trades, er AS expectancy_r, dd AS max_drawdown_pct, h.v AS complexity, CASE WHEN trades >= 15 THEN 2.4 * er + 0.25 * (least(4, coalesce(pf, 4)) - 1) + 0.25 * least(1.5, log10(trades + 1) / 1.5) - 0.035 * dd - h.v END AS score FROM sums JOIN hard h USING (cfg)"""
FIRST_EXIT = f"{_BOOK} SELECT ds AS dataset_id, pid AS pattern_id, cfg, i, ok AS filled, CASE WHEN ok THEN x_at END AS exit_index, CASE WHEN ok THEN how END AS result, CASE WHEN ok THEN r END AS r FROM book"
FOLDS = f"{_BOOK} SELECT b.ds AS dataset_id, b.pid AS pattern_id, b.cfg, least(3, b.i * 4 // e.c) AS fold, count(*) AS n, avg(r) AS mean_r FROM book b JOIN (SELECT DISTINCT dataset_id AS ds, c FROM ev) e USING (ds) WHERE state = 'trade' GROUP BY ALL"
R_METRICS = f"""{_BOOK}, run AS (SELECT *, sum(r) OVER (PARTITION BY ds, pid, cfg ORDER BY i) AS t FROM book WHERE state = 'trade'),
top AS (SELECT *, greatest(0, max(t) OVER (PARTITION BY ds, pid, cfg ORDER BY i)) - t AS fall FROM run)
SELECT ds AS dataset_id, pid AS pattern_id, cfg, count(*) AS n, 100.0 * count(*) FILTER (WHERE r > 0) / count(*) AS win_rate, avg(r) AS expectancy, coalesce(sum(r) FILTER (WHERE r > 0), 0) / nullif(-sum(r) FILTER (WHERE r < 0), 0) AS profit_factor, sum(r) AS net_r, max(fall) AS max_drawdown, avg(r - 0.05 / pct) AS stressed FROM top GROUP BY ds, pid, cfg"""

_OTHER = {30: 24, 120: 6, 240: 3, 60: 12}
# every interval on its own: conditions as for hourly bars, the exit after twelve hours
_EACH = " UNION ALL ".join(f"SELECT e.dataset_id AS ds, {m} AS m, e.bar_index AS b, e.c, e.conds, z.close - e.close AS dx FROM ({evaluated(DUCKDB, '(' + tick_bars(DUCKDB, 'events', m * 60_000) + ')')}) e JOIN ({tick_bars(DUCKDB, 'events', m * 60_000)}) z ON z.dataset_id = e.dataset_id AND z.bar_index = e.bar_index + {h}" for m, h in _OTHER.items())
_WHICH = " UNION ALL ".join(f"SELECT DISTINCT dataset_id AS ds, {m} AS m FROM ({tick_bars(DUCKDB, 'events', m * 60_000)}) b" for m in _OTHER)
SURVIVAL_ON_INTERVALS = f"""
WITH {_HITS}, lone AS MATERIALIZED (SELECT ds, m, b, dx, unnest(conds) + 1 AS k FROM ({_EACH}) e WHERE b >= floor(0.7e0 * c)),
combos AS (SELECT ds, m, dx, k AS pid FROM lone UNION ALL SELECT x.ds, x.m, x.dx, 21 * x.k + y.k FROM lone x JOIN lone y ON x.ds = y.ds AND x.m = y.m AND x.b = y.b AND x.k < y.k
  UNION ALL SELECT x.ds, x.m, x.dx, 441 * x.k + 21 * y.k + z.k FROM lone x JOIN lone y ON x.ds = y.ds AND x.m = y.m AND x.b = y.b AND x.k < y.k JOIN lone z ON y.ds = z.ds AND y.m = z.m AND y.b = z.b AND y.k < z.k),
gains AS MATERIALIZED (SELECT ds, m, pid, sum(dx) AS dx FROM combos GROUP BY ds, m, pid), places AS MATERIALIZED ({_WHICH}),
tried AS (SELECT p.ds, p.pid, o.m, coalesce(CASE p.dir WHEN 'bullish' THEN g.dx > 0 ELSE g.dx < 0 END, false) AS good FROM pat p JOIN places o ON true LEFT JOIN gains g ON g.ds = o.ds AND g.m = o.m AND g.pid = p.pid WHERE NOT (o.ds = p.ds AND o.m = 60 AND g.pid IS NULL))
SELECT ds AS dataset_id, pid AS pattern_id, count(*) AS evaluated, count(*) FILTER (WHERE good) * 1.0 / count(*) AS survival, count(*) FILTER (WHERE m <> 60) AS elsewhere, count(*) FILTER (WHERE good AND m <> 60) * 1.0 / count(*) FILTER (WHERE m <> 60) AS interval_survival FROM tried GROUP BY ds, pid"""
_PATHS = f"""
px AS MATERIALIZED (SELECT dataset_id AS ds, bar_index AS b, high, low, close, greatest(abs(close), 1e-9) AS s, max(bar_index) OVER (PARTITION BY dataset_id) AS final FROM ({tick_bars(DUCKDB, 'events')}) t),
seen AS MATERIALIZED (SELECT a.ds, a.b, z.b - a.b AS j, (z.high - a.close) / a.s * 100 AS up, (a.close - z.low) / a.s * 100 AS dn, (z.close - a.close) / a.s * 100 AS mv FROM px a JOIN px z ON z.ds = a.ds AND z.b > a.b AND z.b <= a.b + 12),
entered AS (SELECT h.ds, h.pid, h.b, p.dir FROM hit h JOIN pat p USING (ds, pid) WHERE h.b < h.c - 1)"""
PROFILE = f"""
WITH {_HITS}, {_PATHS}, done AS (SELECT ds, b, arg_max(mv, j) AS mv, greatest(0, max(up)) AS up, greatest(0, max(dn)) AS dn FROM seen GROUP BY ds, b),
own AS (SELECT e.ds, e.pid, CASE e.dir WHEN 'bullish' THEN mv ELSE -mv END AS mv, CASE e.dir WHEN 'bullish' THEN up ELSE dn END AS f, CASE e.dir WHEN 'bullish' THEN dn ELSE up END AS a FROM entered e JOIN done USING (ds, b))
SELECT ds AS dataset_id, pid AS pattern_id, count(*) AS n, median(mv) AS median_move, median(f) AS median_mfe, median(a) AS median_mae, 100.0 * count(*) FILTER (WHERE mv <= 0) / count(*) AS failure_rate FROM own GROUP BY ds, pid"""
FIRST_TOUCHES = f"""
WITH {_HITS}, {_PATHS}, sizes AS (SELECT unnest([5, 10, 20, 40]::DOUBLE[]) AS pct),
first AS MATERIALIZED (SELECT s.ds, s.b, z.pct, min(j) FILTER (WHERE up >= pct) AS ub, min(j) FILTER (WHERE dn >= pct) AS db FROM seen s, sizes z GROUP BY s.ds, s.b, z.pct),
own AS (SELECT e.ds, e.pid, t.pct AS target, s.pct AS stop, CASE e.dir WHEN 'bullish' THEN t.ub ELSE t.db END AS hit, CASE e.dir WHEN 'bullish' THEN s.db ELSE s.ub END AS lost FROM entered e JOIN first t USING (ds, b) JOIN first s USING (ds, b))
SELECT ds AS dataset_id, pid AS pattern_id, target, stop, count(*) AS n, 100.0 * count(hit) / count(*) AS target_rate, median(hit) AS median_bars, 100.0 * count(lost) / count(*) AS stop_rate, 100.0 * count(*) FILTER (WHERE hit < coalesce(lost, 99)) / count(*) AS target_first FROM own GROUP BY ALL"""

#: The level-wise search by rows of bars: sets as joins, match sets as lists, the choice row by row.
LEVELS = """
strided AS (SELECT dataset_id, bar_index, r1 FROM ev WHERE r1 IS NOT NULL AND bar_index < c - 1 AND bar_index % greatest(1, (c - 1) // 256) = 0),
late AS MATERIALIZED (SELECT dataset_id AS ds, bar_index AS b, r12 AS r FROM ev WHERE r12 IS NOT NULL),
every AS (SELECT l.dataset_id AS ds, l.bar_index AS b, m.cond, m.feature FROM long l JOIN made m USING (dataset_id, feature)
  WHERE (m.op = 'lt' AND l.num < m.v) OR (m.op = 'gt' AND l.num > m.v) OR (m.op = 'eq' AND l.num = m.v) OR (m.op = 'neq' AND l.num <> m.v) OR (m.op = 'is' AND l.txt = m.t)),
often AS MATERIALIZED (SELECT e.*, t.r, count(*) OVER (PARTITION BY e.ds, e.cond) AS times FROM every e JOIN late t USING (ds, b) QUALIFY times >= 120),
very AS MATERIALIZED (SELECT * FROM often WHERE times >= 400),
met AS MATERIALIZED (
  SELECT ds, b, r, [cond] AS conds, [feature] AS features FROM often
  UNION ALL SELECT x.ds, x.b, x.r, [x.cond, y.cond], [x.feature, y.feature] FROM often x JOIN often y ON x.ds = y.ds AND x.b = y.b AND x.cond < y.cond AND x.feature <> y.feature
  UNION ALL SELECT x.ds, x.b, x.r, [x.cond, y.cond, z.cond], [x.feature, y.feature, z.feature] FROM very x JOIN very y ON x.ds = y.ds AND x.b = y.b AND x.cond < y.cond AND x.feature <> y.feature JOIN very z ON y.ds = z.ds AND y.b = z.b AND y.cond < z.cond AND z.feature <> y.feature AND z.feature <> x.feature),
sets AS MATERIALIZED (
  SELECT ds AS dataset_id, array_to_string(conds, ' + ') AS pattern, array_to_string(list_sort(features), '|') AS family, len(conds) AS depth, count(*) AS n, count(*) FILTER (WHERE r > 0) AS ups, count(*) FILTER (WHERE r < 0) AS downs, conds
  FROM met GROUP BY ds, conds, list_sort(features), features HAVING count(*) >= CASE len(conds) WHEN 3 THEN 400 ELSE 120 END),
base AS (SELECT ds, 100.0 * count(*) FILTER (WHERE r > 0) / count(*) AS bu, 100.0 * count(*) FILTER (WHERE r < 0) / count(*) AS bd FROM late GROUP BY ds),
rated AS MATERIALIZED (SELECT s.*, s.dataset_id AS ds, CASE WHEN ups >= downs THEN 100.0 * ups / n ELSE 100.0 * downs / n END AS win_rate, CASE WHEN ups >= downs THEN 100.0 * ups / n - bu ELSE 100.0 * downs / n - bd END AS lift FROM sets s JOIN base ON base.ds = s.dataset_id),
weak AS (SELECT DISTINCT s.ds, s.pattern FROM rated s JOIN rated p ON p.ds = s.ds AND p.depth = s.depth - 1 AND list_has_all(s.conds, p.conds) WHERE s.win_rate < CASE WHEN s.ups >= s.downs THEN p.ups ELSE p.downs END * 100.0 / p.n + 0.5),
passed AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY ds, family ORDER BY depth, pattern) AS i FROM rated r WHERE win_rate >= 52 AND lift >= 3 AND NOT EXISTS (SELECT 1 FROM weak w WHERE w.ds = r.ds AND w.pattern = r.pattern)),
bars AS MATERIALIZED (SELECT p.ds, p.family, p.i, p.pattern, p.n, list(m.b) AS bs FROM passed p JOIN met m ON m.ds = p.ds AND m.conds = p.conds GROUP BY ALL),
twins AS MATERIALIZED (SELECT x.ds, x.family, x.i, y.i AS j, x.pattern AS early, y.pattern AS late, len(list_intersect(x.bs, y.bs)) * 1.0 / (x.n + y.n - len(list_intersect(x.bs, y.bs))) AS jaccard
  FROM bars x JOIN bars y ON x.ds = y.ds AND x.family = y.family AND x.i < y.i WHERE abs(x.n - y.n) <= 0.1 * greatest(x.n, y.n) AND jaccard >= 0.95),
line AS (SELECT ds, family, i, coalesce((SELECT list(t.i) FROM twins t WHERE t.ds = p.ds AND t.family = p.family AND t.j = p.i), []) AS before FROM passed p),
walk AS (
  SELECT DISTINCT ds, family, 0::BIGINT AS i, []::BIGINT[] AS stays FROM passed
  UNION ALL SELECT l.ds, l.family, l.i, CASE WHEN list_has_any(w.stays, l.before) THEN w.stays ELSE list_append(w.stays, l.i) END FROM walk w JOIN line l ON l.ds = w.ds AND l.family = w.family AND l.i = w.i + 1),
ends AS (SELECT ds, family, arg_max(stays, i) AS stays FROM walk GROUP BY ds, family),
decided AS (
  SELECT r.ds, r.pattern, r.depth, r.n, r.win_rate, r.lift, CASE WHEN r.win_rate < 52 THEN '2 win rate' WHEN r.lift < 3 THEN '3 lift' WHEN p.i IS NULL THEN '4 redundant condition' WHEN list_contains(e.stays, p.i) THEN 'kept' ELSE '5 near duplicate' END AS reason
  FROM rated r LEFT JOIN passed p ON p.ds = r.ds AND p.pattern = r.pattern LEFT JOIN ends e ON e.ds = p.ds AND e.family = p.family)"""

_TWO = f"""
lo AS MATERIALIZED (SELECT dataset_id AS ds, bar_index AS i, ts_ms AS t, open AS o, high AS h, low AS l, close AS c FROM ({tick_bars(DUCKDB, 'events', 900_000)}) x),
hi AS MATERIALIZED (SELECT dataset_id AS ds, bar_index AS i, ts_ms AS t, high AS h, low AS l FROM ({tick_bars(DUCKDB, 'events')}) x)"""
#: The forming candle from the bars of its hour so far, each bar joined with them.
DEVELOPING = f"""
WITH {_TWO}, forming AS (SELECT x.ds, x.i, x.c, (x.t + 900000 - s.t) / 36000.0 AS progress, p.h AS ph, p.l AS pl, y.i AS j, y.o, y.h, y.l FROM lo x JOIN hi s ON s.ds = x.ds AND x.t >= s.t AND x.t + 900000 < s.t + 3600000 JOIN lo y ON y.ds = x.ds AND y.t >= s.t AND y.i <= x.i LEFT JOIN hi p ON p.ds = s.ds AND p.i = s.i - 1),
facts AS (SELECT ds, i, any_value(c) AS c, any_value(progress) AS progress, arg_min(o, j) AS o, max(h) AS h, min(l) AS l, list(j ORDER BY j) FILTER (WHERE h > ph) AS up, list(j ORDER BY j) FILTER (WHERE l < pl) AS dn FROM forming GROUP BY ds, i)
SELECT ds AS dataset_id, i AS bar_index, progress, CASE WHEN o = 0 THEN 0 ELSE 100 * (c - o) / abs(o) END AS body_pct, CASE WHEN o = 0 THEN 0 ELSE 100 * (h - l) / abs(o) END AS range_pct, CASE WHEN h = l THEN 50 ELSE 100 * (c - l) / (h - l) END AS location,
  CASE WHEN up IS NULL AND dn IS NULL THEN 'Inside prior range' WHEN dn IS NULL THEN 'Swept prior high' WHEN up IS NULL THEN 'Swept prior low' WHEN up[1] < dn[1] THEN 'Swept prior high before prior low' ELSE 'Swept prior low before prior high' END AS sweep_order FROM facts"""
INTRABAR = f"""
WITH {_TWO}, inside AS (SELECT x.ds, s.i AS tgt, x.*, p.h AS ph, p.l AS pl FROM lo x JOIN hi s ON s.ds = x.ds AND x.t >= s.t AND x.t + 900000 <= s.t + 3600000 LEFT JOIN hi p ON p.ds = s.ds AND p.i = s.i - 1),
lists AS (SELECT ds, tgt, count(*) AS n, list(o ORDER BY i) AS os, list(c ORDER BY i) AS cs, list(h ORDER BY i) AS hs, list(l ORDER BY i) AS ls, any_value(ph) AS ph, any_value(pl) AS pl FROM inside GROUP BY ds, tgt),
moved AS (SELECT *, list_prepend(cs[1] - os[1], list_transform(range(2, n + 1), lambda k: cs[k] - cs[k - 1])) AS ms FROM lists),
signs AS (SELECT *, list_filter(list_transform(ms, lambda m: sign(m)), lambda g: g <> 0) AS gs, list_position(list_transform(hs, lambda v: v > ph), true) AS a, list_position(list_transform(ls, lambda v: v < pl), true) AS b, list_position(hs, list_max(hs)) AS ha, list_position(ls, list_min(ls)) AS la FROM moved)
SELECT ds AS dataset_id, tgt AS bar_index, n AS intrabars, least(100, n * 25.0) AS coverage, CASE WHEN ha = la THEN 'High and low in same intrabar' WHEN ha < la THEN 'High before low' ELSE 'Low before high' END AS extreme_order,
  CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 'No prior-range sweep' WHEN coalesce(b, 0) = 0 THEN 'Prior high swept only' WHEN coalesce(a, 0) = 0 THEN 'Prior low swept only' WHEN a = b THEN 'Both swept in same intrabar' WHEN a < b THEN 'Prior high swept before prior low' ELSE 'Prior low swept before prior high' END AS sweep_order,
  CASE WHEN list_sum(list_transform(ms, lambda m: abs(m))) > 0 THEN 100 * abs(cs[n] - os[1]) / list_sum(list_transform(ms, lambda m: abs(m))) ELSE 0 END AS efficiency, cast(len(list_filter(range(2, len(gs) + 1), lambda k: gs[k] <> gs[k - 1])) AS bigint) AS turns,
  100 * (list_max(hs) - os[1]) / greatest(abs(os[1]), 1e-9) AS up_excursion, 100 * (os[1] - list_min(ls)) / greatest(abs(os[1]), 1e-9) AS down_excursion FROM signs"""
SCREENED = """
SELECT dataset_id, feature, score, row_number() OVER (PARTITION BY dataset_id ORDER BY floor(score * 1e9) DESC, feature) AS place FROM (
  SELECT dataset_id, feature, CASE WHEN n >= 8 AND spread > 1e-12 THEN sqrt(r2) ELSE 0 END AS score FROM (SELECT dataset_id, feature, count(e.r1) AS n, coalesce(stddev_pop(num) FILTER (WHERE e.r1 IS NOT NULL), 0) AS spread, regr_r2(e.r1, num) AS r2 FROM long LEFT JOIN strided e USING (dataset_id, bar_index) WHERE num IS NOT NULL GROUP BY ALL) a
  UNION ALL SELECT dataset_id, feature, CASE WHEN sum(n) >= 8 AND count(*) FILTER (WHERE n > 1) > 1 THEN (max(m) FILTER (WHERE n > 1) - min(m) FILTER (WHERE n > 1)) / 100 ELSE 0 END FROM (SELECT dataset_id, feature, txt, count(e.r1) AS n, avg(e.r1) AS m FROM long LEFT JOIN strided e USING (dataset_id, bar_index) WHERE txt IS NOT NULL GROUP BY ALL) b GROUP BY ALL)
QUALIFY place <= 1200"""

# ------------------------------------------------------------------ uploaded columns: one row per bar and column, joined with itself
_VALUES = ", ".join(f"('{label}', {k}, cast({x} AS double))" for k, (label, x) in enumerate(up.COLUMNS))
_UPLOADS = f"""
up AS MATERIALIZED (SELECT w.dataset_id AS ds, w.bar_index AS i, w.close, w.atr, v.label, v.pos, CASE WHEN isfinite(v.x) THEN v.x END AS x FROM ({up.wide(DUCKDB, f"({tick_bars(DUCKDB, 'events')}) b")}) w, LATERAL (SELECT * FROM (VALUES {_VALUES}) AS t(label, pos, x)) v),
col AS MATERIALIZED (SELECT r.dataset_id AS ds, r.label, r.role, p.pos FROM ({inferred(DUCKDB, '', long='SELECT ds AS dataset_id, i AS bar_index, label, x AS value FROM up')}) r JOIN (SELECT DISTINCT label, pos FROM up) p USING (label))"""
_BANDS = f"""
{_UPLOADS},
named AS (SELECT *, array_to_string(list_filter(string_split(lower(label), ' '), lambda w: w NOT IN ('upper', 'lower', 'basis', 'middle', 'midline', 'band')), ' ') AS grp FROM col),
mate AS (
  SELECT u.ds, u.label AS upper, u.pos, coalesce((SELECT arg_min(l.label, l.pos) FROM named l WHERE l.ds = u.ds AND l.role = 'lower-band' AND l.grp = u.grp),
    CASE WHEN (SELECT count(*) FROM named l WHERE l.ds = u.ds AND l.role = 'upper-band') = 1 AND (SELECT count(*) FROM named l WHERE l.ds = u.ds AND l.role = 'lower-band') = 1 THEN (SELECT min(l.label) FROM named l WHERE l.ds = u.ds AND l.role = 'lower-band') END) AS lower
  FROM named u WHERE u.role = 'upper-band'),
band AS (SELECT a.ds, a.upper, a.lower, (SELECT count(*) FROM mate b WHERE b.ds = a.ds AND b.lower IS NOT NULL AND b.pos <= a.pos) AS no FROM mate a WHERE a.lower IS NOT NULL),
width AS MATERIALIZED (SELECT b.ds, b.no, b.upper, b.lower, h.i, CASE WHEN h.close <> 0 THEN 100 * (h.x - l.x) / abs(h.close) END AS pct, CASE WHEN h.atr > 1e-12 THEN (h.x - l.x) / h.atr END AS atrs FROM band b JOIN up h ON h.ds = b.ds AND h.label = b.upper JOIN up l ON l.ds = b.ds AND l.label = b.lower AND l.i = h.i WHERE b.no <= 8)"""
BAND_WIDTHS = f"""
WITH {_BANDS}
SELECT n.ds AS dataset_id, n.i AS bar_index, n.upper, n.lower, n.pct AS width_pct, n.atrs AS width_atr,
  CASE WHEN n.pct IS NULL OR o.pct IS NULL THEN NULL WHEN abs(n.pct - o.pct) <= greatest(1e-12, 1e-10 * abs(o.pct)) THEN 'Flat' WHEN n.pct > o.pct THEN 'Expanding' ELSE 'Compressing' END AS expansion
FROM width n LEFT JOIN width o ON o.ds = n.ds AND o.no = n.no AND o.i = n.i - 3 WHERE n.pct IS NOT NULL OR n.atrs IS NOT NULL"""
WIDTH_RATIOS = f"WITH {_BANDS} SELECT p.ds AS dataset_id, p.i AS bar_index, p.upper AS a, q.upper AS b, p.pct / q.pct AS width_ratio FROM width p JOIN width q ON q.ds = p.ds AND q.i = p.i AND q.no > p.no AND q.no <= 4 WHERE abs(q.pct) > 1e-12 AND p.pct IS NOT NULL"
PAIR_RELATIONS = f"""
WITH {_UPLOADS}, free AS (SELECT * FROM col WHERE role NOT IN ('price-level', 'upper-band', 'lower-band', 'basis', 'binary-event')),
two AS (SELECT x.ds, x.label AS a, y.label AS b FROM free x JOIN free y ON x.ds = y.ds AND x.pos < y.pos QUALIFY row_number() OVER (PARTITION BY x.ds ORDER BY x.pos * 1000 + y.pos) <= 12),
gap AS MATERIALIZED (SELECT t.*, m.i, m.x - n.x AS s FROM two t JOIN up m ON m.ds = t.ds AND m.label = t.a JOIN up n ON n.ds = t.ds AND n.label = t.b AND n.i = m.i),
-- the bar before is the row whose number is one less
met AS (SELECT g.*, CASE WHEN h.s <= 0 AND g.s > 0 THEN 1 WHEN h.s >= 0 AND g.s < 0 THEN -1 ELSE 0 END AS side FROM gap g LEFT JOIN gap h ON h.ds = g.ds AND h.a = g.a AND h.b = g.b AND h.i = g.i - 1),
told AS (SELECT *, i - max(i) FILTER (WHERE side <> 0) OVER (PARTITION BY ds, a, b ORDER BY i) AS since, count(s) OVER w AS c, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd FROM met WINDOW w AS (PARTITION BY ds, a, b ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT ds AS dataset_id, i AS bar_index, a, b, CASE WHEN s IS NOT NULL AND c >= 10 THEN CASE WHEN sd > 1e-6 THEN (s - m) / sd ELSE 0 END END AS spread_z,
  CASE WHEN abs(s) <= 1e-12 THEN 'Equal' WHEN s IS NOT NULL THEN a || CASE WHEN s > 0 THEN ' above ' ELSE ' below ' END || b END AS relation,
  CASE side WHEN 0 THEN 'No cross' ELSE a || CASE side WHEN 1 THEN ' crossed above ' ELSE ' crossed below ' END || b END AS cross_event,
  CASE WHEN since = 0 THEN 'Now' WHEN since BETWEEN 1 AND 3 THEN 'Within 3 bars' WHEN since BETWEEN 4 AND 10 THEN 'Within 10 bars' ELSE 'Not recent' END AS recency
FROM told"""
ZONES = f"""
WITH {_UPLOADS}, ends(label, lo, hi) AS (VALUES {", ".join(f"('{n}', {lo}e0, {hi}e0)" for n, lo, hi in up.RANGES)}),
cut AS (SELECT c.ds, c.label, coalesce(any_value(0.8e0 * e.lo + 0.2e0 * e.hi), quantile_cont(u.x, 0.2)) AS low, coalesce(any_value(0.2e0 * e.lo + 0.8e0 * e.hi), quantile_cont(u.x, 0.8)) AS high FROM col c JOIN up u ON u.ds = c.ds AND u.label = c.label LEFT JOIN ends e ON e.label = c.label WHERE c.role = 'oscillator' GROUP BY c.ds, c.label)
SELECT u.ds AS dataset_id, u.i AS bar_index, u.label, CASE WHEN u.x <= c.low THEN 'Low' WHEN u.x < c.high THEN 'Middle' ELSE 'High' END AS zone FROM up u JOIN cut c USING (ds, label) WHERE u.x IS NOT NULL"""
LEVELS_OR_CHANGES = f"""
WITH {_UPLOADS}, own AS (SELECT u.ds, u.label, u.i, u.x, c.role NOT IN ('price', 'cumulative') AS steady FROM up u JOIN col c USING (ds, label) WHERE c.role NOT IN ('price-level', 'upper-band', 'lower-band', 'basis', 'binary-event')),
step AS (SELECT n.*, n.x - o.x AS y FROM own n LEFT JOIN own o ON o.ds = n.ds AND o.label = n.label AND o.i = n.i - 1),
told AS (SELECT *, count(y) OVER w AS c, avg(y) OVER w AS m, stddev_pop(y) OVER w AS sd FROM step WINDOW w AS (PARTITION BY ds, label ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT ds AS dataset_id, i AS bar_index, label, CASE WHEN steady THEN 'value' ELSE 'change' END AS kind, CASE WHEN steady THEN x WHEN y IS NOT NULL AND c >= 10 THEN CASE WHEN sd > 1e-6 THEN (y - m) / sd ELSE 0 END END AS reading FROM told WHERE x IS NOT NULL"""

# ------------------------------------------------------------------ coverage: matches numbered one by one
_OCC = f"""
{_HITS},
occ AS MATERIALIZED (SELECT h.ds, h.pid, e.ts_ms AS t, coalesce(e.r1 > 0, false) AS rose, coalesce(e.r1 < 0, false) AS fell FROM hit h JOIN ev e ON e.dataset_id = h.ds AND e.bar_index = h.b WHERE h.r IS NOT NULL),
past AS (SELECT dataset_id AS ds, count(*) AS bars, max(ts_ms) - min(ts_ms) AS span FROM ev GROUP BY dataset_id)"""
PERIODS = f"""
WITH {_OCC}, dated AS (SELECT *, extract(year FROM make_timestamp(t * 1000)) AS y FROM occ),
wide AS (SELECT ds, pid, t, y FROM dated UNION ALL SELECT '*', pid, t, y FROM dated), all_past AS (SELECT ds, bars FROM past UNION ALL SELECT '*', sum(bars) FROM past)
SELECT w.ds AS dataset_id, w.pid AS pattern_id, w.y, count(*) AS n, min(w.t) AS first_ms, max(w.t) AS last_ms, 100.0e0 * count(*) / any_value(p.bars) AS share
FROM (SELECT * FROM wide UNION ALL SELECT ds, pid, t, 0 FROM wide) w JOIN all_past p USING (ds) GROUP BY w.ds, w.pid, w.y"""
COVERAGE_FLAGS = f"""
WITH {_OCC}, won AS (SELECT o.ds, o.pid, o.t, CASE p.dir WHEN 'bullish' THEN o.rose ELSE o.fell END AS good, row_number() OVER (PARTITION BY o.ds, o.pid ORDER BY o.t) AS place, count(*) OVER (PARTITION BY o.ds, o.pid) AS n FROM occ o JOIN pat p USING (ds, pid)),
both_ AS (SELECT ds, pid, n, max(t) - min(t) AS took, 100.0e0 * avg(good::int) FILTER (WHERE 2 * place <= n) AS early, 100.0e0 * avg(good::int) FILTER (WHERE 2 * place > n) AS late FROM won GROUP BY ds, pid, n)
SELECT ds AS dataset_id, pid AS pattern_id, n, early AS early_win, late AS late_win, n = 1 OR abs(early - late) <= 10 AS steady,
  'symbol-specific,timeframe-specific' || CASE WHEN n < 30 THEN ',few-occurrences' ELSE '' END || CASE WHEN span > 0 AND 4 * took < span THEN ',concentrated-in-short-period' ELSE '' END AS flags
FROM both_ JOIN past USING (ds)"""
PER_SYMBOL = f"WITH {_HITS}, grid AS (SELECT d.ds, p.pid FROM (SELECT DISTINCT dataset_id AS ds FROM ev) d, (SELECT DISTINCT pid FROM pat) p) SELECT g.ds AS dataset_id, g.pid AS pattern_id, coalesce(p.n, 0) AS n, coalesce(p.win, 0) AS win_rate, coalesce(p.mv, 0) AS avg_move FROM grid g LEFT JOIN pat p USING (ds, pid)"
POOLED = f"""
WITH {_OCC}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY t, ds) AS place, count(*) OVER (PARTITION BY pid) AS n FROM occ),
parts AS (SELECT pid, n, 100.0e0 * avg(rose::int) FILTER (WHERE 2 * place <= n) AS eu, 100.0e0 * avg(rose::int) FILTER (WHERE 2 * place > n) AS lu, 100.0e0 * avg(fell::int) FILTER (WHERE 2 * place <= n) AS ed, 100.0e0 * avg(fell::int) FILTER (WHERE 2 * place > n) AS ld FROM ranked GROUP BY pid, n),
results AS (SELECT pid, count(*) AS symbols, sum(win * n) / sum(n) AS win_rate, avg(win) AS equal_rate, sum(mv * n) / sum(n) AS avg_move, avg(mv) AS equal_move, list(win) FILTER (WHERE n >= 30) AS wins FROM pat GROUP BY pid)
SELECT pid AS pattern_id, symbols, n, win_rate, equal_rate, avg_move, equal_move, coalesce(len(wins) >= 2 AND list_max(wins) - list_min(wins) <= 10, false) AS broad, n = 1 OR abs(eu - lu) <= 10 AS steady_up, n = 1 OR abs(ed - ld) <= 10 AS steady_down,
  CASE WHEN symbols <= 1 THEN 'symbol-specific,' ELSE '' END || 'timeframe-specific' || CASE WHEN n < 30 THEN ',few-occurrences' ELSE '' END AS flags
FROM parts JOIN results USING (pid)"""

# ------------------------------------------------------------------ sessions and sources: looked up one by one
USABLE_SESSIONS = f"""
WITH q AS MATERIALIZED ({tick_bars(DUCKDB, 'events', 900_000)}), day AS MATERIALIZED ({tick_bars(DUCKDB, 'events', 86_400_000)}),
tr AS (SELECT n.dataset_id AS ds, n.bar_index AS i, n.ts_ms AS t, list_max([n.high - n.low, abs(n.high - coalesce(o.close, n.high)), abs(n.low - coalesce(o.close, n.low))]) AS tr FROM day n LEFT JOIN day o ON o.dataset_id = n.dataset_id AND o.bar_index = n.bar_index - 1),
atr AS MATERIALIZED (SELECT a.ds, a.i, a.t, sum(b.tr) / 14 AS v FROM tr a JOIN tr b ON b.ds = a.ds AND b.i BETWEEN a.i - 13 AND a.i GROUP BY a.ds, a.i, a.t HAVING count(*) = 14),
local AS (SELECT dataset_id AS ds, ts_ms, make_timestamp(ts_ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS w FROM q),
ses AS (SELECT ds, cast(w AS date) AS dy, min(ts_ms) AS open_ms, count(*) AS bars FROM local WHERE w::time >= TIME '09:30:00' AND w::time < TIME '16:00:00' GROUP BY ds, cast(w AS date))
SELECT ds AS dataset_id, open_ms, bars, (SELECT arg_max(v, t) FROM atr a WHERE a.ds = s.ds AND a.t < s.open_ms) AS prior_atr, (SELECT arg_max(v, t) FROM atr a WHERE a.ds = s.ds AND a.t + 86400000 <= s.open_ms) AS completed_atr
FROM ses s WHERE bars >= 6 AND EXISTS (SELECT 1 FROM atr a WHERE a.ds = s.ds AND a.t < s.open_ms)"""
