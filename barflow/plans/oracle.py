"""DuckDB SQL for the registered queries, written apart from the operators: dense grids, self-joins and recursive queries."""

from __future__ import annotations

from barflow.functions.stats import expected_max_sharpe

BARS = """bars AS (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, arg_min(e.value, e.ts) AS open, max(e.value) AS high,
    min(e.value) AS low, arg_max(e.value, e.ts) AS close, count(*) AS volume
  FROM events e WHERE e.value > 0 GROUP BY e.event_type, date_trunc('hour', e.ts))"""
#: The same columns for users, in steps of six hours.
USERS = """bars AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, time_bucket(INTERVAL 6 HOURS, ts) AS ts, arg_max(value, (ts, event_id)) AS close
  FROM events WHERE value > 0 GROUP BY ALL)"""
CAL = """cal AS (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS sess,
    row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS size
  FROM (SELECT DISTINCT ts FROM bars))"""
GRID = """grid AS (
  SELECT s.symbol, c.ts, c.bar, c.sess, c.pos, b.open, b.high, b.low, b.close, b.volume
  FROM cal c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts)"""
#: A symbol's own rows, numbered without gaps; k is the position among them, bar that of the panel.
OWN = """own AS (
  SELECT symbol, bar, ts, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS k FROM grid WHERE close IS NOT NULL)"""
PANEL = f"{BARS}, {CAL}, {GRID}"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar)"


def roll(w: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def mean(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) OVER {roll(w)} = {w} THEN avg({x}) OVER {roll(w)} END"


def dev(x: str, w: int) -> str:
    return f"CASE WHEN count({x}) OVER {roll(w)} = {w} THEN stddev_samp({x}) OVER {roll(w)} END"


def rnd(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def ewm(name: str, source: str, x: str, alpha: float, at: str = "k") -> str:
    """Recurrence of an exponential mean in which an unknown value only lets the old one decay."""
    d = 1 - alpha
    return f"""{name} AS (
  SELECT symbol, {at}, CAST({x} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS old FROM {source} WHERE {at} = 0
  UNION ALL
  SELECT s.symbol, s.{at},
    CASE WHEN s.{x} IS NULL THEN e.y WHEN e.y IS NULL THEN s.{x} ELSE (e.old * {d!r} * e.y + {alpha!r} * s.{x}) / (e.old * {d!r} + {alpha!r}) END,
    CASE WHEN s.{x} IS NULL THEN e.old * {d!r} ELSE 1.0 END
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.{at} = e.{at} + 1)"""


def pairs(least: int = 200) -> str:
    return f"""{BARS}, joined AS (
  SELECT x.symbol AS a, y.symbol AS b, x.ts, x.close AS pa, y.close AS pb, count(*) OVER (PARTITION BY x.symbol, y.symbol) AS total
  FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol < y.symbol), prs AS (
  SELECT a, b, ts, pa, pb, ln(pa) AS la, ln(pb) AS lb, row_number() OVER (PARTITION BY a, b ORDER BY ts) - 1 AS i,
    dense_rank() OVER (PARTITION BY a, b ORDER BY CAST(ts AS DATE)) - 1 AS sess
  FROM joined WHERE total >= {least})"""


def spreads(least: int = 200, where: str = "TRUE") -> str:
    return f"""{pairs(least)}, fit AS (
  SELECT a, b, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta FROM prs WHERE {where} GROUP BY a, b), spr AS (
  SELECT p.*, f.alpha, f.beta, p.la - f.beta * p.lb - f.alpha AS spread FROM prs p JOIN fit f USING (a, b) WHERE {where})"""


def df(source: str, keys: str, value: str, at: str = "i") -> str:
    """Unit-root regression inside sessions."""
    return f"""chg AS (
  SELECT {keys}, CASE WHEN sess = lag(sess) OVER w THEN lag({value}) OVER w END AS y0,
    CASE WHEN sess = lag(sess) OVER w THEN {value} - lag({value}) OVER w END AS dy
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {at})), tst AS (
  SELECT {keys}, regr_count(dy, y0) AS n, regr_slope(dy, y0) AS gamma, regr_sxx(dy, y0) AS sxx,
    greatest(regr_syy(dy, y0) - regr_slope(dy, y0) * regr_sxy(dy, y0), 0.0) AS rss
  FROM chg GROUP BY {keys}), adf AS (
  SELECT *, CASE WHEN n > 2 THEN gamma / sqrt(nullif(rss / (n - 2) / nullif(sxx, 0), 0)) END AS tau, sqrt(rss / nullif(n, 0)) AS sigma,
    CASE WHEN gamma < 0 THEN ln(2) / -gamma END AS hl FROM tst)"""


def hurst(source: str, keys: list[str], value: str, limit: str = "greatest(20, n // 10)") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    own = ", ".join(f"x.{c}" for c in keys)
    return f"""hs AS (
  SELECT {k}, {value} AS v, row_number() OVER (PARTITION BY {k} ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY {k}) AS n FROM {source}), hl AS (
  SELECT DISTINCT {k}, n, unnest(range(2, CAST({limit} AS BIGINT))) AS lag FROM hs), hv AS (
  SELECT {own}, l.lag, var_pop(y.v - x.v) AS var FROM hs x JOIN hl l ON {" AND ".join(f"x.{c} = l.{c}" for c in keys)} JOIN hs y ON {on} AND y.j = x.j + l.lag GROUP BY {own}, l.lag), hu AS (
  SELECT {k}, regr_slope(ln(var), ln(lag)) / 2 AS h FROM hv WHERE var > 0 GROUP BY {k})"""


def machine(source: str, keys: str, body: str, reason: str, at: str = "i") -> str:
    """A fold as a recursive query: `body` gives the next held position from m.pos and the row s, `reason` why it closed."""
    ks = keys.split(", ")
    on = " AND ".join(f"s.{k} = m.{k}" for k in ks)
    own = ", ".join(f"s.{k}" for k in ks)
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {at}) AS q FROM {source}), m AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS q, CAST(-1 AS BIGINT) AS {at}, CAST(0 AS DOUBLE) AS pos, CAST(0 AS DOUBLE) AS shown, CAST(NULL AS BIGINT) AS entry, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT {keys} FROM num)
  UNION ALL
  SELECT {own}, s.q, s.{at}, t.nxt, CASE WHEN t.hide THEN 0.0 ELSE t.nxt END,
    CASE WHEN t.nxt = 0 THEN NULL WHEN m.pos = 0 THEN s.{at} ELSE m.entry END,
    CASE WHEN t.why IS NOT NULL THEN coalesce(m.entry, s.{at}) END, t.why
  FROM m JOIN num s ON {on} AND s.q = m.q + 1, LATERAL (SELECT {body} AS nxt0) u, LATERAL (SELECT {reason}) t(nxt, why, hide))"""


SPREAD_Z = f"""{spreads()}, zs AS (
  SELECT *, CASE WHEN count(spread) OVER w = 60 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z, (sess % 7) <> 6 AS ok
  FROM spr WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""

_TWO = """CASE WHEN m.pos = 0 THEN CASE WHEN s.z > 1.5 THEN -1.0 WHEN s.z < -1.5 THEN 1.0 ELSE 0.0 END
  WHEN m.pos > 0 AND s.z >= 0 THEN 0.0 WHEN m.pos < 0 AND s.z <= 0 THEN 0.0 WHEN abs(s.z) > 3.5 THEN 0.0 ELSE m.pos END"""
_TWO_WHY = "CASE WHEN (m.pos > 0 AND s.z >= 0) OR (m.pos < 0 AND s.z <= 0) THEN 'reversion' ELSE 'hard stop' END"
FOLD = machine(
    "zs", "a, b", f"CASE WHEN NOT s.ok THEN 0.0 WHEN s.z IS NULL THEN m.pos ELSE {_TWO} END",
    f"u.nxt0, CASE WHEN m.pos <> 0 AND u.nxt0 = 0 THEN CASE WHEN NOT s.ok THEN 'regime break' ELSE {_TWO_WHY} END END, s.ok AND s.z IS NULL",
)
SPREAD_FOLD = f"WITH RECURSIVE {SPREAD_Z}, {FOLD}"

SESSION_Z = f"""{spreads()}, zs AS (
  SELECT *, CASE WHEN count(spread) OVER w >= 10 THEN coalesce((spread - avg(spread) OVER w) / nullif(stddev_pop(spread) OVER w, 0), 0.0) ELSE 0.0 END AS z,
    coalesce(lead(sess) OVER (PARTITION BY a, b ORDER BY i) <> sess, TRUE) AS fin
  FROM spr WINDOW w AS (PARTITION BY a, b, sess ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""
INTRADAY_FOLD = machine(
    "zs", "a, b", _TWO,
    f"CASE WHEN s.fin THEN 0.0 ELSE u.nxt0 END, CASE WHEN m.pos <> 0 AND u.nxt0 = 0 THEN {_TWO_WHY} WHEN s.fin AND u.nxt0 <> 0 THEN 'end of day' END, FALSE",
)

DMI_OWN = f"""{OWN}, mv AS (
  SELECT symbol, bar, k, high - lag(high) OVER v AS up, lag(low) OVER v - low AS dn,
    greatest(high - low, coalesce(abs(high - lag(close) OVER v), 0), coalesce(abs(low - lag(close) OVER v), 0)) AS tr
  FROM own WINDOW v AS (PARTITION BY symbol ORDER BY k)), dm AS (
  SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM mv)"""
DMI_SUMS = ", ".join(ewm(a, "dm", x, 1 / 14) for a, x in (("atr", "tr"), ("sp", "pdm"), ("sm", "mdm")))
DI = "di AS (SELECT d.symbol, d.bar, d.k, 100 * sp.y / nullif(atr.y, 0) AS plus_di, 100 * sm.y / nullif(atr.y, 0) AS minus_di FROM dm d JOIN atr USING (symbol, k) JOIN sp USING (symbol, k) JOIN sm USING (symbol, k))"
DX = "dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di)"

RV = f"""rt AS (SELECT *, ln(close) - lag(ln(close)) OVER {"w"} AS ret FROM grid {W}), rv AS (SELECT symbol, bar, sess, pos, close, {dev("ret", 12)} AS rv FROM rt)"""
RVZ = """zs AS (
  SELECT symbol, bar, sess, pos, close, rv, CASE WHEN rv IS NULL THEN 0.0 WHEN count(rv) OVER w >= 10
    THEN least(greatest(coalesce((rv - avg(rv) OVER w) / nullif(stddev_pop(rv) OVER w, 0), 0.0), -20.0), 20.0) ELSE 0.0 END AS z
  FROM (SELECT * FROM rv WHERE close IS NOT NULL) WINDOW w AS (PARTITION BY symbol, sess ORDER BY bar ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""
VOL_SIDE = f"""sd AS (
  SELECT z.symbol, z.bar, z.z, c.pos = c.size - 1 AS fin,
    CASE WHEN d.k >= 14 THEN CASE WHEN d.minus_di > d.plus_di THEN 1.0 WHEN d.plus_di > d.minus_di THEN -1.0 ELSE 0.0 END
      ELSE CASE WHEN ln(z.close) - ln(g.close) < 0 THEN 1.0 WHEN ln(z.close) - ln(g.close) > 0 THEN -1.0 ELSE 0.0 END END AS side
  FROM zs z JOIN cal c USING (bar) JOIN di d USING (symbol, bar) LEFT JOIN grid g ON g.symbol = z.symbol AND g.bar = z.bar - 6)"""
VOL_FOLD = machine(
    "sd", "symbol",
    "CASE WHEN m.pos = 0 THEN CASE WHEN s.z > 1.5 AND NOT s.fin THEN s.side ELSE 0.0 END WHEN s.z <= 0.5 THEN 0.0 WHEN s.z > 3.5 THEN 0.0 ELSE m.pos END",
    "CASE WHEN s.fin THEN 0.0 ELSE u.nxt0 END, CASE WHEN m.pos <> 0 AND u.nxt0 = 0 THEN CASE WHEN s.z <= 0.5 THEN 'vol normalized' ELSE 'vol kept expanding' END WHEN s.fin AND u.nxt0 <> 0 THEN 'end of day' END, FALSE",
    "bar",
)

#: Regimes of volatility: every session's window of five sessions unfolded.
REGIME = f"""wn AS (
  SELECT s.symbol, s.sess AS refit, r.bar AS i, r.sess, r.rv
  FROM (SELECT DISTINCT symbol, sess FROM rv WHERE close IS NOT NULL) s JOIN rv r ON r.symbol = s.symbol AND r.sess BETWEEN s.sess - 5 AND s.sess - 1 WHERE r.rv IS NOT NULL),
  {df('wn', 'symbol, refit', 'rv')}, {hurst('wn', ['symbol', 'refit'], 'rv')}, reg AS (
  SELECT s.symbol, s.sess, coalesce(a.n, 0) AS n, a.tau, CASE WHEN NOT isnan(hu.h) THEN hu.h END AS h, coalesce(a.tau < -2.86 AND hu.h < 0.5, FALSE) AS ok
  FROM (SELECT DISTINCT symbol, sess FROM rv WHERE close IS NOT NULL) s LEFT JOIN adf a ON a.symbol = s.symbol AND a.refit = s.sess LEFT JOIN hu ON hu.symbol = s.symbol AND hu.refit = s.sess)"""
OOS = "(SELECT floor((max(sess) + 1) * 0.6) FROM cal)"
VOL_FOLD_OK = machine(
    "so", "symbol",
    "CASE WHEN NOT s.ok THEN 0.0 WHEN m.pos = 0 THEN CASE WHEN s.z > 1.5 AND NOT s.fin THEN s.side ELSE 0.0 END WHEN s.z <= 0.5 THEN 0.0 WHEN s.z > 3.5 THEN 0.0 ELSE m.pos END",
    "CASE WHEN s.fin THEN 0.0 ELSE u.nxt0 END, CASE WHEN m.pos <> 0 AND NOT s.ok THEN 'regime break' WHEN m.pos <> 0 AND u.nxt0 = 0 THEN CASE WHEN s.z <= 0.5 THEN 'vol normalized' ELSE 'vol kept expanding' END WHEN s.fin AND u.nxt0 <> 0 THEN 'end of day' END, FALSE",
    "bar",
)

BOOK = """sc0 AS (SELECT *, coalesce(spread - lag(spread) OVER (PARTITION BY a, b ORDER BY i), 0.0) AS change FROM zs), sc1 AS (
  SELECT *, CASE WHEN count(change) OVER w >= 5 THEN stddev_samp(change) OVER w END AS sigma FROM sc0
  WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), tgt AS (
  SELECT a, b, median(sigma) AS target FROM sc1 GROUP BY a, b), sc AS (
  SELECT s.*, CASE WHEN sigma IS NULL THEN 1.0 WHEN sigma = 0 THEN 3.0 ELSE least(greatest(target / sigma, 0.2), 3.0) END AS scale FROM sc1 s JOIN tgt USING (a, b)), book AS (
  SELECT s.*, m.shown AS position, m.closed, m.reason,
    coalesce(lag(m.shown) OVER (PARTITION BY a, b ORDER BY i) * s.change * s.scale, 0.0) AS pnl
  FROM sc s JOIN m USING (a, b, i)), lg AS (
  SELECT x.a, x.b, x.closed AS entry, x.i AS exit, x.reason AS exit_reason, e.ts AS entry_ts, x.ts AS exit_ts, e.z AS entry_z, x.z AS exit_z,
    CASE WHEN e.position > 0 THEN 'long' ELSE 'short' END AS direction, e.pa AS entry_price_a, e.pb AS entry_price_b, x.pa AS exit_price_a, x.pb AS exit_price_b, e.beta,
    (SELECT sum(t.pnl) FROM book t WHERE t.a = x.a AND t.b = x.b AND t.i > x.closed AND t.i <= x.i) AS pnl
  FROM book x JOIN book e ON e.a = x.a AND e.b = x.b AND e.i = x.closed WHERE x.reason IS NOT NULL)"""
SPREAD_BOOK = f"{SPREAD_FOLD}, {BOOK}"


def rotation(lookback: int = 20, every: int = 24, top: int = 2, phases: int = 1, start: int | None = None, signal: str | None = None, extra: str = "") -> str:
    """Baskets, parts, profit, turnover and trades of all phases, on the dense grid."""
    signal = signal or "SELECT symbol, bar, roc AS score FROM sig WHERE ok AND roc IS NOT NULL"
    first = "(SELECT min(bar) FROM cal WHERE sess = floor((SELECT max(sess) + 1 FROM cal) * 0.6))" if start is None else str(start)
    return f"""{PANEL}, sig AS (
  SELECT symbol, bar, close, ln(close) - lag(ln(close)) OVER w AS ret, close / lag(close, {lookback}) OVER w - 1 AS roc,
    coalesce(({mean("close", 10)}) > ({mean("close", 30)}), FALSE) AS ok
  FROM grid {W}), prm AS (SELECT {first} AS start, (SELECT count(*) FROM cal) AS bars), {extra} cand AS ({signal}), dec AS (
  SELECT p.phase, c.bar + 1 AS t0, c.symbol, row_number() OVER (PARTITION BY p.phase, c.bar + 1 ORDER BY c.score DESC, c.symbol) AS rank
  FROM cand c, prm, (SELECT unnest(range({phases})) AS phase) p
  WHERE c.bar + 1 >= start + p.phase AND (c.bar + 1 - start - p.phase) % {every} = 0 AND c.bar + 1 < bars), held AS (
  SELECT *, 1.0 / count(*) OVER (PARTITION BY phase, t0) AS weight FROM dec WHERE rank <= {top}), parts AS (
  SELECT h.phase, g.bar, h.symbol, h.t0, h.weight * coalesce(g.ret, 0.0) AS part
  FROM held h JOIN sig g ON g.symbol = h.symbol AND g.bar >= h.t0 AND g.bar < h.t0 + {every}), pnl AS (
  SELECT p.phase, c.bar, coalesce(sum(x.part), 0.0) AS pnl, count(x.part) AS n_held
  FROM cal c CROSS JOIN (SELECT unnest(range({phases})) AS phase) p CROSS JOIN prm LEFT JOIN parts x ON x.bar = c.bar AND x.phase = p.phase
  WHERE c.bar >= start + p.phase GROUP BY p.phase, c.bar), trn AS (
  SELECT phase, bar, sum(d) AS dropped, sum(a) AS added, sum(d + a) / {top}.0 AS turnover FROM (
    SELECT h.phase, h.t0 AS bar, 0 AS d, 1 AS a FROM held h WHERE NOT EXISTS (SELECT 1 FROM held q WHERE q.phase = h.phase AND q.symbol = h.symbol AND q.t0 = h.t0 - {every})
    UNION ALL
    SELECT h.phase, h.t0 + {every}, 1, 0 FROM held h, prm WHERE h.t0 + {every} < bars AND NOT EXISTS (SELECT 1 FROM held q WHERE q.phase = h.phase AND q.symbol = h.symbol AND q.t0 = h.t0 + {every})
  ) GROUP BY phase, bar), isl AS (
  SELECT phase, symbol, t0 - {every} * row_number() OVER (PARTITION BY phase, symbol ORDER BY t0) AS g, t0 FROM held), runs AS (
  SELECT phase, symbol, min(t0) AS entry, least(max(t0) + {every}, any_value(bars) - 1) AS exit,
    CASE WHEN max(t0) + {every} < any_value(bars) THEN 'rebalance drop' ELSE 'end of backtest' END AS exit_reason
  FROM isl, prm GROUP BY phase, symbol, g), trd AS (
  SELECT r.*, exit - entry AS hold_bars, coalesce((SELECT sum(part) FROM parts p WHERE p.phase = r.phase AND p.symbol = r.symbol AND p.bar > r.entry AND p.bar <= r.exit), 0.0) AS pnl FROM runs r)"""


#: Drawdown is measured against the highest value so far, first value included.
def stat(source: str, keys: str, at: str = "bar") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""cum AS (SELECT *, sum(pnl) OVER ({part}ORDER BY {at}) AS c FROM {source}), dd AS (
  SELECT *, max(c) OVER ({part}ORDER BY {at}) - c AS d, greatest(max(c) OVER ({part}ORDER BY {at}), 0) - c AS d0 FROM cum), perf AS (
  SELECT {lead}count(pnl) AS n, avg(pnl) * 6048 AS ann_return, stddev_pop(pnl) * sqrt(6048) AS ann_vol,
    avg(pnl) * 6048 / nullif(stddev_pop(pnl) * sqrt(6048), 0) AS sharpe, max(d) AS max_drawdown FROM dd {group})"""


COSTED = "SELECT p.phase, p.bar, c.cost_bps, p.pnl - coalesce(t.turnover, 0) * c.cost_bps / 10000.0 AS pnl FROM pnl p LEFT JOIN trn t USING (phase, bar) CROSS JOIN (SELECT unnest([0, 1, 2, 5, 10, 20]) AS cost_bps) c"


def boot(source: str, values: list[str]) -> str:
    """Draws by joining every row of every block: no running sums here."""
    sums = ", ".join(f"sum({v}) AS s_{v}, sum({v} * {v}) AS q_{v}, count({v}) AS c_{v}" for v in values)
    return f"""bs AS (SELECT *, row_number() OVER (ORDER BY bar) - 1 AS r, count(*) OVER () AS n FROM {source}), bk AS (
  SELECT boot, k, n, (boot * 7919 + k * 104729) % (n - 24 + 1) AS r0, least(24, n - k * 24) AS len
  FROM (SELECT DISTINCT n FROM bs), (SELECT unnest(range(200)) AS boot), (SELECT unnest(range((SELECT CAST(ceil(max(n) / 24.0) AS BIGINT) FROM bs))) AS k)), dr AS (
  SELECT boot, {sums} FROM bk JOIN bs ON bs.r >= r0 AND bs.r < r0 + len GROUP BY boot)"""


def boot_sharpe(v: str) -> str:
    return f"(s_{v} / c_{v}) * sqrt(6048) / nullif(sqrt(CASE WHEN q_{v} / c_{v} - (s_{v} / c_{v}) ** 2 > 1e-24 THEN q_{v} / c_{v} - (s_{v} / c_{v}) ** 2 ELSE 0 END), 0)"


def _variants() -> str:
    """One set of candidates for each rule, then the same clock for all."""
    yes = "ok AND roc IS NOT NULL"
    rules = {
        "baseline": (yes, "roc"), "di_gate": ("plus_di > minus_di", "roc"), "ma_and_di": (f"{yes} AND plus_di > minus_di", "roc"), "ma_and_adx": (f"{yes} AND adx >= 20", "roc"),
        "ma_di_adx": (f"{yes} AND plus_di > minus_di AND adx >= 20", "roc"), "rank_by_di": (f"{yes} AND plus_di > minus_di", "plus_di - minus_di"),
        "rank_by_adx_weighted": (f"{yes} AND adx >= 20", "roc * adx / 100"), "risk_adjusted": (yes, "CASE WHEN rv > 0 THEN roc / rv END"),
        "risk_adjusted_di": (f"{yes} AND plus_di > minus_di", "CASE WHEN rv > 0 THEN roc / rv END"),
    }
    cands = " UNION ALL ".join(f"SELECT '{k}' AS variant, symbol, bar, {s} AS score FROM ft WHERE {m}" for k, (m, s) in rules.items())
    return f"""WITH RECURSIVE {PANEL}, {_PANEL_DMI}, sig AS (
  SELECT symbol, bar, close, close / lag(close, 20) OVER w - 1 AS roc, coalesce(({mean("close", 10)}) > ({mean("close", 30)}), FALSE) AS ok FROM grid {W}), {RV}, ft AS (
  SELECT s.symbol, s.bar, s.roc, s.ok, v.rv, x.plus_di, x.minus_di, x.y AS adx FROM sig s JOIN rv v USING (symbol, bar) JOIN pd x USING (symbol, bar) WHERE s.close IS NOT NULL), cand AS ({cands}), prm AS (
  SELECT (SELECT min(bar) FROM cal WHERE sess = floor((SELECT max(sess) + 1 FROM cal) * 0.6)) AS start, (SELECT count(*) FROM cal) AS bars), dec AS (
  SELECT variant, bar + 1 AS t0, symbol, row_number() OVER (PARTITION BY variant, bar ORDER BY score DESC, symbol) AS rank
  FROM cand, prm WHERE score IS NOT NULL AND bar + 1 >= start AND (bar + 1 - start) % 24 = 0 AND bar + 1 < bars)
  SELECT variant, t0, symbol, rank FROM dec WHERE rank <= 2"""


_PANEL_DMI = f"""mv AS (
  SELECT symbol, bar, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn,
    CASE WHEN close IS NOT NULL THEN greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) END AS tr
  FROM grid {W}), dm AS (
  SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM mv),
  {", ".join(ewm(a, "dm", x, 1 / 14, "bar") for a, x in (("atr", "tr"), ("sp", "pdm"), ("sm", "mdm")))}, di AS (
  SELECT d.symbol, d.bar, 100 * sp.y / nullif(atr.y, 0) AS plus_di, 100 * sm.y / nullif(atr.y, 0) AS minus_di
  FROM dm d JOIN atr USING (symbol, bar) JOIN sp USING (symbol, bar) JOIN sm USING (symbol, bar)), {DX}, {ewm("ax", "dx", "dx", 1 / 14, "bar")}, pd AS (
  SELECT d.symbol, d.bar, d.plus_di, d.minus_di, a.y FROM dx d JOIN ax a USING (symbol, bar))"""

def cross(w: int, k: float) -> str:
    """RSI of w bars through 30 and 70, outside bands of k deviations."""
    return f"""WITH RECURSIVE {PANEL}, {OWN}, c AS (SELECT symbol, bar, k, close - lag(close) OVER v AS dc FROM own WINDOW v AS (PARTITION BY symbol ORDER BY k)),
      d AS (SELECT symbol, bar, k, greatest(dc, 0) + 0 * dc AS up, greatest(-dc, 0) + 0 * dc AS dn FROM c), {ewm('g', 'd', 'up', 1 / w)}, {ewm('l', 'd', 'dn', 1 / w)},
      rs AS (SELECT d.symbol, d.bar, coalesce(100 - 100 / (1 + g.y / nullif(l.y, 0)), 50) AS rsi FROM d JOIN g USING (symbol, k) JOIN l USING (symbol, k)),
      x AS (SELECT q.symbol, q.bar, q.close, rs.rsi, {mean('close', 20)} AS mid, {dev('close', 20)} AS dev FROM grid q LEFT JOIN rs USING (symbol, bar)), y AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY bar) AS before FROM x),
      z AS (SELECT symbol, bar, CASE WHEN before <= 30 AND rsi > 30 AND close < mid - {k} * dev THEN 'buy' WHEN before >= 70 AND rsi < 70 AND close > mid + {k} * dev THEN 'sell' END AS side FROM y)
      SELECT symbol, bar, side FROM z WHERE side IS NOT NULL"""


ORACLE: dict[str, str] = {
    "panel_hourly_bars": f"WITH {BARS} SELECT symbol, ts, {rnd('open')}, {rnd('high')}, {rnd('low')}, {rnd('close')}, volume FROM bars",
    "panel_daily_complete": f"""WITH b AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS close FROM orders GROUP BY ALL)
      SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, {rnd('close')} FROM b WHERE ts IN (SELECT ts FROM b GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b))""",
    "panel_profile": f"WITH {BARS} SELECT symbol, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol",
    "session_ids": f"WITH {BARS}, {CAL} SELECT ts, bar, sess FROM cal",
    "session_flags": f"WITH {BARS}, {CAL} SELECT ts, pos, pos = 0 AS is_first, pos = size - 1 AS is_last FROM cal",
    "bars_per_year": f"WITH {BARS}, {CAL} SELECT count(*) AS n_bars, count(DISTINCT sess) AS n_days, {rnd('count(*) / count(DISTINCT sess) * 252', 'bars_per_year')} FROM cal",
    "split_by_session": f"""WITH {BARS}, {CAL}, s AS (SELECT max(sess) + 1 AS n_sessions, CAST(floor((max(sess) + 1) * 0.6::DOUBLE) AS BIGINT) AS split_session FROM cal)
      SELECT n_sessions, split_session, (SELECT min(bar) FROM cal WHERE sess = split_session) AS split_bar FROM s""",
    "log_returns": f"WITH {PANEL}, x AS (SELECT symbol, bar, close, ln(close) - lag(ln(close)) OVER w AS ret FROM grid {W}) SELECT symbol, bar, {rnd('ret')} FROM x WHERE close IS NOT NULL",
    "roc": f"WITH {PANEL}, x AS (SELECT symbol, bar, close, close / lag(close, 20) OVER w - 1 AS roc FROM grid {W}) SELECT symbol, bar, {rnd('roc')} FROM x WHERE close IS NOT NULL",
    "sma": f"WITH {PANEL}, x AS (SELECT symbol, bar, close, {mean('close', 10)} AS sma FROM grid) SELECT symbol, bar, {rnd('sma')} FROM x WHERE close IS NOT NULL",
    "bollinger": f"""WITH {PANEL}, x AS (SELECT symbol, bar, close, {mean('close', 20)} AS mid, {dev('close', 20)} AS sd FROM grid)
      SELECT symbol, bar, {rnd('mid')}, {rnd('mid + 2 * sd', 'upper')}, {rnd('mid - 2 * sd', 'lower')} FROM x WHERE close IS NOT NULL""",
    "realized_vol": f"WITH {PANEL}, {RV} SELECT symbol, bar, {rnd('rv')} FROM rv WHERE close IS NOT NULL",
    "volume_flag": f"WITH {PANEL}, x AS (SELECT symbol, bar, close, coalesce(close >= lag(close) OVER w, TRUE) AS up FROM grid {W}) SELECT symbol, bar, up FROM x WHERE close IS NOT NULL",
    "trend_filter": f"WITH {PANEL}, x AS (SELECT symbol, bar, close, coalesce(({mean('close', 10)}) > ({mean('close', 30)}), FALSE) AS ok FROM grid) SELECT symbol, bar, ok FROM x WHERE close IS NOT NULL",
    "ema": f"WITH RECURSIVE {PANEL}, {OWN}, {ewm('e', 'own', 'close', 2 / 13)} SELECT o.symbol, o.bar, {rnd('e.y', 'ema')} FROM own o JOIN e USING (symbol, k)",
    "macd": f"""WITH RECURSIVE {PANEL}, {OWN}, {ewm('f', 'own', 'close', 2 / 13)}, {ewm('s', 'own', 'close', 2 / 27)},
      l AS (SELECT o.symbol, o.k, o.bar, f.y - s.y AS line FROM own o JOIN f USING (symbol, k) JOIN s USING (symbol, k)), {ewm('g', 'l', 'line', 0.2)}
      SELECT l.symbol, l.bar, {rnd('l.line', 'macd')}, {rnd('g.y', 'signal')}, {rnd('l.line - g.y', 'hist')} FROM l JOIN g USING (symbol, k)""",
    "rsi": f"""WITH RECURSIVE {PANEL}, {OWN}, c AS (SELECT symbol, bar, k, greatest(close - lag(close) OVER v, 0) AS up, greatest(lag(close) OVER v - close, 0) AS dn, lag(close) OVER v IS NULL AS f FROM own WINDOW v AS (PARTITION BY symbol ORDER BY k)),
      d AS (SELECT symbol, bar, k, CASE WHEN NOT f THEN up END AS up, CASE WHEN NOT f THEN dn END AS dn FROM c), {ewm('g', 'd', 'up', 1 / 14)}, {ewm('l', 'd', 'dn', 1 / 14)}
      SELECT d.symbol, d.bar, {rnd('coalesce(100 - 100 / (1 + g.y / nullif(l.y, 0)), 50)', 'rsi')} FROM d JOIN g USING (symbol, k) JOIN l USING (symbol, k)""",
    "dmi_dashboard": f"""WITH RECURSIVE {PANEL}, {DMI_OWN}, {DMI_SUMS}, {DI}, {DX}, {ewm('ax', 'dx', 'dx', 1 / 14)}
      SELECT d.symbol, d.bar, {rnd('coalesce(d.plus_di, 0)', 'plus_di')}, {rnd('coalesce(d.minus_di, 0)', 'minus_di')}, {rnd('coalesce(ax.y, 0)', 'adx')} FROM dx d JOIN ax USING (symbol, k)""",
    "dmi_panel": f"WITH RECURSIVE {PANEL}, {_PANEL_DMI} SELECT symbol, bar, {rnd('plus_di')}, {rnd('minus_di')}, {rnd('y', 'adx')} FROM pd",
    "dmi_intraday": f"""WITH RECURSIVE {PANEL}, {DMI_OWN}, {DMI_SUMS}, {DI}
      SELECT symbol, bar, {rnd('CASE WHEN k >= 14 THEN coalesce(plus_di, 0) END', 'plus_di')}, {rnd('CASE WHEN k >= 14 THEN coalesce(minus_di, 0) END', 'minus_di')} FROM di""",
    "topn_rank": f"WITH {rotation()}, q AS (SELECT bar, symbol, row_number() OVER (PARTITION BY bar ORDER BY roc DESC, symbol) AS rank, roc FROM sig WHERE ok AND roc IS NOT NULL) SELECT bar, symbol, rank, {rnd('roc')} FROM q WHERE rank <= 2",
    "bollinger_rsi_cross": cross(14, 2.0),
    "bollinger_rsi_cross_fast": cross(3, 1.0),
    "hedge_ratio": f"WITH {spreads(0)} SELECT a, b, count(*) AS n, {rnd('any_value(alpha)', 'alpha')}, {rnd('any_value(beta)', 'beta')} FROM spr GROUP BY a, b",
    "adf_screen": f"WITH {spreads()}, {df('spr', 'a, b', 'spread')} SELECT a, b, n, {rnd('gamma')}, {rnd('tau')} FROM adf",
    "ou_half_life": f"WITH {spreads()}, {df('spr', 'a, b', 'spread')} SELECT a, b, {rnd('hl', 'half_life')} FROM adf",
    "ou_sigma": f"WITH {spreads()}, {df('spr', 'a, b', 'spread')} SELECT a, b, {rnd('sigma')} FROM adf",
    "hurst_levels": f"WITH {spreads()}, {hurst('spr', ['a', 'b'], 'spread')} SELECT a, b, {rnd('h')} FROM hu",
    "hurst_log": f"""WITH {PANEL}, lx AS (SELECT symbol, bar AS i, ln(close) AS x FROM grid WHERE close IS NOT NULL), {hurst('lx', ['symbol'], 'x')}
      SELECT symbol, {rnd('h')}, CASE WHEN h < 0.4 THEN 'mean reverting' WHEN h > 0.6 THEN 'trending' ELSE 'random walk' END AS regime FROM hu""",
    "hurst_lag_sensitivity": f"""WITH {PANEL}, lx AS (SELECT symbol, p.pct, bar AS i, ln(close) AS x FROM grid, (SELECT unnest([2, 5, 10, 20, 30, 40]) AS pct) p WHERE close IS NOT NULL), {hurst('lx', ['symbol', 'pct'], 'x', 'greatest(n * pct // 100, 4)')}
      SELECT symbol, pct, {rnd('h')} FROM hu""",
    "pair_screen_full": f"""WITH {spreads()}, {df('spr', 'a, b', 'spread')}, {hurst('spr', ['a', 'b'], 'spread')}
      SELECT a || '/' || b AS pair, {rnd('f.beta', 'beta')}, {rnd('tau', 'adf_stat')}, {rnd('h')}, {rnd('hl', 'half_life_bars')}, {rnd('hl / 24', 'half_life_days')}, (SELECT count(*) FROM spr s WHERE s.a = adf.a AND s.b = adf.b) AS n_bars,
        coalesce(tau < -2.86 AND h < 0.45 AND hl IS NOT NULL, FALSE) AS qualifies FROM adf JOIN hu USING (a, b) JOIN fit f USING (a, b)""",
    "pair_screen_wide": f"""WITH {spreads(12).replace(BARS, USERS)}, {df('spr', 'a, b', 'spread')}, {hurst('spr', ['a', 'b'], 'spread')}, cnt AS (SELECT a, b, count(*) AS n_bars FROM spr GROUP BY a, b)
      SELECT a || '/' || b AS pair, round(f.beta, 4) + 0.0 AS beta, round(tau, 4) + 0.0 AS adf_stat, round(h, 4) + 0.0 AS h, n_bars, coalesce(tau < -2.86 AND h < 0.45 AND hl IS NOT NULL, FALSE) AS qualifies
      FROM cnt JOIN fit f USING (a, b) JOIN adf USING (a, b) LEFT JOIN hu USING (a, b)""",
    "pair_screen_intraday": f"""WITH {spreads(200, 'sess < 18')}, {df('spr', 'a, b', 'spread')}, {hurst('spr', ['a', 'b'], 'spread')}
      SELECT a || '/' || b AS pair, {rnd('f.beta', 'beta')}, {rnd('tau', 'adf_stat')}, {rnd('h')}, coalesce(tau < -2.86 AND h < 0.45 AND hl IS NOT NULL AND beta > 0 AND beta < 3, FALSE) AS qualifies FROM adf JOIN hu USING (a, b) JOIN fit f USING (a, b)""",
    "selected_pair": f"""WITH {spreads()}, {df('spr', 'a, b', 'spread')}, {hurst('spr', ['a', 'b'], 'spread')}, q AS (
      SELECT a || '/' || b AS pair, tau, coalesce(tau < -2.86 AND h < 0.45 AND hl IS NOT NULL, FALSE) AS qualifies FROM adf JOIN hu USING (a, b))
      SELECT pair, {rnd('tau', 'adf_stat')}, qualifies FROM q ORDER BY qualifies DESC, tau, pair LIMIT 1""",
    "vol_screen": f"""WITH {PANEL}, {RV}, rw AS (SELECT symbol, bar AS i, sess, rv FROM rv WHERE rv IS NOT NULL), {df('rw', 'symbol', 'rv')}, {hurst('rw', ['symbol'], 'rv')}
      SELECT symbol, {rnd('tau', 'adf_stat')}, {rnd('h')}, coalesce(tau < -2.86 AND h < 0.45, FALSE) AS qualifies FROM adf JOIN hu USING (symbol)""",
    "rolling_ols_z": f"""WITH {pairs()}, o AS (
      SELECT p.a, p.b, p.i, any_value(p.la) AS la, any_value(p.lb) AS lb, count(*) AS n, regr_slope(q.la, q.lb) AS beta, regr_intercept(q.la, q.lb) AS alpha, regr_syy(q.la, q.lb) AS syy, regr_sxy(q.la, q.lb) AS sxy
      FROM prs p LEFT JOIN prs q ON p.a = q.a AND p.b = q.b AND q.i >= p.i - 60 AND q.i < p.i GROUP BY p.a, p.b, p.i)
      SELECT a, b, i, {rnd('CASE WHEN i >= 60 THEN beta END', 'beta')}, {rnd('CASE WHEN i >= 60 THEN (la - beta * lb - alpha) / nullif(sqrt(greatest(syy - beta * sxy, 0) / n), 0) END', 'z')} FROM o""",
    "rolling_z": f"WITH {SPREAD_Z} SELECT a, b, i, {rnd('z')} FROM zs",
    "session_z": f"WITH {SESSION_Z} SELECT a, b, i, {rnd('z')} FROM zs",
    "variable_window_z": f"""WITH {spreads()}, v AS (SELECT *, 10 + ((i // 50) % 5) * 20 AS zw FROM spr), o AS (
      SELECT v.a, v.b, v.i, v.zw, any_value(v.spread) AS s, count(q.i) AS n, avg(q.spread) AS m, stddev_pop(q.spread) AS d
      FROM v LEFT JOIN spr q ON q.a = v.a AND q.b = v.b AND q.i < v.i AND q.i >= v.i - v.zw GROUP BY v.a, v.b, v.i, v.zw)
      SELECT a, b, i, zw, {rnd('CASE WHEN n >= 10 AND d > 1e-9 THEN (s - m) / d ELSE 0 END', 'z')} FROM o""",
    "rv_z": f"WITH {PANEL}, {RV}, {RVZ} SELECT symbol, bar, {rnd('z')} FROM zs",
    "walk_forward_refits": f"""WITH {pairs()}, rf AS (SELECT DISTINCT a, b, sess AS refit FROM prs WHERE sess >= 5 AND (sess - 5) % 5 = 0),
      win AS (SELECT p.a || '|' || p.b || '|' || r.refit AS key, p.*, r.refit FROM rf r JOIN prs p ON p.a = r.a AND p.b = r.b AND p.sess >= r.refit - 5 AND p.sess < r.refit),
      ft AS (SELECT key, any_value(a) AS a, any_value(b) AS b, any_value(refit) AS refit, count(*) AS c, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta FROM win GROUP BY key HAVING count(*) >= 50),
      spr AS (SELECT w.key, w.i, w.sess, w.la - f.beta * w.lb - f.alpha AS spread FROM win w JOIN ft f USING (key)), {df('spr', 'key', 'spread')}, {hurst('spr', ['key'], 'spread')}
      SELECT f.a, f.b, f.refit, f.c AS n, {rnd('f.beta', 'beta')}, {rnd('tau', 'adf_stat')}, {rnd('h')}, CAST(coalesce(least(greatest(round_even(3 * hl, 0), 10), 500), 500) AS BIGINT) AS zw,
        coalesce(tau < -2.86 AND h < 0.5 AND hl IS NOT NULL, FALSE) AS qualified FROM adf JOIN hu USING (key) JOIN ft f USING (key)""",
    "beta_stability": f"""WITH {pairs()}, rf AS (SELECT DISTINCT a, b, sess AS refit FROM prs WHERE sess >= 5),
      ft AS (SELECT p.a, p.b, r.refit, regr_slope(la, lb) AS beta FROM rf r JOIN prs p ON p.a = r.a AND p.b = r.b AND p.sess >= r.refit - 5 AND p.sess < r.refit GROUP BY p.a, p.b, r.refit HAVING count(*) >= 50),
      se AS (SELECT DISTINCT a, b, sess FROM prs), bs AS (SELECT s.a, s.b, s.sess, f.beta FROM se s ASOF JOIN ft f ON s.a = f.a AND s.b = f.b AND s.sess >= f.refit)
      SELECT a, b, {rnd('min(beta)', 'lo')}, {rnd('max(beta)', 'hi')}, {rnd('stddev_samp(beta)', 'dev')}, max(beta) - min(beta) > 0.5 OR sign(min(beta)) <> sign(max(beta)) AS unstable FROM bs GROUP BY a, b""",
    "state_machine_spread": f"{SPREAD_FOLD} SELECT a, b, i, {rnd('shown', 'position')}, closed AS entry, reason FROM m WHERE q > 0",
    "state_machine_intraday": f"WITH RECURSIVE {SESSION_Z}, {INTRADAY_FOLD} SELECT a, b, i, {rnd('shown', 'position')}, closed AS entry, reason FROM m WHERE q > 0",
    "state_machine_vol": f"WITH RECURSIVE {PANEL}, {DMI_OWN}, {DMI_SUMS}, {DI}, {RV}, {RVZ}, {VOL_SIDE}, {VOL_FOLD} SELECT symbol, bar, {rnd('shown', 'position')}, closed AS entry, reason FROM m WHERE q > 0",
    "vol_regimes": f"WITH {PANEL}, {RV}, {REGIME} SELECT symbol, sess, n, {rnd('tau')}, {rnd('h')}, ok AS qualified FROM reg",
    "vol_walk_forward": f"WITH {PANEL}, {RV}, {RVZ}, {REGIME} SELECT zs.symbol, zs.bar, {rnd('zs.z', 'z')}, reg.ok AS qualified FROM zs JOIN reg USING (symbol, sess) WHERE zs.sess >= {OOS}",
    "vol_walk_forward_positions": f"""WITH RECURSIVE {PANEL}, {DMI_OWN}, {DMI_SUMS}, {DI}, {RV}, {RVZ}, {VOL_SIDE}, {REGIME}, so AS (
      SELECT sd.*, reg.ok FROM sd JOIN cal USING (bar) JOIN reg ON reg.symbol = sd.symbol AND reg.sess = cal.sess WHERE cal.sess >= {OOS}), {VOL_FOLD_OK}
      SELECT symbol, bar, {rnd('shown', 'position')}, closed AS entry, reason FROM m WHERE q > 0""",
    "vol_target_scale": f"{SPREAD_BOOK} SELECT a, b, i, {rnd('sigma')}, {rnd('scale')} FROM sc",
    "spread_pnl": f"{SPREAD_BOOK} SELECT a, b, i, {rnd('pnl')} FROM book",
    "trade_log": f"""{SPREAD_BOOK} SELECT a, b, entry_ts, exit_ts, direction, CASE WHEN direction = 'long' THEN 'buy ' || a || ' / sell ' || b ELSE 'sell ' || a || ' / buy ' || b END AS label,
      {rnd('entry_z')}, {rnd('exit_z')}, exit - entry AS hold_bars, exit_reason FROM lg""",
    "trade_pnl": f"{SPREAD_BOOK} SELECT a, b, entry, exit, {rnd('pnl')} FROM lg",
    "trade_prices": f"{SPREAD_BOOK} SELECT a, b, entry, exit, {rnd('entry_price_a')}, {rnd('entry_price_b')}, {rnd('exit_price_a')}, {rnd('exit_price_b')} FROM lg",
    "legs": f"""{SPREAD_BOOK}, l AS (
      SELECT a, b, entry, 'a' AS leg, a AS symbol, CASE WHEN direction = 'long' THEN 'buy' ELSE 'sell' END AS side, entry_price_a AS p0, exit_price_a AS p1, 10000.0::DOUBLE AS amount FROM lg
      UNION ALL SELECT a, b, entry, 'b', b, CASE WHEN direction = 'long' THEN 'sell' ELSE 'buy' END, entry_price_b, exit_price_b, 10000.0::DOUBLE * abs(beta) FROM lg)
      SELECT a, b, entry, leg, symbol, side, {rnd("CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (p1 / p0 - 1) * 100", 'move_pct')}, {rnd('amount')}, CAST(floor(amount / p0) AS BIGINT) AS shares FROM l""",
    "exit_reason_counts": f"{SPREAD_BOOK} SELECT a, b, exit_reason, count(*) AS n FROM lg GROUP BY ALL",
    "momentum_baskets": f"WITH {rotation()} SELECT t0, symbol, rank, {rnd('weight')} FROM held",
    "momentum_pnl": f"WITH {rotation()} SELECT bar, {rnd('pnl')}, n_held FROM pnl",
    "momentum_turnover": f"WITH {rotation()} SELECT bar, CAST(dropped AS BIGINT) AS dropped, CAST(added AS BIGINT) AS added, {rnd('CAST(turnover AS DOUBLE)', 'turnover')} FROM trn",
    "momentum_trades": f"WITH {rotation()} SELECT symbol, entry, exit, hold_bars, exit_reason, {rnd('pnl')} FROM trd",
    "per_ticker_summary": f"WITH {rotation()} SELECT symbol, count(*) AS n_trades, {rnd('avg(pnl)', 'mean_pnl')}, {rnd('sum(pnl)', 'pnl')}, {rnd('avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END)', 'win_rate')}, {rnd('avg(hold_bars)', 'mean_hold')} FROM trd GROUP BY symbol",
    "buy_and_hold": f"WITH {rotation()} SELECT bar, {rnd('coalesce(avg(ret), 0)', 'pnl')} FROM sig, prm WHERE bar >= start AND close IS NOT NULL GROUP BY bar",
    "phase_sweep": f"WITH {rotation(phases=24)}, {stat('pnl', 'phase')} SELECT phase, n, {rnd('ann_return')}, {rnd('ann_vol')}, {rnd('sharpe')}, {rnd('max_drawdown')} FROM perf",
    "tranche": f"WITH {rotation(phases=24)} SELECT bar, {rnd('avg(pnl)', 'pnl')} FROM pnl, prm WHERE bar >= start + 24 GROUP BY bar",
    "equity_curve": f"WITH {rotation()} SELECT bar, {rnd('100000 + sum(pnl * 100000) OVER (ORDER BY bar)', 'equity')} FROM pnl",
    "performance_stats": f"WITH {rotation()}, {stat('pnl', '')} SELECT n, {rnd('ann_return')}, {rnd('ann_vol')}, {rnd('sharpe')}, {rnd('max_drawdown')} FROM perf",
    "drawdown": f"WITH {rotation()}, {stat('pnl', '')} SELECT bar, {rnd('c', 'cum')}, {rnd('d', 'drawdown')}, {rnd('d0', 'drawdown0')} FROM dd",
    "cost_sensitivity_basket": f"WITH {rotation()}, cs AS ({COSTED}), {stat('cs', 'cost_bps')} SELECT cost_bps, {rnd('ann_return')}, {rnd('sharpe')} FROM perf",
    "cost_sensitivity": f"""{SPREAD_BOOK}, tv AS (SELECT a, b, i, pnl, abs(position - coalesce(lag(position) OVER (PARTITION BY a, b ORDER BY i), 0)) AS turnover FROM book),
      cs AS (SELECT a, b, i, cost_bps, pnl - turnover * cost_bps / 10000.0 AS pnl FROM tv, (SELECT unnest([0, 1, 2, 5, 10, 20]) AS cost_bps)), {stat('cs', 'a, b, cost_bps', 'i')}
      SELECT a, b, cost_bps, {rnd('ann_return')}, {rnd('sharpe')} FROM perf""",
    "breakeven_cost": f"WITH {rotation()}, cs AS ({COSTED}), {stat('cs', 'cost_bps')} SELECT CAST(min(cost_bps) FILTER (sharpe <= 0) AS BIGINT) AS breakeven_bps FROM perf",
    "momentum_variants": _variants(),
    "start_date_sweep": " UNION ALL ".join(
        f"SELECT * FROM (WITH {rotation(start=s)}, {stat('pnl', '')} SELECT {s} AS start, n, {rnd('ann_return')}, {rnd('sharpe')} FROM perf)" for s in (60, 150, 240, 330)
    ),
    "parameter_grid": " UNION ALL ".join(
        f"SELECT * FROM (WITH {rotation(lookback=x, top=t)}, {stat('pnl', '')} SELECT {x} AS lookback, {t} AS top, {rnd('ann_return')}, {rnd('sharpe')} FROM perf)" for x in (10, 20, 40) for t in (1, 2)
    ),
    "perturbation": f"WITH base AS (SELECT * FROM (WITH {rotation()}, {stat('pnl', '')} SELECT sharpe AS s0 FROM perf)), p AS (" + " UNION ALL ".join(
        f"SELECT * FROM (WITH {rotation(**{k: v})}, {stat('pnl', '')} SELECT '{k}' AS key, {v} AS value, sharpe FROM perf)" for k, v in (("lookback", 18), ("lookback", 22), ("every", 21), ("every", 26))
    ) + f") SELECT key, value, {rnd('sharpe')}, {rnd('sharpe - s0', 'delta')} FROM p, base",
    "permutation_test": f"""WITH {rotation()}, pk AS (
      SELECT sim, symbol, bar + 1 AS t0, row_number() OVER (PARTITION BY sim, bar ORDER BY md5(sim || '|' || symbol || '|' || (bar + 1))) AS k
      FROM sig, prm, (SELECT unnest(range(20)) AS sim) WHERE ok AND roc IS NOT NULL AND bar + 1 >= start AND (bar + 1 - start) % 24 = 0 AND bar + 1 < bars),
      ph AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY sim, t0) AS weight FROM pk WHERE k <= 2)
      SELECT sim, {rnd('sum(weight * coalesce(g.ret, 0))', 'total')} FROM ph JOIN sig g ON g.symbol = ph.symbol AND g.bar >= t0 AND g.bar < t0 + 24 GROUP BY sim""",
    "runner_consistency": f"WITH {rotation()} SELECT 0.0::DOUBLE AS worst, count(*) AS n FROM pnl",
    "block_bootstrap": f"WITH {rotation()}, {boot('pnl', ['pnl'])} SELECT boot, {rnd(boot_sharpe('pnl'), 'sharpe')} FROM dr",
    "bootstrap_significance": f"""WITH {rotation()}, {boot('pnl', ['pnl'])}, s AS (SELECT {boot_sharpe('pnl')} AS sharpe FROM dr)
      SELECT {rnd('quantile_cont(sharpe, 0.05)', 'p05')}, {rnd('quantile_cont(sharpe, 0.5)', 'p50')}, {rnd('quantile_cont(sharpe, 0.95)', 'p95')}, {rnd('avg(CASE WHEN sharpe > 0 THEN 1.0::DOUBLE ELSE 0.0 END)', 'p_positive')},
        count(*) FILTER (sharpe IS NULL) AS degenerate FROM s""",
    "paired_bootstrap": f"""WITH {rotation()}, bh AS (SELECT bar, coalesce(avg(ret), 0) AS hold FROM sig, prm WHERE bar >= start AND close IS NOT NULL GROUP BY bar), bo AS (SELECT bar, pnl, hold FROM pnl JOIN bh USING (bar)), {boot('bo', ['pnl', 'hold'])}
      SELECT boot, {rnd(boot_sharpe('pnl') + ' - ' + boot_sharpe('hold'), 'diff')} FROM dr""",
}
ORACLE["tick_bars"] = ORACLE["panel_hourly_bars"]

#: Refits in force (the last at or before a session), windows of each row's own length by a range join.
WALK = f"""{pairs()}, rf AS (SELECT DISTINCT a, b, sess AS refit FROM prs WHERE sess >= 5 AND (sess - 5) % 5 = 0),
  win AS (SELECT p.a || '|' || p.b || '|' || r.refit AS key, p.*, r.refit FROM rf r JOIN prs p ON p.a = r.a AND p.b = r.b AND p.sess >= r.refit - 5 AND p.sess < r.refit),
  ft AS (SELECT key, any_value(a) AS a, any_value(b) AS b, any_value(refit) AS refit, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta FROM win GROUP BY key HAVING count(*) >= 50),
  spr AS (SELECT w.key, w.i, w.sess, w.la - f.beta * w.lb - f.alpha AS spread FROM win w JOIN ft f USING (key)), {df('spr', 'key', 'spread')}, {hurst('spr', ['key'], 'spread')}, fits AS (
  SELECT f.a, f.b, f.refit, f.alpha, f.beta, CAST(coalesce(least(greatest(round_even(3 * hl, 0), 10), 500), 500) AS BIGINT) AS zw, coalesce(tau < -2.86 AND h < 0.5 AND hl IS NOT NULL, FALSE) AS qualified
  FROM adf JOIN hu USING (key) JOIN ft f USING (key)), hd AS (
  SELECT p.a, p.b, p.ts, p.la, p.lb, p.sess, f.alpha, f.beta, f.zw, f.qualified AS ok, p.i AS at, row_number() OVER (PARTITION BY p.a, p.b ORDER BY p.i) - 1 AS i
  FROM prs p ASOF JOIN fits f ON p.a = f.a AND p.b = f.b AND p.sess >= f.refit), wz AS (
  SELECT p.a, p.b, p.i, count(q.i) AS n, avg(q.la - p.beta * q.lb - p.alpha) AS m, stddev_pop(q.la - p.beta * q.lb - p.alpha) AS d
  FROM hd p LEFT JOIN prs q ON q.a = p.a AND q.b = p.b AND q.i < p.at AND q.i >= p.at - p.zw GROUP BY p.a, p.b, p.i), zs AS (
  SELECT p.*, p.la - p.beta * p.lb - p.alpha AS spread, p.la AS pa, p.lb AS pb, CASE WHEN w.n >= 10 AND w.d > 1e-9 THEN (p.la - p.beta * p.lb - p.alpha - w.m) / w.d ELSE 0.0 END AS z
  FROM hd p JOIN wz w USING (a, b, i)), {FOLD}, {BOOK}"""
ORACLE |= {
    "walk_forward_meanrev": f"WITH RECURSIVE {WALK} SELECT a, b, i, ok AS qualified, zw, {rnd('z')}, {rnd('position')}, {rnd('scale')}, {rnd('pnl')} FROM book",
    "meanrev_trades": f"WITH RECURSIVE {WALK} SELECT a, b, entry, exit, direction, exit - entry AS hold_bars, exit_reason, {rnd('pnl')} FROM lg",
    "meanrev_universe": f"WITH RECURSIVE {WALK}, {stat('book', 'a, b', 'i')} SELECT a, b, n, {rnd('ann_return')}, {rnd('sharpe')}, {rnd('max_drawdown')}, coalesce(sharpe, 0) > 0 AS profitable FROM perf",
    "vol_basket": f"""WITH RECURSIVE {PANEL}, {DMI_OWN}, {DMI_SUMS}, {DI}, {RV}, {RVZ}, {VOL_SIDE}, {VOL_FOLD}, pl AS (
      SELECT m.symbol, m.bar, coalesce(lag(m.shown) OVER v * (ln(g.close) - lag(ln(g.close)) OVER v), 0.0) AS pnl FROM m JOIN grid g USING (symbol, bar) WHERE q > 0 WINDOW v AS (PARTITION BY symbol ORDER BY bar))
      SELECT bar, {rnd('sum(pnl) * 100000 / (SELECT count(DISTINCT symbol) FROM grid)', 'won')} FROM pl GROUP BY bar""",
    "trade_amounts": f"""WITH {rotation()} SELECT t.symbol, t.entry, t.exit, {rnd('x.close', 'entry_price')}, {rnd('y.close', 'exit_price')}, {rnd('100000.0::DOUBLE / p.n_held', 'amount')}, CAST(floor(100000.0::DOUBLE / p.n_held / x.close) AS BIGINT) AS shares
      FROM trd t JOIN pnl p ON p.bar = t.entry LEFT JOIN sig x ON x.symbol = t.symbol AND x.bar = t.entry LEFT JOIN sig y ON y.symbol = t.symbol AND y.bar = t.exit""",
    "phase_percentiles": f"WITH {rotation(phases=24)}, {stat('pnl', 'phase')} SELECT {rnd('min(sharpe)', 'lo')}, {rnd('quantile_cont(sharpe, 0.05)', 'p05')}, {rnd('quantile_cont(sharpe, 0.5)', 'p50')}, {rnd('quantile_cont(sharpe, 0.95)', 'p95')}, {rnd('max(sharpe)', 'hi')} FROM perf",
    "change_pct": f"""WITH {PANEL}, {OWN}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY k) AS before FROM own)
      SELECT symbol, {rnd('arg_max(close, k)', 'last')}, {rnd('(arg_max(close, k) / (SELECT before FROM l z WHERE z.symbol = l.symbol ORDER BY k DESC LIMIT 1) - 1) * 100', 'day_pct')}, {rnd('(arg_max(close, k) / arg_min(close, k) - 1) * 100', 'total_pct')} FROM l GROUP BY symbol""",
    "chart_range": f"WITH {PANEL} SELECT symbol, {rnd('min(close) - (max(close) - min(close)) * 0.05', 'lo')}, {rnd('max(close) + (max(close) - min(close)) * 0.05', 'hi')} FROM grid WHERE bar >= 50 AND close IS NOT NULL GROUP BY symbol",
}

#: Refits of every session, z inside the session, flat at its end.
_INTRADAY = f"""{pairs()}, rf AS (SELECT DISTINCT a, b, sess AS refit FROM prs WHERE sess >= 1),
  win AS (SELECT p.a || '|' || p.b || '|' || r.refit AS key, p.*, r.refit FROM rf r JOIN prs p ON p.a = r.a AND p.b = r.b AND p.sess >= r.refit - 5 AND p.sess < r.refit),
  ft AS (SELECT key, any_value(a) AS a, any_value(b) AS b, any_value(refit) AS refit, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta FROM win GROUP BY key HAVING count(*) >= 50),
  spr AS (SELECT w.key, w.i, w.sess, w.la - f.beta * w.lb - f.alpha AS spread FROM win w JOIN ft f USING (key)), {df('spr', 'key', 'spread')}, {hurst('spr', ['key'], 'spread')}, fits AS (
  SELECT f.a, f.b, f.refit, f.alpha, f.beta, coalesce(tau < -2.86 AND h < 0.5 AND hl IS NOT NULL, FALSE) AND f.beta > 0 AND f.beta < 3 AS ok FROM adf JOIN hu USING (key) JOIN ft f USING (key)), hd AS (
  SELECT p.a, p.b, p.i, p.sess, f.ok, p.la - f.beta * p.lb - f.alpha AS spread FROM prs p ASOF JOIN fits f ON p.a = f.a AND p.b = f.b AND p.sess >= f.refit), zs AS (
  SELECT *, CASE WHEN count(spread) OVER w >= 10 THEN coalesce((spread - avg(spread) OVER w) / nullif(stddev_pop(spread) OVER w, 0), 0.0) ELSE 0.0 END AS z,
    coalesce(lead(sess) OVER v <> sess, TRUE) AS fin, coalesce(spread - lag(spread) OVER v, 0.0) AS change
  FROM hd WINDOW w AS (PARTITION BY a, b, sess ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY a, b ORDER BY i))"""
_INTRADAY_FOLD = machine(
    "zs", "a, b", f"CASE WHEN NOT s.ok THEN 0.0 ELSE {_TWO} END",
    f"CASE WHEN s.fin THEN 0.0 ELSE u.nxt0 END, CASE WHEN m.pos <> 0 AND u.nxt0 = 0 THEN CASE WHEN NOT s.ok THEN 'regime break' ELSE {_TWO_WHY} END WHEN s.fin AND u.nxt0 <> 0 THEN 'end of day' END, FALSE",
)
#: Rolling regressions by a range join.
_DAILY = f"""bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS close FROM orders GROUP BY ALL), full_ AS (
  SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)), joined AS (
  SELECT x.symbol AS a, y.symbol AS b, x.ts, x.close AS pa, y.close AS pb, count(*) OVER (PARTITION BY x.symbol, y.symbol) AS total
  FROM bars x JOIN bars y ON x.ts = y.ts AND x.symbol < y.symbol JOIN full_ f ON f.ts = x.ts), prs AS (
  SELECT a, b, ln(pa) AS la, ln(pb) AS lb, row_number() OVER (PARTITION BY a, b ORDER BY ts) - 1 AS i FROM joined WHERE total >= 200), o AS (
  SELECT p.a, p.b, p.i, any_value(p.la) AS la, any_value(p.lb) AS lb, count(*) AS n, regr_slope(q.la, q.lb) AS beta, regr_intercept(q.la, q.lb) AS alpha, regr_syy(q.la, q.lb) AS syy, regr_sxy(q.la, q.lb) AS sxy
  FROM prs p JOIN prs q ON p.a = q.a AND p.b = q.b AND q.i >= p.i - 120 AND q.i < p.i GROUP BY p.a, p.b, p.i), zz AS (
  SELECT a, b, i, beta, la - beta * lb - alpha AS spread, (la - beta * lb - alpha) / nullif(sqrt(greatest(syy - beta * sxy, 0) / n), 0) AS z, TRUE AS ok FROM o WHERE n = 120), zs AS (SELECT * FROM zz WHERE z IS NOT NULL), {FOLD}"""
ORACLE |= {
    "intraday_walk_forward": f"""WITH RECURSIVE {_INTRADAY}, {_INTRADAY_FOLD}, bk AS (
      SELECT z.*, m.shown, coalesce(lag(m.shown) OVER (PARTITION BY z.a, z.b ORDER BY z.i) * z.change, 0.0) AS pnl FROM zs z JOIN m USING (a, b, i))
      SELECT a, b, i, ok AS qualified, {rnd('z')}, {rnd('shown', 'position')}, {rnd('pnl')} FROM bk""",
    "daily_walk_forward": f"""WITH RECURSIVE {_DAILY}, bk AS (
      SELECT z.*, m.shown, coalesce(lag(m.shown) OVER w * (z.spread - lag(z.spread) OVER w), 0.0) AS pnl FROM zs z JOIN m USING (a, b, i) WINDOW w AS (PARTITION BY z.a, z.b ORDER BY z.i))
      SELECT a, b, i, {rnd('beta')}, {rnd('shown', 'position')}, {rnd('pnl')} FROM bk""",
}


def phi(x: str) -> str:
    """The normal distribution function as a Simpson sum."""
    return (
        f"(0.5 + ({x}) / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), "
        f"lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(0 - (({x}) * i / 1000) ** 2 / 2))))"
    )


#: Families with their length, Sharpe ratio of a bar and share of profitable units.
_EVAL = f"""ev AS (
  SELECT 'rotation' AS family, * FROM (WITH {rotation()} SELECT count(*) AS n, avg(pnl) / nullif(stddev_pop(pnl), 0) AS s,
    (SELECT avg(CASE WHEN p > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 FROM (SELECT sum(pnl) AS p FROM trd GROUP BY symbol)) AS pct FROM pnl)
  UNION ALL
  SELECT 'mean reversion', * FROM ({SPREAD_BOOK}, per AS (SELECT a, b, count(*) AS n, avg(pnl) / nullif(stddev_pop(pnl), 0) AS s FROM book GROUP BY a, b)
    SELECT n, s, (SELECT avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 FROM per) AS pct FROM per ORDER BY s DESC NULLS LAST, a, b LIMIT 1)), ds AS (
  SELECT *, {phi(f"(s - {expected_max_sharpe(14, 0.02)!r}) / sqrt((1 + s * s / 2) / (n - 1))")} AS dsr FROM ev)"""
#: Three regressors by centred sums.
_LAGGED = f"""{spreads()}, dd AS (
  SELECT a, b, spread - lag(spread) OVER w AS y, lag(spread) OVER w AS x, lag(spread) OVER w - lag(spread, 2) OVER w AS z FROM spr WINDOW w AS (PARTITION BY a, b ORDER BY i)), sm AS (
  SELECT a, b, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxx(y, z) AS zz, regr_sxy(z, x) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, z) AS zy, regr_syy(y, x) AS yy
  FROM dd WHERE z IS NOT NULL GROUP BY a, b), so AS (
  SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS g, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM sm), se AS (
  SELECT *, sqrt((yy - g * xy - c * zy) / (n - 3) * zz / (xx * zz - xz * xz)) AS error FROM so), st AS (SELECT *, g / error AS tau FROM se)"""
_POLY = "CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau ** 2 ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau ** 2 - 0.010368 * tau ** 3 END"
_NAIVE = machine(
    "zs", "a, b", "CASE WHEN s.z IS NULL THEN m.pos WHEN m.pos = 0 THEN CASE WHEN s.z > 1.5 THEN -1.0 WHEN s.z < -1.5 THEN 1.0 ELSE 0.0 END WHEN m.pos > 0 AND s.z >= 0 THEN 0.0 WHEN m.pos < 0 AND s.z <= 0 THEN 0.0 ELSE m.pos END",
    "u.nxt0, CASE WHEN m.pos <> 0 AND u.nxt0 = 0 THEN 'reversion' END, s.z IS NULL",
)
_HURST = f"""{PANEL}, an AS (SELECT DISTINCT c.bar AS t FROM cal c WHERE c.bar >= 119 AND (c.bar - 119) % 9 = 0), wn AS (
  SELECT g.symbol, a.t, g.bar AS i, ln(g.close) AS x, count(g.close) OVER (PARTITION BY g.symbol, a.t) AS known FROM an a JOIN grid g ON g.bar > a.t - 120 AND g.bar <= a.t), wf AS (
  SELECT * FROM wn WHERE known = 120), {hurst('wf', ['symbol', 't'], 'x')}, rh AS (
  SELECT g.symbol, g.bar, last_value(h.h IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar) AS hurst FROM grid g LEFT JOIN hu h ON h.symbol = g.symbol AND h.t = g.bar)"""
ORACLE |= {
    "deflated_sharpe": f"WITH {_EVAL} SELECT family, n, {rnd('s', 'sharpe_bar')}, {rnd('dsr')} FROM ds",
    "leaderboard": f"WITH {_EVAL} SELECT family, {rnd('pct', 'pct_profitable')}, {rnd('dsr')} FROM ds",
    "adf_lagged": f"WITH {_LAGGED} SELECT a, b, {rnd('g', 'gamma')}, {rnd('error')}, {rnd('tau')}, {rnd(f'CASE WHEN tau > 2.74 THEN 1 WHEN tau < -18.83 THEN 0 ELSE {phi(_POLY)} END', 'p')} FROM st",
    "red_flags": f"""SELECT a, b, coalesce(p.sharpe > 3, FALSE) AS too_good, coalesce(f.unstable, FALSE) AS unstable
      FROM ({SPREAD_BOOK}, {stat('book', 'a, b', 'i')} SELECT a, b, sharpe FROM perf) p LEFT JOIN ({ORACLE['beta_stability']}) f USING (a, b)""",
    "naive_static_z": f"""WITH RECURSIVE {spreads()}, zs AS (
      SELECT *, CASE WHEN count(spread) OVER w = 120 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS z
      FROM spr WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)), {_NAIVE} SELECT a, b, i, {rnd('shown', 'position')} FROM m WHERE q > 0""",
    "rolling_hurst": f"WITH {_HURST} SELECT symbol, bar, {rnd('hurst')} FROM rh",
}

_LEGS = ORACLE["legs"][: ORACLE["legs"].rindex("SELECT")]
ORACLE |= {
    "trade_summary": f"""WITH RECURSIVE {WALK} SELECT a, b, count(*) AS n, {rnd('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {rnd('avg(exit - entry)', 'avg_hold')}, {rnd('max(pnl)', 'best')}, {rnd('min(pnl)', 'worst')}
      FROM lg GROUP BY a, b""",
    "trade_numbers": f"WITH RECURSIVE {WALK} SELECT row_number() OVER (ORDER BY entry_ts, exit_ts, a, b) AS number, a, b, entry, exit, direction FROM lg",
    "pair_activity": f"""WITH RECURSIVE {WALK}, t AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY a, b ORDER BY i), 0.0)) AS turn FROM book)
      SELECT a, b, {rnd('avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END)', 'disqualified')}, {rnd('avg(CASE WHEN position = 0 THEN 1.0 ELSE 0.0 END)', 'idle')}, {rnd('sum(turn) * 6048.0 / count(*)', 'turnover_year')} FROM t GROUP BY a, b""",
    "capital_report": f"""WITH RECURSIVE {WALK}, u AS (SELECT a, b, 1000.0 / nullif(median(sigma), 0) AS unit, sum(coalesce(pnl, 0)) AS won FROM book GROUP BY a, b)
      SELECT a, b, {rnd('unit')}, {rnd('100000.0 + won * unit', 'final')}, {rnd('((100000.0 + won * unit) / 100000.0 - 1) * 100', 'total_return_pct')} FROM u""",
    "ticker_trades": f"""{_LEGS} SELECT symbol, count(*) AS legs, count(*) FILTER (side = 'buy') AS longs, count(*) FILTER (side = 'sell') AS shorts, {rnd('avg(amount)', 'mean_amount')},
      {rnd("avg(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (p1 / p0 - 1) * 100)", 'mean_move')}, {rnd("sum(amount * CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (p1 / p0 - 1))", 'won')}
      FROM l GROUP BY symbol ORDER BY legs DESC, symbol LIMIT 8""",
    "universe": "SELECT event_type AS symbol FROM events WHERE value > 0 UNION SELECT o_orderpriority FROM orders",
}


def _cell(x: int, t: int) -> str:
    """A cell of the grid over all phases."""
    mean = "SELECT bar, avg(pnl) AS pnl FROM pnl, prm WHERE bar >= start + 24 GROUP BY bar"
    return f"SELECT * FROM (WITH {rotation(lookback=x, top=t, phases=24)}, mean_pnl AS ({mean}), {stat('mean_pnl', '')} SELECT CAST({x} AS BIGINT) AS lookback, CAST({t} AS BIGINT) AS top, {rnd('ann_return')}, {rnd('sharpe')} FROM perf)"


ORACLE["lookback_top_grid"] = " UNION ALL ".join(_cell(x, t) for x in (10, 15, 20, 30, 40) for t in (1, 2, 3))
ORACLE["grid_stability"] = f"SELECT count(*) AS cells, {rnd('median(sharpe)', 'median')}, {rnd('min(sharpe)', 'worst')}, min(sharpe) < 0 AS fragile FROM ({ORACLE['lookback_top_grid']})"

#: Bars that wander: running sums of the deviations of the hours at which every symbol has a bar.
WALKS = BARS.replace("bars AS", "raw AS", 1) + """, w0 AS (
  SELECT r.*, 0.05 * (ln(close) - avg(ln(close)) OVER (PARTITION BY symbol)) AS x FROM raw r
  WHERE ts IN (SELECT ts FROM raw GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM raw))), w1 AS (
  SELECT symbol, ts, volume, exp(sum(x) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS close FROM w0), w2 AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM w1), bars AS (
  SELECT symbol, ts, open, greatest(open, close) AS high, least(open, close) AS low, close, volume FROM w2)"""


def _dmi_of(w: int) -> str:
    """The directional indices of one window on the dense grid, as pd<w>; needs dm."""
    means = ", ".join(ewm(f"{a}{w}", "dm", x, 1 / w, "bar") for a, x in (("atr", "tr"), ("sp", "pdm"), ("sm", "mdm")))
    return f"""{means}, di{w} AS (
  SELECT d.symbol, d.bar, 100 * p.y / nullif(a.y, 0) AS plus_di, 100 * m.y / nullif(a.y, 0) AS minus_di
  FROM dm d JOIN atr{w} a USING (symbol, bar) JOIN sp{w} p USING (symbol, bar) JOIN sm{w} m USING (symbol, bar)),
  {DX.replace("dx AS (", f"dx{w} AS (", 1).replace("FROM di", f"FROM di{w}")}, {ewm(f"ax{w}", f"dx{w}", "dx", 1 / w, "bar")}, pd{w} AS (
  SELECT d.symbol, d.bar, d.plus_di AS plus_di_{w}, d.minus_di AS minus_di_{w}, a.y AS adx_{w} FROM dx{w} d JOIN ax{w} a USING (symbol, bar))"""


def _hurst_of(w: int) -> str:
    body = f"""an AS (SELECT bar AS t FROM cal WHERE bar >= {w - 1} AND (bar - {w - 1}) % 9 = 0), wn AS (
      SELECT g.symbol, a.t, g.bar AS i, ln(g.close) AS x, count(g.close) OVER (PARTITION BY g.symbol, a.t) AS known FROM an a JOIN grid g ON g.bar > a.t - {w} AND g.bar <= a.t), wf AS (
      SELECT * FROM wn WHERE known = {w}), {hurst('wf', ['symbol', 't'], 'x')}"""
    return f"""rh{w} AS (SELECT g.symbol, g.bar, last_value(h.h IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.bar) AS hurst_{w}
      FROM grid g LEFT JOIN (WITH {body} SELECT * FROM hu) h ON h.symbol = g.symbol AND h.t = g.bar)"""


def _rule(v: str, d: int, w: int) -> tuple[str, str, str | None]:
    """Mask, score and what a threshold is held against."""
    yes, up, risk = "ok AND roc IS NOT NULL", f"plus_di_{d} > minus_di_{d}", "CASE WHEN vol > 0 THEN roc / vol END"
    return {
        "baseline": (yes, "roc", None), "di_gate": (up, "roc", None), "ma_and_di": (f"{yes} AND {up}", "roc", None), "ma_and_adx": (yes, "roc", f"adx_{d}"),
        "ma_di_adx": (f"{yes} AND {up}", "roc", f"adx_{d}"), "rank_by_di": (f"{yes} AND {up}", f"plus_di_{d} - minus_di_{d}", None),
        "rank_by_adx_weighted": (yes, f"roc * adx_{d} / 100", f"adx_{d}"), "risk_adjusted": (yes, risk, None), "ma_and_hurst": (yes, "roc", f"hurst_{w}"),
        "hurst_and_di": (up, "roc", f"hurst_{w}"), "risk_adjusted_di": (f"{yes} AND {up}", risk, None),
    }[v]


def _settings() -> list[tuple]:
    """variant, DMI window, Hurst window, threshold, in the grid, in the neighbourhood, own setting; written out rule by rule."""
    out = [(v, None, None, None, False, True, True) for v in ("baseline", "risk_adjusted")]
    out += [(v, d, None, None, True, True, d == 45) for v in ("di_gate", "ma_and_di", "rank_by_di", "risk_adjusted_di") for d in (14, 45, 126)]
    out += [(v, d, None, x, True, x >= 15, (d, x) == (45, 20)) for v in ("ma_and_adx", "ma_di_adx", "rank_by_adx_weighted") for d in (14, 45, 126) for x in (10, 15, 20, 25, 30)]
    out += [(v, 45, w, x, True, w == 250, (w, x) == (250, 0.5)) for v in ("ma_and_hurst", "hurst_and_di") for w in (150, 250, 400) for x in (0.45, 0.5, 0.55, 0.6)]
    return out + [("hurst_and_di", d, 250, x, False, True, False) for d in (14, 126) for x in (0.45, 0.5, 0.55, 0.6)]


def _rule_cells() -> str:
    cands = []
    for k, (v, d, w, x, *_) in enumerate(_settings()):
        mask, score, gate = _rule(v, d or 45, w or 250)
        cands.append(f"SELECT {k} AS cell, symbol, bar + 1 AS t0, {score} AS score FROM ft WHERE {mask}" + (f" AND {gate} >= {x}" if gate else ""))
    null = lambda x, kind: f"CAST({'NULL' if x is None else x} AS {kind})"
    names = ", ".join(f"({k}, '{v}', {null(d, 'BIGINT')}, {null(w, 'BIGINT')}, {null(x, 'DOUBLE')}, {g}, {m}, {o})" for k, (v, d, w, x, g, m, o) in enumerate(_settings()))
    moves = _PANEL_DMI[: _PANEL_DMI.index(ewm("atr", "dm", "tr", 1 / 14, "bar"))].rstrip(" ,\n")
    return f"""WITH RECURSIVE {PANEL.replace(BARS, WALKS)}, {moves}, {", ".join(_dmi_of(w) for w in (14, 45, 126))}, {", ".join(_hurst_of(w) for w in (150, 250, 400))}, sig AS (
  SELECT symbol, bar, close, ln(close) - lag(ln(close)) OVER w AS ret, close / lag(close, 20) OVER w - 1 AS roc, coalesce(({mean("close", 10)}) > ({mean("close", 30)}), FALSE) AS ok FROM grid {W}), {RV}, ft AS MATERIALIZED (
  SELECT s.*, v.rv AS vol, {", ".join(f"plus_di_{w}, minus_di_{w}, adx_{w}" for w in (14, 45, 126))}, {", ".join(f"hurst_{w}" for w in (150, 250, 400))}
  FROM sig s JOIN rv v USING (symbol, bar) {" ".join(f"JOIN pd{w} USING (symbol, bar)" for w in (14, 45, 126))} {" ".join(f"JOIN rh{w} USING (symbol, bar)" for w in (150, 250, 400))}), prm AS (
  SELECT (SELECT min(bar) FROM cal WHERE sess = floor((SELECT max(sess) + 1 FROM cal) * 0.6)) AS start, (SELECT count(*) FROM cal) AS bars), cand AS ({" UNION ALL ".join(cands)}), dec AS (
  SELECT c.*, row_number() OVER (PARTITION BY cell, t0 ORDER BY score DESC, symbol) AS rank FROM cand c, prm WHERE score IS NOT NULL AND t0 >= start AND t0 < bars), held AS (
  SELECT cell, t0, symbol, 1.0 / count(*) OVER (PARTITION BY cell, t0) AS weight FROM dec WHERE rank <= 2), sums AS (
  SELECT h.cell, g.bar, sum(h.weight * coalesce(g.ret, 0)) / 24 AS pnl FROM held h JOIN sig g ON g.symbol = h.symbol AND g.bar >= h.t0 AND g.bar < h.t0 + 24 GROUP BY ALL), nm AS (
  SELECT * FROM (VALUES {names}) t(cell, variant, di_window, hurst_window, level, grid, near, own)), neutral AS (
  SELECT nm.cell, c.bar, coalesce(s.pnl, 0) AS pnl FROM nm CROSS JOIN cal c CROSS JOIN prm LEFT JOIN sums s ON s.cell = nm.cell AND s.bar = c.bar WHERE c.bar >= start + 24), {stat('neutral', 'cell')}, rc AS (
  SELECT * FROM nm JOIN perf USING (cell))"""


_CELLS = _rule_cells()
ORACLE |= {
    "parameter_grid_neutral": f"{_CELLS} SELECT variant, di_window, hurst_window, level, {rnd('ann_return')}, {rnd('sharpe')} FROM rc WHERE grid",
    "neighborhood_stability": f"{_CELLS} SELECT variant, count(sharpe) AS settings, {rnd('median(sharpe)', 'median')}, {rnd('min(sharpe)', 'worst')} FROM rc WHERE near GROUP BY variant",
    "variant_verdicts": f"""{_CELLS}, hold AS (SELECT avg(p) * 6048 / nullif(stddev_pop(p) * sqrt(6048), 0) AS hold FROM (SELECT bar, coalesce(avg(ret), 0) AS p FROM sig, prm WHERE bar >= start GROUP BY bar)), v AS (
      SELECT variant, max(CASE WHEN own THEN sharpe END) AS sharpe, median(CASE WHEN grid THEN sharpe END) AS median, min(CASE WHEN grid THEN sharpe END) AS worst FROM rc GROUP BY variant)
      SELECT variant, {rnd('sharpe')}, {rnd('hold')}, coalesce(sharpe > hold, FALSE) AS beats, {rnd('median')}, {rnd('worst')}, coalesce(worst < 0, FALSE) AS fragile FROM v, hold""",
}


ORACLE["momentum_hurst_variants"] = f"""{_CELLS} SELECT variant, t0, symbol, rank FROM dec JOIN nm USING (cell), prm
  WHERE rank <= 2 AND own AND hurst_window IS NOT NULL AND (t0 - start) % 24 = 0"""
_PERM = ORACLE["permutation_test"].replace("range(20)", "range(400)")
_AT = _PERM.rindex("SELECT sim,")
ORACLE["permutation_significance"] = f"""{_PERM[:_AT]}, tt AS ({_PERM[_AT:].replace(rnd('sum(weight * coalesce(g.ret, 0))', 'total'), 'sum(weight * coalesce(g.ret, 0)) AS total')}), rl AS (SELECT coalesce(sum(part), 0) AS real FROM parts)
  SELECT count(*) AS sims, {rnd('any_value(real)', 'real')}, {rnd('quantile_cont(total, 0.5)', 'p50')}, {rnd('avg(CASE WHEN total >= real - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END)', 'p_value')} FROM tt, rl"""
#: Starts from the lookback on to 400 bars before the end, some 45 bars apart.
ORACLE["start_date_sweep_full"] = f"""WITH {rotation()}, sp AS (SELECT bars, least(24, greatest(2, (bars - 425) // 45)) AS m FROM prm WHERE bars > 425), st AS (
  SELECT CAST(floor(25 + k * ((bars - 425) / CAST(m - 1 AS DOUBLE))) AS BIGINT) AS s FROM (SELECT *, unnest(range(m)) AS k FROM sp)), d2 AS (
  SELECT s, bar + 1 AS t0, symbol, row_number() OVER (PARTITION BY s, bar ORDER BY roc DESC, symbol) AS rank FROM sig, st, prm
  WHERE ok AND roc IS NOT NULL AND bar + 1 >= s AND (bar + 1 - s) % 24 = 0 AND bar + 1 < bars), h2 AS (
  SELECT *, 1.0 / count(*) OVER (PARTITION BY s, t0) AS weight FROM d2 WHERE rank <= 2), x2 AS (
  SELECT h.s, g.bar, sum(h.weight * coalesce(g.ret, 0)) AS part FROM h2 h JOIN sig g ON g.symbol = h.symbol AND g.bar >= h.t0 AND g.bar < h.t0 + 24 GROUP BY ALL), p2 AS (
  SELECT st.s, c.bar, coalesce(x.part, 0) AS pnl FROM st CROSS JOIN cal c LEFT JOIN x2 x ON x.s = st.s AND x.bar = c.bar WHERE c.bar >= st.s), {stat('p2', 's')}
  SELECT s AS start, n, {rnd('ann_return')}, {rnd('sharpe')} FROM perf"""


def _summary() -> str:
    """Every rule at one setting over all phases, profits and turnover blended, against holding all names."""
    cands = []
    for v in ("baseline", "di_gate", "ma_and_di", "ma_and_adx", "ma_di_adx", "rank_by_di", "rank_by_adx_weighted", "risk_adjusted", "risk_adjusted_di", "ma_and_hurst", "hurst_and_di"):
        mask, score, gate = _rule(v, 14, 120)
        cands.append(f"SELECT '{v}' AS variant, symbol, bar + 1 AS t0, {score} AS score FROM ft WHERE {mask}" + (f" AND {gate} >= {0.5 if 'hurst' in v else 20}" if gate else ""))
    moves = _PANEL_DMI[: _PANEL_DMI.index(ewm("atr", "dm", "tr", 1 / 14, "bar"))].rstrip(" ,\n")
    return f"""WITH RECURSIVE {PANEL}, {moves}, {_dmi_of(14)}, {_hurst_of(120)}, sig AS (
  SELECT symbol, bar, close, ln(close) - lag(ln(close)) OVER w AS ret, close / lag(close, 20) OVER w - 1 AS roc, coalesce(({mean("close", 10)}) > ({mean("close", 30)}), FALSE) AS ok FROM grid {W}), {RV}, ft AS MATERIALIZED (
  SELECT s.*, v.rv AS vol, plus_di_14, minus_di_14, adx_14, hurst_120 FROM sig s JOIN rv v USING (symbol, bar) JOIN pd14 USING (symbol, bar) JOIN rh120 USING (symbol, bar) WHERE s.close IS NOT NULL), prm AS (
  SELECT (SELECT min(bar) FROM cal WHERE sess = floor((SELECT max(sess) + 1 FROM cal) * 0.6)) AS start, (SELECT count(*) FROM cal) AS bars), cand AS ({" UNION ALL ".join(cands)}), dec AS (
  SELECT c.*, row_number() OVER (PARTITION BY variant, t0 ORDER BY score DESC, symbol) AS rank FROM cand c, prm WHERE score IS NOT NULL AND t0 >= start AND t0 < bars), held AS (
  SELECT variant, t0, symbol, 1.0 / count(*) OVER (PARTITION BY variant, t0) AS weight FROM dec WHERE rank <= 2), sums AS (
  SELECT h.variant, g.bar, sum(h.weight * coalesce(g.ret, 0)) / 24 AS pnl, count(*) / 24 AS n FROM held h JOIN sig g ON g.symbol = h.symbol AND g.bar >= h.t0 AND g.bar < h.t0 + 24 GROUP BY ALL), ev AS (
  SELECT variant, t0 AS bar FROM held h WHERE NOT EXISTS (SELECT 1 FROM held q WHERE q.variant = h.variant AND q.symbol = h.symbol AND q.t0 = h.t0 - 24)
  UNION ALL
  SELECT variant, t0 + 24 FROM held h, prm WHERE t0 + 24 < bars AND NOT EXISTS (SELECT 1 FROM held q WHERE q.variant = h.variant AND q.symbol = h.symbol AND q.t0 = h.t0 + 24)), tn AS (
  SELECT variant, bar, count(*) / 2.0 / 24 AS turnover FROM ev GROUP BY ALL), vs AS (SELECT DISTINCT variant FROM (VALUES {", ".join(f"('{c.split("'")[1]}')" for c in cands)}) t(variant)), mn AS (
  SELECT vs.variant, coalesce(s.pnl, 0) AS pnl, coalesce(s.pnl, 0) - coalesce(t.turnover, 0) * 5e-4 AS net, coalesce(s.n, 0) AS held
  FROM vs CROSS JOIN cal c CROSS JOIN prm LEFT JOIN sums s ON s.variant = vs.variant AND s.bar = c.bar LEFT JOIN tn t ON t.variant = vs.variant AND t.bar = c.bar WHERE c.bar >= start + 24
  UNION ALL
  SELECT 'buy_and_hold', p, p, (SELECT count(DISTINCT symbol) FROM bars) FROM (SELECT bar, coalesce(avg(ret), 0) AS p FROM sig, prm WHERE bar >= start AND close IS NOT NULL GROUP BY bar))
  SELECT variant, {rnd('avg(pnl) * 6048', 'ann_return')}, {rnd('avg(pnl) * 6048 / nullif(stddev_pop(pnl) * sqrt(6048), 0)', 'sharpe')}, {rnd('avg(net) * 6048', 'net_return')}, {rnd('avg(held)', 'held')},
    {rnd('avg(CASE WHEN held = 0 THEN 1.0::DOUBLE ELSE 0.0 END)', 'idle')} FROM mn GROUP BY variant"""


ORACLE["variant_summary"] = _summary()


def _md5_draws(source: str, keys: str, values: list[str], boots: int, at: str = "bar") -> str:
    """Draws of every key by joining every row of every block; starts from the md5 of key, draw and block."""
    sums = ", ".join(f"sum({v}) AS s_{v}, sum({v} * {v}) AS q_{v}, count({v}) AS c_{v}" for v in values)
    name = " || '|' || ".join([*keys.split(", "), "boot", "k"])
    on = " AND ".join(f"bs.{k} = bk.{k}" for k in keys.split(", "))
    own = ", ".join(f"bk.{k}" for k in keys.split(", "))
    return f"""bs AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {at}) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}), bz AS (SELECT DISTINCT {keys}, n, least(24, n) AS len FROM bs), bx AS (
  SELECT *, unnest(range(CAST(ceil(n / len) AS BIGINT))) AS k FROM bz), bk AS (
  SELECT *, CAST('0x' || md5({name})[1:8] AS BIGINT) % (n - len + 1) AS r0, least(len, n - k * len) AS size FROM bx, (SELECT unnest(range({boots})) AS boot)), dr AS (
  SELECT {own}, boot, {sums} FROM bk JOIN bs ON {on} AND bs.r >= r0 AND bs.r < r0 + size GROUP BY {own}, boot)"""


_ONE = f"WITH {rotation()}, bo AS (SELECT *, 'rotation' AS book FROM pnl), {_md5_draws('bo', 'book', ['pnl'], 2000)}"
_TWO_BOOKS = f"""WITH {rotation()}, bh AS (SELECT bar, coalesce(avg(ret), 0) AS hold FROM sig, prm WHERE bar >= start AND close IS NOT NULL GROUP BY bar), bo AS (
  SELECT bar, pnl, hold, 'rotation' AS book FROM pnl JOIN bh USING (bar)), {_md5_draws('bo', 'book', ['pnl', 'hold'], 5000)}, df2 AS (
  SELECT boot, {boot_sharpe('pnl')} - {boot_sharpe('hold')} AS diff, q_pnl / c_pnl - (s_pnl / c_pnl) ** 2 < q_hold / c_hold - (s_hold / c_hold) ** 2 AS lower FROM dr)"""
_QUANTILES = f"""{rnd('quantile_cont(sharpe, 0.05)', 'p05')}, {rnd('quantile_cont(sharpe, 0.5)', 'p50')}, {rnd('quantile_cont(sharpe, 0.95)', 'p95')},
  {rnd('avg(CASE WHEN sharpe > 0 THEN 1.0::DOUBLE ELSE 0.0 END)', 'p_positive')}, count(*) FILTER (sharpe IS NULL) AS degenerate"""
ORACLE |= {
    "block_bootstrap_full": f"{_ONE} SELECT boot, {rnd(boot_sharpe('pnl'), 'sharpe')} FROM dr",
    "bootstrap_significance_full": f"{_ONE}, s AS (SELECT {boot_sharpe('pnl')} AS sharpe FROM dr) SELECT {_QUANTILES} FROM s",
    "pair_significance": f"{SPREAD_BOOK}, {_md5_draws('book', 'a, b', ['pnl'], 2000, 'i')}, s AS (SELECT a, b, {boot_sharpe('pnl')} AS sharpe FROM dr) SELECT a, b, {_QUANTILES} FROM s GROUP BY a, b",
    "paired_bootstrap_full": f"{_TWO_BOOKS} SELECT boot, {rnd('diff')} FROM df2",
    "paired_significance": f"""{_TWO_BOOKS} SELECT {rnd('quantile_cont(diff, 0.05)', 'lo')}, {rnd('quantile_cont(diff, 0.5)', 'mid')}, {rnd('quantile_cont(diff, 0.95)', 'hi')}, {rnd('avg(CASE WHEN diff > 0 THEN 1.0::DOUBLE ELSE 0.0 END)', 'p_better')},
      {rnd('avg(CASE WHEN lower THEN 1.0::DOUBLE ELSE 0.0 END)', 'p_vol_lower')} FROM df2""",
}

ORACLE["ou_moments"] = f"""WITH {spreads()}, {df('spr', 'a, b', 'spread')}, sm AS (SELECT a, b, avg(spread) AS mean, var_pop(spread) AS var FROM spr GROUP BY a, b)
  SELECT a, b, {rnd('mean')}, {rnd('var')}, {rnd('CASE WHEN gamma < 0 THEN sigma * sigma / (-2 * gamma) END', 'theory')}, {rnd('hl', 'half_life')} FROM sm JOIN adf USING (a, b)"""
ORACLE["naive_in_sample_z"] = ORACLE["naive_static_z"].replace(spreads(), f"""{pairs()}, sl AS (SELECT a, b, floor((max(sess) + 1) * 0.6) AS split FROM prs GROUP BY a, b), fit AS (
  SELECT a, b, regr_intercept(la, lb) AS alpha, regr_slope(la, lb) AS beta FROM prs JOIN sl USING (a, b) WHERE sess < split GROUP BY a, b), spr AS (
  SELECT p.*, f.alpha, f.beta, p.la - f.beta * p.lb - f.alpha AS spread FROM prs p JOIN fit f USING (a, b))""")

ORACLE["pair_screen_tiles"] = ORACLE["pair_screen_full"]
ORACLE |= {f"{name}_scan": ORACLE[same] for name, same in (("macd", "macd"), ("rsi", "rsi"), ("dmi", "dmi_panel"), ("state_machine", "state_machine_spread"))}
