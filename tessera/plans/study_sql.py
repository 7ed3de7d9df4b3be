"""DuckDB SQL of the walk-forward study: ridge regression by its normal equations, solved by elimination step for step."""

from __future__ import annotations

ALPHA, FEATURES = 10.0, ("a", "b", "c", "e2")
N = range(1, len(FEATURES) + 1)

FRAME_SQL = """own AS (SELECT o_custkey AS ticker, year(o_orderdate)::INTEGER AS y, avg(o_totalprice) AS a, count(*)::DOUBLE AS b, max(o_totalprice) AS c,
    CASE WHEN count(*) > 2 THEN stddev_samp(o_totalprice) END AS e FROM orders GROUP BY ALL),
fr AS (SELECT *, a / 1e6 + ('0x' || substr(md5('3:' || ticker::VARCHAR || ':' || y::VARCHAR), 1, 8))::BIGINT / 4294967296.0 - 0.5 AS t FROM own),
sizes AS (SELECT y, count(*) AS n FROM fr GROUP BY y),
folds AS (SELECT * FROM (SELECT y AS fold, n AS n_test, sum(n) OVER (ORDER BY y) - n AS n_train FROM sizes) WHERE n_train >= 40 AND n_test >= 5),
med AS (SELECT fold, median(e) AS me FROM fr JOIN folds ON y < fold GROUP BY fold),
filled AS (SELECT fold, n_train, n_test, ticker, y, a, b, c, coalesce(e, me) AS e2, t, y < fold AS train FROM fr JOIN folds ON y <= fold JOIN med USING (fold)),
"""
_STATS = ", ".join(f"avg({f}) FILTER (train) AS m{k}, stddev_samp({f}) FILTER (train) AS d{k}" for k, f in zip(N, FEATURES))
_Z = ", ".join(f"({f} - m{k}) / d{k} AS z{k}" for k, f in zip(N, FEATURES))
_GRAM = ", ".join(f"sum(z{i} * z{j}){f' + {ALPHA}' if i == j else ''} AS g{i}{j}" for i in N for j in N)


def _elimination(source: str, key: str) -> str:
    """Steps from `source` (key, g11.. and r1..) to `solved` (key, w1..)."""
    steps, now = [], source
    for k in N:
        columns = []
        for i in N:
            for j in N:
                columns.append(f"g{i}{j}" if i == k else f"g{i}{j} - g{i}{k} * g{k}{j} / g{k}{k} AS g{i}{j}")
            columns.append(f"r{i}" if i == k else f"r{i} - g{i}{k} * r{k} / g{k}{k} AS r{i}")
        steps.append(f"step{k} AS (SELECT {key}, {', '.join(columns)} FROM {now})")
        now = f"step{k}"
    return ",\n".join(steps) + f",\nsolved AS (SELECT {key}, {', '.join(f'r{k} / g{k}{k} AS w{k}' for k in N)} FROM {now})"


_PREDICTED = " + ".join(f"w{k} * z{k}" for k in N)
_BASE = f"""st AS (SELECT fold, avg(t) FILTER (train) AS base, {_STATS} FROM filled GROUP BY fold),
zs AS (SELECT fold, n_train, n_test, ticker, y, t, train, base, {_Z} FROM filled JOIN st USING (fold)),
gram AS (SELECT fold, {_GRAM} FROM zs WHERE train GROUP BY fold),
"""

RIDGE_SQL = f"""{_BASE}rhs AS (SELECT fold, {', '.join(f'sum(z{k} * (t - base)) AS r{k}' for k in N)} FROM zs WHERE train GROUP BY fold),
eq AS (SELECT * FROM gram JOIN rhs USING (fold)),
{_elimination('eq', 'fold')},
pred AS (SELECT zs.*, w1, w4, base + {_PREDICTED} AS p FROM zs JOIN solved USING (fold) WHERE NOT train),
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY fold ORDER BY t) + (count(*) OVER (PARTITION BY fold, t) - 1) / 2.0 AS rt FROM pred),
ridge AS (SELECT fold, any_value(n_train)::INTEGER AS n_train, any_value(n_test)::INTEGER AS n_test, corr(rp, rt) AS ic,
    (sum(rp) FILTER (t > 0) - count(*) FILTER (t > 0) * (count(*) FILTER (t > 0) + 1) / 2.0) / nullif(count(*) FILTER (t > 0) * count(*) FILTER (t <= 0), 0) AS auc,
    sqrt(avg((p - t) ** 2)) AS rmse, sqrt(avg((base - t) ** 2)) AS baseline_rmse, any_value(w1) AS w1, any_value(w4) AS w4 FROM rk GROUP BY fold)"""

PERMUTATION_SQL = f"""{_BASE}placed AS (SELECT ticker, y, t, row_number() OVER (PARTITION BY y ORDER BY ticker) AS place, rank() OVER (PARTITION BY y ORDER BY t) + (count(*) OVER (PARTITION BY y, t) - 1) / 2.0 AS rt FROM fr),
drawn AS (SELECT b, ticker, y, row_number() OVER (PARTITION BY b, y ORDER BY CASE WHEN b > 0 THEN md5('7:' || b::VARCHAR || ':' || y::VARCHAR || ':' || place::VARCHAR) ELSE '' END, place) AS place FROM placed, range(201) r(b)),
given AS (SELECT b, d.ticker, y, p.t AS tb, p.rt FROM drawn d JOIN placed p USING (y, place)),
rhs AS (SELECT b, fold, {', '.join(f'sum(z{k} * (tb - base)) AS r{k}' for k in N)} FROM zs JOIN given USING (ticker, y) WHERE train GROUP BY b, fold),
eq AS (SELECT * FROM rhs JOIN gram USING (fold)),
{_elimination('eq', 'b, fold')},
pred AS (SELECT b, fold, rt, {_PREDICTED} AS p FROM zs JOIN given USING (ticker, y) JOIN solved USING (b, fold) WHERE NOT train),
rk AS (SELECT *, rank() OVER (PARTITION BY b, fold ORDER BY p) + (count(*) OVER (PARTITION BY b, fold, p) - 1) / 2.0 AS rp FROM pred),
ics AS (SELECT b, avg(ic) AS ic FROM (SELECT b, fold, corr(rp, rt) AS ic FROM rk GROUP BY ALL) GROUP BY b),
o AS (SELECT ic AS observed FROM ics WHERE b = 0)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (abs(ic) >= abs(observed)) + 1) / (count(*) + 1), 6) AS p, round(avg(ic), 6) AS null_mean,
    round(stddev_pop(ic), 6) AS null_std, round(list_sort(list(ic))[floor(count(*) * 0.95)::BIGINT + 1], 6) AS null_p95, count(*)::INTEGER AS n FROM ics, o WHERE b > 0"""
