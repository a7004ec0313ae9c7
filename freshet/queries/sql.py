"""SQL building blocks of the oracles, as common table expressions over the sample tables."""

from __future__ import annotations

IA = "(0.2::DOUBLE * (25400.0::DOUBLE / 81.1::DOUBLE - 254.0::DOUBLE))"
S = "(25400.0::DOUBLE / 81.1::DOUBLE - 254.0::DOUBLE)"


def runoff(p: str, ia: str = IA, s: str = S) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= {ia} THEN 0.0::DOUBLE "
        f"ELSE (({p}) - {ia}) * (({p}) - {ia}) / ((({p}) - {ia}) + {s}) END"
    )


HOUR = "(epoch_us({}) // 3600000000)"


def hour(ts: str) -> str:
    return HOUR.format(ts)


def stamp(hour_idx: str) -> str:
    return f"(TIMESTAMP '1970-01-01 00:00:00' + to_hours(CAST({hour_idx} AS INTEGER)))"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def _features(source: str, horizons: tuple[int, ...]) -> str:
    w = "OVER (PARTITION BY b.basin ORDER BY b.hour_idx RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
    cols, joins = [], []
    for h in (1, 3, 6, 12, 24):
        joins.append(f"LEFT JOIN {source} p{h} ON p{h}.basin = b.basin AND p{h}.hour_idx = b.hour_idx - {h}")
        cols.append(f"p{h}.P_basin AS lag_{h}h")
        if h <= 6:
            cols.append(f"p{h}.Q_scs_proxy AS Q_lag_{h}h")
    for h in (3, 6, 12, 24, 48):
        cols.append(f"sum(b.P_basin) {w.format(h - 1)} AS roll_sum_{h}h")
    cols.append(f"max(b.P_basin) {w.format(5)} AS roll_max_6h")
    for h in horizons:
        joins.append(f"LEFT JOIN {source} f{h} ON f{h}.basin = b.basin AND f{h}.hour_idx = b.hour_idx + {h}")
        cols.append(f"f{h}.Q_scs_proxy AS target_{h}h")
    return (
        "SELECT b.basin, b.hour_idx, b.timestamp, b.P_basin, b.Q_scs_proxy AS Q_actual, "
        + ", ".join(cols)
        + ", CAST(b.hour_idx % 24 AS INTEGER) AS hora_dia, CAST(month(b.timestamp) AS INTEGER) AS mes "
        + f"FROM {source} b "
        + " ".join(joins)
    )


FEATURES = [
    "P_basin", "Q_actual", "lag_1h", "lag_3h", "lag_6h", "lag_12h", "lag_24h",
    "Q_lag_1h", "Q_lag_3h", "Q_lag_6h", "roll_sum_3h", "roll_sum_6h", "roll_sum_12h",
    "roll_sum_24h", "roll_sum_48h", "roll_max_6h", "hora_dia", "mes",
]
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


def split(source: str, where: str = "TRUE") -> str:
    return f"""
      SELECT * EXCLUDE (rn, n), CASE WHEN rn <= (CASE WHEN n > 1 THEN
          greatest(1, least(CAST(floor(n * 0.82::DOUBLE) AS BIGINT), n - 1)) ELSE 1 END)
        THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY hour_idx) AS rn,
                   count(*) OVER (PARTITION BY basin) AS n FROM {source} WHERE {where})"""


def _series(prefix: str, readings: str) -> dict[str, tuple[list[str], str]]:
    """Station hours, basin hours and runoff series of one readings CTE."""
    n = "n_estaciones_disponibles"
    return {
        f"{prefix}station_hours": ([readings], f"""
            SELECT basin, station_id, {hour('ts')} AS hour_idx, sum(tips) * 1.5::DOUBLE AS mm
            FROM (SELECT DISTINCT * FROM {readings}) GROUP BY ALL"""),
        f"{prefix}basin_hours": ([f"{prefix}station_hours"], f"""
            SELECT basin, hour_idx, avg(mm) AS P_basin, CAST(count(mm) AS INTEGER) AS {n}
            FROM {prefix}station_hours GROUP BY ALL"""),
        f"{prefix}grid": ([f"{prefix}basin_hours"], f"""
            SELECT basin, unnest(generate_series(min(hour_idx), max(hour_idx))) AS hour_idx
            FROM {prefix}basin_hours GROUP BY basin"""),
        f"{prefix}acc": ([f"{prefix}grid", f"{prefix}basin_hours"], f"""
            SELECT basin, hour_idx, P_basin, coalesce({n}, 0) AS {n},
              CASE WHEN count(P_basin) OVER w >= 12 THEN sum(P_basin) OVER w END AS P_acc_24h
            FROM {prefix}grid LEFT JOIN {prefix}basin_hours USING (basin, hour_idx)
            WINDOW w AS (PARTITION BY basin ORDER BY hour_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""),
        f"{prefix}proxy": ([f"{prefix}acc"], f"""
            SELECT *, {runoff('P_acc_24h')} AS Q_scs_proxy, {stamp('hour_idx')} AS timestamp
            FROM {prefix}acc"""),
        f"{prefix}quality": ([f"{prefix}proxy"], f"SELECT * FROM {prefix}proxy WHERE {n} >= 2"),
        f"{prefix}features": ([f"{prefix}quality"], _features(f"{prefix}quality", (6, 12, 24))),
        f"{prefix}complete": ([f"{prefix}features"], f"SELECT * FROM {prefix}features WHERE {COMPLETE}"),
        **{
            f"{prefix}ds{h}": (
                [f"{prefix}complete"], split(f"{prefix}complete", f"target_{h}h IS NOT NULL")
            )
            for h in (6, 12, 24)
        },
    }


DRY = "CASE WHEN roll_sum_24h <= 0 THEN least(proba_modelo, 0.0066::DOUBLE) ELSE proba_modelo END"
STATE = "CASE WHEN {0} >= 0.7 THEN 'ALERTA' WHEN {0} >= 0.3 THEN 'PRECAUCIÓN' ELSE 'NORMAL' END"
LEVEL = "CASE estado WHEN 'ALERTA' THEN 2 WHEN 'PRECAUCIÓN' THEN 1 ELSE 0 END"
LOGIT = (
    "1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.2::DOUBLE + 0.1::DOUBLE * roll_sum_24h + 0.35::DOUBLE * Q_actual"
    " + 0.15::DOUBLE * P_basin + CASE WHEN hora_dia % 12 = 3 THEN 1.8::DOUBLE ELSE 0.0::DOUBLE END)))"
)

CTES: dict[str, tuple[list[str], str]] = {
    "all_readings": ([], """
        SELECT 'B' || CAST(user_id // 75 AS VARCHAR) AS basin, 'S' || CAST(user_id % 3 AS VARCHAR) AS station_id,
          CASE WHEN event_type = 'error' THEN '257' ELSE '240' END AS sensor_id, ts,
          CASE WHEN day(ts) % 6 IN (1, 2, 3) THEN CAST(floor(greatest(value - 75, 0) / 25) AS INTEGER)
            * CASE WHEN day(ts) >= 22 THEN 2 ELSE 1 END ELSE 0 END AS tips
        FROM events
        WHERE NOT (user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-14')
          AND NOT (user_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-29')"""),
    "readings": (["all_readings"], "SELECT * FROM all_readings WHERE sensor_id = '240'"),
    "long_readings": ([], """
        SELECT 'L0' AS basin, 'S' || CAST(l_suppkey % 3 AS VARCHAR) AS station_id, '240' AS sensor_id,
          CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts,
          CAST(CASE WHEN l_partkey % 10 < 2 THEN l_linenumber ELSE 0 END AS INTEGER) AS tips
        FROM lineitem
        WHERE NOT (l_suppkey % 3 = 1 AND CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) >= TIMESTAMP '1997-03-05'
               AND CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) < TIMESTAMP '1997-09-20')
          AND NOT (l_suppkey % 3 = 0 AND CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) >= TIMESTAMP '2000-07-01')"""),
    **_series("", "readings"),
    **_series("long_", "long_readings"),
    "raw_scored": (["complete"], f"SELECT *, {LOGIT} AS proba_modelo FROM complete"),
    "scored": (["raw_scored"], f"SELECT *, {DRY} AS proba_alerta FROM raw_scored"),
    "log": (["scored"], f"SELECT *, {STATE.format('proba_alerta')} AS estado FROM scored"),
    "log6": (["log", "ds6"], """
        SELECT log.*, ds6.split FROM log JOIN ds6 USING (basin, hour_idx)"""),
    "p90": (["ds6"], """
        SELECT basin, quantile_cont(target_6h, 0.9) FILTER (split = 'train') AS p90,
          quantile_cont(target_6h, 0.75) FILTER (split = 'train') AS p75 FROM ds6 GROUP BY basin"""),
    "labelled": (["log6", "p90"], """
        SELECT log6.*, p90, p75, CAST(target_6h > p90 AS INTEGER) AS label FROM log6 JOIN p90 USING (basin)"""),
    "held_out": (["labelled"], "SELECT * FROM labelled WHERE split = 'test'"),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` preceded by the named CTEs, what they need, and ``extra`` ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
