"""Scenario queries. A scenario per basin and day comes from the day's own rain."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet import schema as S
from freshet.operators import features as feats
from freshet.operators.series import quality_split
from freshet.plans import scenarios as sc
from freshet.queries import query
from freshet.queries.base import r6, score, series
from freshet.queries.sql import DRY, FEATURES, LOGIT, STATE, r, runoff, with_ctes

# Daily extremes mix hours, so some scenarios are not monotone and must be adjusted.
SCEN_SQL = """SELECT basin, CAST(timestamp AS DATE) AS dia, max(P_basin) AS sim_p1, avg(roll_sum_3h) AS sim_r3,
    max(roll_sum_6h) AS sim_r6, avg(roll_sum_12h) AS sim_r12, max(roll_sum_24h) AS sim_r24, avg(roll_sum_48h) AS sim_r48
  FROM complete GROUP BY ALL"""
TOPS = {
    "adj": """SELECT *, greatest(sim_p1, sim_r3) AS a3, greatest(sim_p1, sim_r3, sim_r6) AS a6,
        greatest(sim_p1, sim_r3, sim_r6, sim_r12) AS a12, greatest(sim_p1, sim_r3, sim_r6, sim_r12, sim_r24) AS a24,
        greatest(sim_p1, sim_r3, sim_r6, sim_r12, sim_r24, sim_r48) AS a48 FROM scen""",
    "feat": f"""SELECT basin, dia, sim_p1, sim_r3, sim_r6, sim_r12, sim_r24, sim_r48,
        sim_r3 <> a3 OR sim_r6 <> a6 OR sim_r12 <> a12 OR sim_r24 <> a24 OR sim_r48 <> a48 AS ajustado,
        sim_p1 AS P_basin, {runoff('a24')} AS Q_actual, (a3 - sim_p1) / 2 AS lag_1h, (a6 - a3) / 3 AS lag_3h,
        (a12 - a6) / 6 AS lag_6h, (a24 - a12) / 12 AS lag_12h, (a48 - a24) / 24 AS lag_24h,
        {runoff('greatest(0.0::DOUBLE, a24 - sim_p1 + (a48 - a24) * 1 / 24)')} AS Q_lag_1h,
        {runoff('greatest(0.0::DOUBLE, a24 - a3 + (a48 - a24) * 3 / 24)')} AS Q_lag_3h,
        {runoff('greatest(0.0::DOUBLE, a24 - a6 + (a48 - a24) * 6 / 24)')} AS Q_lag_6h,
        a3 AS roll_sum_3h, a6 AS roll_sum_6h, a12 AS roll_sum_12h, a24 AS roll_sum_24h, a48 AS roll_sum_48h,
        greatest(sim_p1, (a3 - sim_p1) / 2, (a6 - a3) / 3) AS roll_max_6h FROM adj""",
}
COLS = ", ".join(f"{r(c)} AS {c}" for c in FEATURES if c not in ("hora_dia", "mes"))


def _scenarios(spark, sf_dir):
    rows = feats.complete(feats.feature_rows(quality_split(series(spark, sf_dir))[0]))
    return rows.groupBy("basin", F.col("timestamp").cast("date").alias("dia")).agg(
        F.max("P_basin").alias("sim_p1"), F.avg("roll_sum_3h").alias("sim_r3"),
        F.max("roll_sum_6h").alias("sim_r6"), F.avg("roll_sum_12h").alias("sim_r12"),
        F.max("roll_sum_24h").alias("sim_r24"), F.avg("roll_sum_48h").alias("sim_r48"),
    )


@query(
    "scenario_features", "H12",
    with_ctes(f"SELECT basin, dia, {COLS}, CAST(14 AS INTEGER) AS hora_dia, CAST(7 AS INTEGER) AS mes, ajustado FROM feat",
              "complete", scen=SCEN_SQL, **TOPS),
)
def scenario_features(spark, sf_dir):
    out = sc.scenario_features(_scenarios(spark, sf_dir), F.lit(14), F.lit(7))
    return r6(out.select("basin", "dia", *S.FEATURES, "ajustado"))


@query(
    "scenario_states_over_the_year", "C13 J8 H3 H4 H12",
    with_ctes(
        f"""SELECT basin, dia, estado, count(*) AS n, count(*) FILTER (raw_state <> estado) AS rule_changes,
              {r('max(proba_alerta)')} AS max_proba FROM states GROUP BY ALL""",
        "complete", scen=SCEN_SQL, **TOPS,
        year="""SELECT *, CAST(m AS INTEGER) AS mes, CAST(h AS INTEGER) AS hora_dia FROM feat
                CROSS JOIN range(1, 13) a(m) CROSS JOIN range(24) b(h)""",
        raw=f"SELECT *, {LOGIT} AS proba_modelo FROM year",
        adjusted=f"SELECT *, {DRY} AS proba_alerta FROM raw",
        states=f"SELECT *, {STATE.format('proba_alerta')} AS estado, {STATE.format('proba_modelo')} AS raw_state FROM adjusted",
    ),
)
def scenario_states_over_the_year(spark, sf_dir):
    year = sc.over_the_year(_scenarios(spark, sf_dir))
    features = sc.scenario_features(year, F.col("hora_dia"), F.col("mes"))
    states = sc.scored_scenarios(features, score)
    return r6(states.groupBy("basin", "dia", "estado").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("regla_cambia").alias("rule_changes"),
        F.max("proba_alerta").alias("max_proba"),
    ))
