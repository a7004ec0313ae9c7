"""Quality, feature, target and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet import schema as S
from freshet.operators import features as feats
from freshet.operators.series import quality_split
from freshet.plans import diagnostics, evaluation
from freshet.queries import query
from freshet.queries.base import KEYS, dataset, long_series, r6, series
from freshet.queries.sql import FEATURES, r, with_ctes
from freshet.session import shared_folder
from freshet.sources import gauges
from freshet.sources.tables import write_table

CUTOFF = "2024-01-28 23:00:00"
FEATURE_SQL = ", ".join(c if c in ("hora_dia", "mes") else f"{r(c)} AS {c}" for c in FEATURES)


@query(
    "low_quality_hours", "B9 A13",
    with_ctes("""SELECT basin, timestamp, n_estaciones_disponibles, round(P_basin, 6) AS P_basin
                 FROM proxy WHERE n_estaciones_disponibles < 2""", "proxy"),
)
def low_quality_hours(spark, sf_dir):
    rejected = quality_split(series(spark, sf_dir))[1]
    return r6(rejected.select("basin", "timestamp", "n_estaciones_disponibles", "P_basin"))


MONTHS_SQL = """
  SELECT basin, CAST(date_trunc('month', timestamp) AS DATE) AS month,
    count(*) FILTER (n_estaciones_disponibles = 0) AS n0, count(*) FILTER (n_estaciones_disponibles = 1) AS n1,
    count(*) FILTER (n_estaciones_disponibles = 2) AS n2, count(*) FILTER (n_estaciones_disponibles = 3) AS n3,
    count(*) AS total_mes FROM long_proxy GROUP BY ALL"""
SHARES_SQL = """SELECT *, round(n0 / total_mes, 6) AS pct_n0, round(n1 / total_mes, 6) AS pct_n1,
  round((n0 + n1) / total_mes, 6) AS pct_nlt2 FROM months"""


def _months(spark, sf_dir):
    return diagnostics.availability_by_month(long_series(spark, sf_dir), KEYS)


@query("monthly_availability", "D5 C8", with_ctes(SHARES_SQL, "long_proxy", months=MONTHS_SQL))
def monthly_availability(spark, sf_dir):
    return r6(_months(spark, sf_dir))


@query(
    "dominated_months", "D6",
    with_ctes(f"{SHARES_SQL} WHERE n0 / total_mes > 0.5 OR n1 / total_mes > 0.5", "long_proxy", months=MONTHS_SQL),
)
def dominated_months(spark, sf_dir):
    return r6(diagnostics.dominated_months(_months(spark, sf_dir)))


@query(
    "months_outside_known_outages", "C7",
    with_ctes(
        """SELECT basin, month, n0, n1, total_mes FROM months m WHERE n0 + n1 > 0 AND NOT EXISTS (
             SELECT 1 FROM outages o WHERE CAST(m.month AS TIMESTAMP) <= o.end_ts
               AND CAST(m.month AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND >= o.start_ts)""",
        "long_proxy", months=MONTHS_SQL,
        outages="""SELECT TIMESTAMP '1997-03-05' AS start_ts, TIMESTAMP '1997-09-20' AS end_ts
                   UNION ALL SELECT TIMESTAMP '2000-07-01', (SELECT max(timestamp) FROM long_proxy)""",
    ),
)
def months_outside_known_outages(spark, sf_dir):
    rows = [("L0", start, end) for _, start, end in gauges.LONG_OUTAGES]
    outages = spark.createDataFrame(rows, "basin string, start string, end string")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}
    found = diagnostics.unexplained_months(_months(spark, sf_dir), outages.withColumns(times), KEYS)
    return found.select("basin", "month", "n0", "n1", "total_mes")


@query(
    "months_outside_reported_outages", "C7",
    with_ctes(
        """SELECT basin, month, n0, n1, total_mes FROM months m WHERE n0 + n1 > 0 AND NOT EXISTS (
             SELECT 1 FROM orders o WHERE o_orderstatus = 'P' AND date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) <= m.month
               AND CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 40 AS INTEGER)) >= m.month)""",
        "long_proxy", months=MONTHS_SQL),
)
def months_outside_reported_outages(spark, sf_dir):
    """An outage table of many rows: each order in progress stands for one of up to 40 days from its date on."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    outages = orders.select(F.lit("L0").alias("basin"), start.alias("start"), (start + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int"))).alias("end"))
    found = diagnostics.unexplained_months(_months(spark, sf_dir), outages, KEYS)
    return found.select("basin", "month", "n0", "n1", "total_mes")


@query(
    "season_months_by_split", "D7",
    with_ctes(
        """SELECT basin, split, count(DISTINCT date_trunc('month', timestamp)) AS months,
             count(DISTINCT date_trunc('month', timestamp)) FILTER (month(timestamp) IN (4, 5, 10, 11)) AS rainy_months,
             count(DISTINCT date_trunc('month', timestamp)) FILTER (month(timestamp) NOT IN (4, 5, 10, 11)) AS dry_months,
             min(timestamp) AS first_ts, max(timestamp) AS last_ts
           FROM halves GROUP BY ALL""",
        "long_quality",
        halves="""SELECT basin, timestamp, CASE WHEN rn <= greatest(1, least(CAST(floor(n * 0.82::DOUBLE) AS BIGINT), n - 1))
                    THEN 'train' ELSE 'test' END AS split
                  FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY hour_idx) AS rn,
                          count(*) OVER (PARTITION BY basin) AS n FROM long_quality)""",
    ),
)
def season_months_by_split(spark, sf_dir):
    rows = feats.chronological_split(quality_split(long_series(spark, sf_dir))[0])
    return diagnostics.season_months(rows, ["basin", "split"])


@query(
    "stage_funnel_6h", "D8 B11",
    with_ctes("""
      SELECT p.basin, p.total, p.after_quality, coalesce(c.after_features, 0) AS after_features,
        coalesce(c.after_target, 0) AS after_target, p.total - p.after_quality AS lost_quality,
        p.after_quality - coalesce(c.after_features, 0) AS lost_features,
        coalesce(c.after_features, 0) - coalesce(c.after_target, 0) AS lost_target
      FROM (SELECT basin, count(*) AS total, count(*) FILTER (n_estaciones_disponibles >= 2) AS after_quality
            FROM proxy GROUP BY basin) p
      LEFT JOIN (SELECT basin, count(*) AS after_features, count(target_6h) AS after_target
                 FROM complete GROUP BY basin) c USING (basin)""", "proxy", "complete"),
)
def stage_funnel_6h(spark, sf_dir):
    return diagnostics.stage_funnel(series(spark, sf_dir), KEYS)


@query(
    "feature_rows", "E3 E4 E5 E6 H5",
    with_ctes(f"SELECT basin, timestamp, {FEATURE_SQL} FROM features", "features"),
)
def feature_rows(spark, sf_dir):
    rows = feats.feature_rows(quality_split(series(spark, sf_dir))[0])
    return r6(rows.select("basin", "timestamp", *S.FEATURES))


@query(
    "long_feature_rows_chunked", "E3 E4 E5 E6 E7 H5",
    with_ctes(f"SELECT basin, timestamp, {FEATURE_SQL}, {r('target_24h')} AS target_24h FROM long_features", "long_features"),
)
def long_feature_rows_chunked(spark, sf_dir):
    quality = quality_split(long_series(spark, sf_dir))[0]
    rows = feats.feature_rows(quality, (24,), chunk_len=feats.CHUNK_HOURS)
    return r6(rows.select("basin", "timestamp", *S.FEATURES, "target_24h"))


def _register_dataset(h: int) -> None:
    sql = with_ctes(
        f"SELECT basin, timestamp, {FEATURE_SQL}, {r(f'target_{h}h')} AS target_{h}h, split FROM ds{h}", f"ds{h}"
    )

    @query(f"dataset_{h}h", "E7 E9 B11 B12 A13", sql)
    def run(spark, sf_dir):
        rows = dataset(spark, sf_dir, h)
        names = feats.feature_columns(rows, f"target_{h}h")
        return r6(rows.select("basin", "timestamp", *names, f"target_{h}h", "split"))


for _h in S.HORIZONS:
    _register_dataset(_h)


@query(
    "split_summary_6h", "D9 A17",
    with_ctes(f"""
      SELECT basin, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
        min(timestamp) FILTER (split = 'train') AS train_from, max(timestamp) FILTER (split = 'train') AS train_to,
        min(timestamp) FILTER (split = 'test') AS test_from, max(timestamp) FILTER (split = 'test') AS test_to,
        {r('100.0 * count(*) FILTER (target_6h = 0) / count(*)')} AS pct_target_zero, 0.0::DOUBLE AS pct_missing,
        max(timestamp) FILTER (split = 'train') < min(timestamp) FILTER (split = 'test') AS no_leak
      FROM ds6 GROUP BY basin""", "ds6"),
)
def split_summary_6h(spark, sf_dir):
    path = shared_folder(spark, "dataset")
    write_table(dataset(spark, sf_dir), path)
    return r6(diagnostics.split_summary(spark.read.parquet(path), "target_6h", KEYS))


@query(
    "split_preserved_6h", "E10",
    with_ctes(
        """SELECT c.basin, c.timestamp, CASE WHEN k.cut IS NULL THEN c.fresh WHEN c.hour_idx >= k.cut THEN 'test' ELSE 'train' END AS split
           FROM (SELECT *, split AS fresh FROM ds6) c LEFT JOIN cuts k USING (basin)""",
        "ds6",
        earlier="""SELECT *, row_number() OVER (PARTITION BY basin ORDER BY hour_idx) AS rn, count(*) OVER (PARTITION BY basin) AS n
                   FROM (SELECT * FROM ds6 WHERE timestamp < TIMESTAMP '2024-01-20' AND basin <> 'B1')""",
        cuts="""SELECT basin, min(hour_idx) AS cut FROM earlier
                WHERE rn > greatest(1, least(CAST(floor(n * 0.82::DOUBLE) AS BIGINT), n - 1)) GROUP BY basin""",
    ),
)
def split_preserved_6h(spark, sf_dir):
    """An earlier, shorter dataset fixes the cut of its basins; B1 had none yet."""
    rows = dataset(spark, sf_dir)
    before = rows.filter("timestamp < timestamp_ntz'2024-01-20 00:00:00' AND basin <> 'B1'").drop("split")
    earlier = feats.chronological_split(before)
    again = feats.chronological_split(rows.drop("split"), previous_cut=feats.existing_cut(earlier))
    return again.select("basin", "timestamp", "split")


@query(
    "extremes_by_split_6h", "D13",
    with_ctes(f"""
      SELECT basin, {r('p')} AS p90_all, count(*) FILTER (split = 'train' AND target_6h > p) AS train_extremes,
        count(*) FILTER (split = 'test' AND target_6h > p) AS test_extremes
      FROM ds6 JOIN (SELECT basin, quantile_cont(target_6h, 0.9) AS p FROM ds6 GROUP BY basin) USING (basin)
      GROUP BY basin, p""", "ds6"),
)
def extremes_by_split_6h(spark, sf_dir):
    return r6(diagnostics.extremes_by_split(dataset(spark, sf_dir), "target_6h", KEYS))


@query(
    "frozen_window_quantiles", "B10 D10",
    with_ctes(f"""
      SELECT basin, {r("quantile_cont(target_6h, 0.9) FILTER (split = 'train')")} AS p90_train,
        {r("quantile_cont(target_6h, 0.75) FILTER (split = 'train')")} AS p75_train,
        {r('quantile_cont(Q_actual, 0.95)')} AS p95_all
      FROM ds6 WHERE timestamp <= TIMESTAMP '{CUTOFF}' GROUP BY basin""", "ds6"),
)
def frozen_window_quantiles(spark, sf_dir):
    rows = evaluation.until(dataset(spark, sf_dir), CUTOFF)
    return r6(evaluation.quantiles(rows, "target_6h", "Q_actual", KEYS))


