"""Column names, fixed values and declared schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Forecast horizons, lag and window lengths in hours.
HORIZONS = (6, 12, 24)
RAIN_LAGS = (1, 3, 6, 12, 24)
RUNOFF_LAGS = (1, 3, 6)
RAIN_SUMS = (3, 6, 12, 24, 48)
PEAK_HOURS = 6
ACCUMULATION_HOURS = 24
MIN_VALID_HOURS = 12
MIN_STATIONS = 2
TRAIN_FRACTION = 0.82

# Hours of history a feature row can see, with the margin the live path keeps.
LOOK_BACK_HOURS = 48
HISTORY_HOURS = 72

FEATURES = (
    ["P_basin", "Q_actual"]
    + [f"lag_{h}h" for h in RAIN_LAGS]
    + [f"Q_lag_{h}h" for h in RUNOFF_LAGS]
    + [f"roll_sum_{h}h" for h in RAIN_SUMS]
    + [f"roll_max_{PEAK_HOURS}h", "hora_dia", "mes"]
)

LOG_COLUMNS = [
    "timestamp", "P_basin", "Q_actual", "Q_lag_1h", "roll_sum_24h", "hora_dia", "mes",
    "proba_modelo", "proba_alerta", "estado",
]

# Stored tables. Readers declare them, so an empty table reads as zero rows.
_HOUR = "basin string, hour_idx bigint, timestamp timestamp_ntz"
READINGS_TABLE = (
    "basin string, station_id string, sensor_id string, ts timestamp_ntz, arrival bigint, mm double, day date"
)
SERIES_TABLE = (
    f"{_HOUR}, P_basin double, n_estaciones_disponibles int, P_acc_24h double, Q_scs_proxy double, day date"
)
FEATURES_TABLE = (
    f"{_HOUR}, " + ", ".join(f"{c} {'int' if c in ('hora_dia', 'mes') else 'double'}" for c in FEATURES) + ", day date"
)


def dataset_table(horizon: int) -> str:
    return FEATURES_TABLE.replace(", day date", f", target_{horizon}h double, split string, day date")


LOG_TABLE = (
    f"{_HOUR}, P_basin double, Q_actual double, Q_lag_1h double, roll_sum_24h double, hora_dia int, mes int, "
    "proba_modelo double, proba_alerta double, estado string, day date"
)

# Names under which a source may publish the same column.
SENSOR_NAMES = ["codigosensor", "sensor", "id_sensor", "idsensor"]
VALUE_NAMES = ["valorobservado", "precipitacion", "precip", "lluvia"]
TIME_NAMES = ["fechaobservacion", "fecha_observacion", "timestamp", "datetime", "time"]
STATION_NAMES = [
    "codigoestacion", "codigo_estacion", "codigoestacacion", "estacion", "codigo", "codigoestac",
]
DATE_NAMES = ["fechaobservacion", "fecha_observacion", "fecha", "datetime", "timestamp"]

READINGS_TEXT = T.StructType(
    [
        T.StructField("codigoestacion", T.StringType()),
        T.StructField("codigosensor", T.StringType()),
        T.StructField("fechaobservacion", T.StringType()),
        T.StructField("valorobservado", T.StringType()),
    ]
)

CATALOGUE = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("codigo", "nombre", "categoria", "estado", "departamento", "municipio", "latitud", "longitud")]
    + [
        T.StructField(
            "ubicaci_n",
            T.StructType(
                [T.StructField("latitude", T.StringType()), T.StructField("longitude", T.StringType())]
            ),
        )
    ]
)
