"""Three-level alert scale and the dry-period rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alert scale; a level is reached at its threshold (>=).
CAUTION_AT = 0.30
ALERT_AT = 0.70
DRY_RAIN_MM = 0.0
DRY_PROBABILITY_CAP = 0.0066
STATES = ["NORMAL", "PRECAUCIÓN", "ALERTA"]
STATE_LABELS = ["Sin alerta", "Precaución", "Alerta roja"]
NO_DATA_LABEL = "Sin datos"


def state(probability: Column) -> Column:
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability >= ALERT_AT, F.lit(STATES[2]))
        .when(probability >= CAUTION_AT, F.lit(STATES[1]))
        .otherwise(F.lit(STATES[0]))
    )


def dry_rule(probability: Column, rain_24h: Column, cap: float = DRY_PROBABILITY_CAP) -> Column:
    """Cap the probability when no rain fell in 24 h; unknown rain leaves it as it is."""
    dry = (rain_24h <= DRY_RAIN_MM) & probability.isNotNull()
    return F.when(dry, F.least(probability, F.lit(cap))).otherwise(probability)


def level(state_name: Column) -> Column:
    """0, 1 or 2; names outside the scale count as 0."""
    return F.when(state_name == STATES[2], 2).when(state_name == STATES[1], 1).otherwise(0)


def state_of_level(lvl: Column) -> Column:
    return F.when(lvl == 2, STATES[2]).when(lvl == 1, STATES[1]).when(lvl == 0, STATES[0])


def label_of_level(lvl: Column) -> Column:
    return (
        F.when(lvl == 2, STATE_LABELS[2]).when(lvl == 1, STATE_LABELS[1])
        .when(lvl == 0, STATE_LABELS[0]).otherwise(NO_DATA_LABEL)
    )


def with_rules(df, raw: str = "proba_modelo", rain: str = "roll_sum_24h"):
    """Adjusted probability and state from a raw probability column."""
    return df.withColumn("proba_alerta", dry_rule(F.col(raw), F.col(rain))).withColumn(
        "estado", state(F.col("proba_alerta"))
    )


# Sources measured in the channel, by how their names begin.
IN_CHANNEL = ("nivel:", "turbidez")


def fused_state(probability: Column, sources: Column, has_valid_nodes: Column) -> Column:
    """State from the model and the critical signals of the last half hour (``sources``: array of distinct names).

    A probability at the alert threshold counts as the source ``modelo``. Two sources, one of them in the channel, are an alert; one
    source or a probability at the caution threshold is a caution. Without a valid node the model's own scale holds.
    """
    model = F.coalesce(probability >= ALERT_AT, F.lit(False))
    number = F.size(sources) + model.cast("int")
    in_channel = F.exists(sources, lambda s: s.startswith(IN_CHANNEL[0]) | s.startswith(IN_CHANNEL[1]))
    fused = (
        F.when((number >= 2) & in_channel, F.lit(STATES[2]))
        .when((number >= 1) | F.coalesce(probability >= CAUTION_AT, F.lit(False)), F.lit(STATES[1]))
        .otherwise(F.lit(STATES[0]))
    )
    return F.when(has_valid_nodes, fused).otherwise(state(probability))
