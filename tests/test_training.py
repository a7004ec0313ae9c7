"""Forests: order of the training rows, forests side by side, one computation of the training rows, memory of a fit."""

import itertools
import threading
import time

import pytest
from pyspark.sql import functions as F

from freshet import schema as S
from freshet.plans import training
from freshet.queries import models
from freshet.sources import gauges
from tests.conftest import MEDIUM


def test_series_of_training_rows_is_computed_once_and_like_rows_follow_each_other(spark, monkeypatch):
    reads, events = [], gauges.events
    monkeypatch.setattr(gauges, "events", lambda *a: reads.append(a) or events(*a))
    rows = models._stored_dataset(spark, MEDIUM)
    assert len(reads) == 1
    dealt = training._spread(rows, 4).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    for _, part in itertools.groupby(sorted(dealt.collect(), key=lambda r: r["_n"]), key=lambda r: r["_part"]):
        values = [[r[c] for c in [*S.FEATURES, "basin", "hour_idx"]] for r in part]
        assert len(values) > 1 and values == sorted(values)


def test_forests_side_by_side_are_the_ones_fitted_alone(spark):
    rows = models._stored_dataset(spark, MEDIUM)
    fits = [lambda t=t, w=w: training.fit_regressor(rows, t, w, numTrees=3, maxDepth=4)
            for t, w in (("target_6h", None), ("target_6h", "sample_weight"), ("delta", None))]
    means = lambda ms: [round(training.predict(m, rows, "p").agg(F.avg("p")).first()[0], 9) for m in ms]
    together = training.fit_side_by_side(spark, fits)
    assert len(set(means(together))) == 3 and means(together) == means([f() for f in fits])


def test_node_statistics_of_a_regressor_fit_beside_the_cached_rows(spark):
    rows = models._stored_dataset(spark, MEDIUM)
    forest = training.fit_regressor(rows, "target_6h", numTrees=2, maxDepth=2).stages[-1]
    # Two tasks of an executor with a heap of 1,800 MB: 300 MB are reserved, 60 % of the rest are for cached rows and shuffles.
    # MLlib counts three numbers a bin and keeps four.
    assert 2 * forest.getMaxMemoryInMB() * 4 / 3 <= 0.4 * (1800 - 300)
    assert not forest.getCacheNodeIds()


def test_a_regressor_is_the_same_with_less_memory_and_without_node_ids(spark):
    rows = models._stored_dataset(spark, MEDIUM).filter("split = 'train'")
    grown = []
    for memory in ({"cacheNodeIds": True, "maxMemoryInMB": 1024}, {}, {"maxMemoryInMB": 4}):
        model = training.fit_regressor(rows, "delta", numTrees=20, maxDepth=8, **memory)
        per_row = training.predict(model, rows, "p").select("basin", "hour_idx", F.round("p", 9)).collect()
        grown.append((model.stages[-1].totalNumNodes, sorted(per_row)))
    assert grown[0] == grown[1] == grown[2]


def test_forests_grow_one_after_the_other_on_many_rows(spark, monkeypatch):
    running, seen, lock = [], [], threading.Lock()

    def fit(_, *target):
        with lock:
            running.append(target)
            seen.append(len(running))
        time.sleep(0.5)
        with lock:
            running.remove(target)

    def grown(*_):
        raise StopIteration("all forests are grown")

    rows = spark.range(4).selectExpr("id", "if(id < 3, 'train', 'test') AS split")
    monkeypatch.setattr(models, "_stored_dataset", lambda *_: rows)
    monkeypatch.setattr(training, "fit_regressor", fit)
    monkeypatch.setattr(training, "predict", grown)
    for limit, most in ((3, 2), (2, 1)):
        seen.clear()
        monkeypatch.setattr(training, "AT_ONCE_ROWS", limit)
        with pytest.raises(StopIteration):
            models.forest_regressors_report(spark, MEDIUM)
        assert len(seen) == 3 and max(seen) == most
