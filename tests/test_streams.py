"""Streams with state over several micro-batches, and what their steps are made of."""

from datetime import datetime, timedelta

from evigrid.streaming import stateful

DAY = datetime(2024, 1, 1)


def _asked(spark, *rows):
    return spark.createDataFrame([(c, r, DAY + timedelta(seconds=t)) for c, r, t in rows], "client long, request_id long, at timestamp_ntz")


def _failed(spark, *rows):
    return spark.createDataFrame([(p, DAY + timedelta(seconds=t)) for p, t in rows], "plugin_id long, failed_at timestamp_ntz")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_limits_go_on_from_batch_to_batch_without_python(spark):
    step = stateful.limited(2, 100)
    a, b = _asked(spark, (1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 4, 5)), _asked(spark, (1, 5, 99), (1, 6, 100), (1, 7, 105), (2, 8, 6), (2, 9, 7))
    found = stateful.over_batches([a, b], step, "test")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 6), (2, 4), (2, 8)]
    assert "Pandas" not in _plan(step(b, step(a, None)[1])[0])


def test_quarantines_count_over_batches_and_leave_out_late_failures(spark):
    step = stateful.quarantines(3, 1)
    a, b = _failed(spark, (1, 0), (1, 10), (2, 9000)), _failed(spark, (1, 8000), (1, 8001), (1, 8002), (1, 5), (2, 8999), (2, 9000), (2, 9001))
    got = stateful.over_batches([a, b], step, "test").collect()
    assert sorted((r.plugin_id, (r.quarantined_at - DAY).seconds, r.n_failures) for r in got) == [(1, 8002, 3), (2, 9001, 3)]
    assert "Pandas" not in _plan(step(b, step(a, None)[1])[0])
