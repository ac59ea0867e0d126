"""Interval joins against plain loops."""

import datetime
import random

from siltworks.operators.windows import within


def test_windows_equal_plain_loops(spark):
    r = random.Random(6)
    day = lambda: datetime.date(1969, 12, 1) + datetime.timedelta(days=r.randrange(90))  # noqa: E731  (buckets below zero too)
    docs = [(i, r.choice([day(), datetime.date(1970, 1, 1)]) if r.random() < 0.95 else None) for i in range(300)] + [(7, datetime.date(1970, 1, 1))] * 2
    events = [(i, r.choice([day(), None]), r.choice([day(), None])) for i in range(60)] + [(99, datetime.date(1800, 1, 1), datetime.date(2200, 1, 1)), (100, datetime.date(1800, 1, 1), datetime.date(1801, 1, 1))]
    e, d = spark.createDataFrame(events, "e long, lo date, hi date"), spark.createDataFrame(docs, "d long, day date")
    want = sorted((x, y) for x, lo, hi in events for y, t in docs if t and (lo is None or lo <= t) and (hi is None or t <= hi))
    for part in (1_000_000, 20):  # the second deals a hot day out
        got = within(e, d, "lo", "hi", "day", "d", days=7, part=part)
        assert sorted((x["e"], x["d"]) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert within(e, d.limit(0), "lo", "hi", "day", "d").count() == within(e.limit(0), d, "lo", "hi", "day", "d").count() == 0
