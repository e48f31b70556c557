"""Posts outside the spans of all requests are left out before their texts are read."""

import datetime as dt

from newsmill.operators import answers as A

T0 = dt.datetime(2024, 1, 1)
FORM = "query_id long, keywords array<string>, aliases array<string>, numbers array<string>, since timestamp, until timestamp"


def found(spark, spans):
    at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    prepared = spark.createDataFrame([(i, ["alpha"], [], [], at(a), at(b)) for i, (a, b) in enumerate(spans)], FORM)
    posts = spark.createDataFrame([("s", h, "Alpha and beta", at(h)) for h in range(10)], "channel_id string, message_id long, raw_text string, ts timestamp")
    return A.bounded_evidence(prepared, posts)


def test_spans_bound_the_posts(spark):
    got = lambda spans: {(r.query_id, r.id) for r in found(spark, spans).collect()}
    for spans in ([(2, 4), (7, 8)], [(None, 3), (5, 6)], [(8, None), (2, 3)], [(None, None), (1, 2)], []):
        assert got(spans) == {(i, h) for i, (a, b) in enumerate(spans) for h in range(10) if (a is None or h >= a) and (b is None or h < b)}
    plan = found(spark, [(2, 4)])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Generate") < plan.index("LeftSemi")  # the join is below the words
    assert plan.count("each#") and plan.count("split(") == 1  # and nothing below it reads the texts
