"""Evidence in bounded tasks, the wide window only for thin questions."""

import datetime as dt

from newsmill.operators import retrieval as Q

T0 = dt.datetime(2024, 1, 1)


def data(spark):
    prepared = Q.prepare(spark.createDataFrame([(1, "alpha 77"), (2, "beta"), (3, "nowhere")], "query_id long, question string"))
    rows = [(f"s{i % 3}", i, "alpha ALPHA beta" if i % 2 else "alpha 77", T0 + dt.timedelta(minutes=i)) for i in range(60)]
    return prepared, spark.createDataFrame(rows, "channel_id string, message_id long, raw_text string, ts timestamp")


def test_evidence_is_counted_by_few_posts_a_task(spark, monkeypatch):
    prepared, posts = data(spark)
    monkeypatch.setattr(Q, "POSTS_A_TASK", 10)
    got = Q.evidence(prepared, posts)
    assert {(r.query_id, r.id, r.source, r.kw_hits, r.num_hits) for r in got.collect()} == {(1, i, f"s{i % 3}", 1, 1 - i % 2) for i in range(60)} | {(2, i, f"s{i % 3}", 1, 0) for i in range(1, 60, 2)}
    assert "RepartitionByExpression [id" in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_thin_questions_are_looked_up_further(spark):
    prepared, posts = data(spark)
    asked = []

    def wide(thin):
        asked.extend(sorted(r.query_id for r in thin.collect()))
        return Q.evidence(thin, posts)

    got = Q.widen(prepared, Q.evidence(prepared, posts, T0 + dt.timedelta(minutes=55)), wide).collect()
    assert asked == [3] and {(r.query_id, r.id, r.expanded) for r in got} == {(1, i, False) for i in range(55, 60)} | {(2, i, False) for i in (55, 57, 59)}
    got = Q.widen(prepared, Q.evidence(prepared, posts, T0 + dt.timedelta(minutes=56)), wide).collect()
    assert asked == [3, 2, 3] and {r.id for r in got if r.query_id == 2 and r.expanded} == set(range(1, 60, 2))
