import datetime as dt
import random

from newsmill.operators import digests as G

T0 = dt.datetime(2024, 1, 1)


def fold(costs, budget):
    out, part, used = [], 0, budget + 1
    for c in costs:
        c = min(max(1, c), budget)
        if used + c > budget:
            part, used = part + 1, 0
        used += c
        out.append(part)
    return out


def test_packing_equals_the_fold(spark):
    r = random.Random(3)
    rows = [("hot", i, r.choice([1, 5, 30, 99, 100, 400, 0])) for i in range(900)] + [("small", i, 100) for i in range(7)] + [("one", 0, 3), (None, 0, 60), (None, 1, 60), ("tiny", 0, 1), ("tiny", 1, 1)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, T0 + dt.timedelta(seconds=x[1])) for x in rows], "channel string, id long, cost long, ts timestamp").repartition(5)
    want = {}
    for c in {x[0] for x in rows}:
        own = sorted((i, k) for g, i, k in rows if g == c)
        want |= {(c, i): p for (i, _), p in zip(own, fold([k for _, k in own], 100), strict=True)}
    for width in (2, 64):
        got = G.pack_by_budget(df, "channel", ["ts", "id"], "cost", 100, width=width).collect()
        assert len(got) == len(rows) and {(x.channel, x.id): x.part for x in got} == want
    assert G.pack_by_budget(df.limit(0), "channel", ["ts", "id"], "cost", 100).count() == 0


def test_no_task_holds_a_channel(spark):
    """The largest group of a stage is a block, however large the channel."""
    df = spark.createDataFrame([("hot", i, 50) for i in range(4000)], "channel string, id long, cost long")
    ordered = G.in_order(df, "channel", ["id"], "cost")
    sizes = ordered.selectExpr("before div 400 as block").groupBy("block").count().agg({"count": "max"}).first()[0]
    assert sizes == 8 and [x.before for x in ordered.orderBy("id").limit(3).collect()] == [0, 50, 100]


def test_entries_take_one_join_a_doubling(spark, monkeypatch):
    """65 blocks are 7 doublings; a branch for each value of a block's bits was 127 joins in one plan."""
    joins, stage = {}, G.stage

    def seen(df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join")
        return stage(df, name)

    monkeypatch.setattr(G, "stage", seen)
    df = spark.createDataFrame([("hot", i, 100) for i in range(130)], "channel string, id long, cost long")
    got = G.pack_by_budget(df, "channel", ["id"], "cost", 100, width=2)
    assert joins["entries"] <= 7
    assert [x.part for x in got.orderBy("id").collect()] == list(range(1, 131))
