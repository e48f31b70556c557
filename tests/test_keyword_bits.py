"""Substring terms of more questions than one number has bits."""

from newsmill.operators import retrieval as Q


def test_many_questions_meet_posts_as_bits(spark):
    asked = [(i, [f"w{i % 70}x", "all"] if i % 2 else [f"{i}"]) for i in range(200)]
    prepared = spark.createDataFrame([(i, [t for t in ts if not t.isdigit()], [t for t in ts if t.isdigit()]) for i, ts in asked], "query_id long, keywords array<string>, numbers array<string>")
    texts = ["W1x and w22xy", "tall 148", "no", None, "w69x.w3x a100b", "all " + " ".join(f"w{i}x" for i in range(70))]
    posts = spark.createDataFrame(list(enumerate(texts)), "message_id long, raw_text string")
    got = Q.keyword_filter(prepared, posts)
    want = sorted((q, i) for q, ts in asked for i, x in enumerate(texts) if x and any(t in x.lower() for t in ts))
    assert sorted((r.query_id, r.id) for r in got.collect()) == want
    assert "bit_or" in got._jdf.queryExecution().optimizedPlan().toString()


def test_each_question_has_a_bit_of_its_own(spark):
    bits = Q.query_bits(spark.createDataFrame([(f"q{i}",) for i in range(300)], "query_id string"), 8).collect()
    assert len({(b.part, b.bit) for b in bits}) == 300 and {b.bit for b in bits} <= set(range(8))
