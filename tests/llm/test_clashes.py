"""Extra columns keep their names and values, whatever names the operators use inside."""

import pytest
from pyspark.sql import functions as F

from newsmill.llm import decontaminate, jaccard, mixing, quality, sharding, templates

NAMES = "row text_key key id sig n n_words _words _lines kept base_failed sum take size gone uid vslot k1 k2 _n_words _n_hit __n_hit n_hit items _id _key _text _sum _take component_id word_chars at".split()
GOOD = " ".join(["The quick report of the day was read and then it is kept in a box by them"] * 1 + [f"word{i} and the other{i} of it" for i in range(30)])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, GOOD, "en", "s"), (2, GOOD + " more", "en", "s"), (3, None, "en", None), (4, "", "de", "s"), (5, GOOD[200:] + " " + " ".join(f"x{i} the" for i in range(60)), "de", "t"), (5, GOOD[200:] + " " + " ".join(f"x{i} the" for i in range(60)), "de", "t"), (None, "short text", None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in NAMES})


STAGES = {
    "keep_good": lambda d, b: quality.keep_good(d),
    "keep_one": lambda d, b: jaccard.keep_one(d),
    "drop_contaminated": lambda d, b: decontaminate.drop_contaminated(d, b),
    "drop_contaminated_joined": lambda d, b: decontaminate.drop_contaminated(d, b, 1),
    "mix": lambda d, b: mixing.mix(d),
    "shard": lambda d, b: sharding.shard(d, carry=True),
    "drop_lines": lambda d, b: templates.drop_lines(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_values_of_clashing_columns_stay(spark, docs, name):
    bench = spark.createDataFrame([(1, "another text that no document has at all in it today")], "item_id long, text string")
    out = STAGES[name](docs, bench)
    got = out.collect()
    assert got
    for r in got:
        for c in NAMES:
            if not (name == "shard" and c == "size"):
                assert r[c] == c + str("none" if r["doc_id"] is None else r["doc_id"]), (name, c)
    assert set(docs.columns) <= set(out.columns)
    want = {"keep_good": [1, 2, 5, 5], "keep_one": [1, 3, 4, 5, None], "shard": [1, 2, 3, 4, 5, 5, None], "drop_lines": [1, 2, 3, 4, 5, 5, None], "drop_contaminated": [1, 2, 3, 4, 5, 5, None], "drop_contaminated_joined": [1, 2, 3, 4, 5, 5, None]}
    if name in want:
        assert sorted(map(str, want[name])) == sorted(str(r["doc_id"]) for r in got)
    assert STAGES[name](docs.limit(0), bench).count() == 0


def test_rows_of_one_text_without_id_share_out_slots(spark):
    n = 5000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    out = sharding.shard(docs)
    (shard,) = {r.shard for r in out.select("shard").distinct().collect()}
    assert sorted(r.slot for r in out.collect()) == list(range(n)) and shard >= 0


def test_a_source_of_empty_texts_takes_nothing(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "one two three four " * 50, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.size, r.source_size, r.taken) for r in mixing.plan(docs).collect()}
    assert got[1] == (0, 0, 0) and got[2] == (0, 0, 0) and got[3][0] == 200 and 280 <= got[3][2] <= 320
