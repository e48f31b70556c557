import datetime as dt

from pyspark.sql import functions as F

from newsmill.functions import text as T
from newsmill.operators import attribution as A
from newsmill.plans import attribution, story
from tests.conftest import SF

LINES = [
    ("Harbour Desk: two ferries collided", "Initial reports indicate two ferries collided", 1),
    ("harbour desk | Harbour Desk reported that a pier reportedly fell", "a pier reportedly fell", 2),
    ("Other Desk: two ferries collided", "Other Desk: two ferries collided", 0),
    ("HARBOUR DESK said the pier fell", "Initial reports indicate the pier fell", 1),
    ("Nobody said the pier fell", "Nobody said the pier fell", 0),
    ("The pier fell, according to a local agency, at noon", "Initial reports indicate The pier fell at noon", 1),
    ("According to local media, it fell; according to two sources it may rise", "it fell; it may rise", 2),
    ("The pier fell, according to the mayor", "The pier fell, according to the mayor", 0),
    ("Reports of smoke over the bay", "Reports indicate smoke over the bay", 0),
    ("UNCONFIRMED press reports of smoke", "Unconfirmed reports indicate smoke", 0),
    ("There were reports of smoke", "Reports indicate smoke", 0),
    ("according to local media", "", 1),
    ("", "", 0),
    (None, "", 0),
]


def test_rewrite(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LINES)], "id long, t string")
    got = rows.select("id", A.rewrite(F.col("t"), F.array(F.lit("harbour desk"))).alias("s")).orderBy("id").collect()
    assert [(x.s.text, x.s.cut) for x in got] == [(want, cut) for _, want, cut in LINES]
    none = rows.select(A.rewrite(F.col("t"), F.lit(None).cast("array<string>")).alias("s")).collect()
    assert none[0].s.text == LINES[0][0] and none[0].s.cut == 0


def test_clean_posts_and_counts(spark):
    at = dt.datetime(2024, 1, 1, 0, 30, tzinfo=dt.UTC)
    rows = [
        (1, "a", at, "Harbour Desk: the pier may fall\nThe pier may fall\n\nhttps://x.y/z"),
        (2, "b", at, "Harbour Desk: the pier may fall"),
        (3, None, at + dt.timedelta(seconds=1), None),
        (4, "a", at + dt.timedelta(seconds=1), "According to local media\n" + "Harbour Desk said it could rise. " * 2000),
    ]
    p = spark.createDataFrame(rows, "message_id long, channel_id string, ts timestamp, raw_text string")
    labels = spark.createDataFrame([("a", " HARBOUR Desk "), ("a", None), (None, "Harbour Desk"), ("a", "harbour desk")], "channel_id string, label string")
    cleaned = A.clean_posts(p, labels)
    got = {x.message_id: x for x in cleaned.collect()}
    assert (got[1].text, got[1].kept, got[1].removed, got[1].citations) == ("the pier may fall", 1, 3, 1)
    assert (got[2].text, got[2].removed, got[2].citations) == ("Harbour Desk: the pier may fall", 0, 0)
    assert (got[3].text, got[3].kept, got[3].removed) == ("", 0, 1)
    assert got[4].text.startswith("it could rise. Harbour Desk said") and (got[4].kept, got[4].citations) == (1, 2)
    counts = {x.window_end.minute: (x.posts, x.empty, x.removed, x.citations) for x in A.digest_counts(cleaned).collect()}
    assert list(counts.values()) == [(2, 0, 3, 1), (2, 1, 2, 2)] or list(counts.values()) == [(2, 1, 2, 2), (2, 0, 3, 1)]
    assert A.clean_posts(p.limit(0), labels).count() == 0 and A.clean_posts(p, labels.limit(0)).count() == 4


def test_lines_keep_their_letters(spark):
    text = "A name(d) lambda\tvariable,  'x_0'\u00a0[Column]\r\n<b>second</b> line <3>\n\n a name(d) LAMBDA variable, 'x_0'\u00a0[column] "
    got = spark.createDataFrame([(text,)], "t string").select(T.clean_lines(F.col("t"))).first()[0]
    assert got == ["A name(d) lambda variable, 'x_0'\u00a0[Column]", "second line"]


def equals_its_sql(spark, module, name):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = module.QUERIES[name](spark, SF)
    rows = lambda found: sorted([str(v) for v in r] for r in found)
    plain = df.select(*[F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c) for c, t in df.dtypes])
    assert rows(plain.collect()) == rows(db.execute(f"SELECT {', '.join(df.columns)} FROM ({module.ORACLES[name]})").fetchall())


def test_clean_posts_equal_their_sql(spark):
    equals_its_sql(spark, story, "c3_clean_posts")


def test_attributions_equal_their_sql(spark):
    equals_its_sql(spark, attribution, "c3_attributions")


def test_digest_counts_equal_their_sql(spark):
    equals_its_sql(spark, attribution, "e17_digest_counts")
