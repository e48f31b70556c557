"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="newsmill-")
        shared_dir.own = at
    return at.rstrip("/")


#: Lets Spark delete a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread of files, not a recomputation of everything before. The
    shuffle files behind the table aren't needed any more and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def release(*staged: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = df.__dict__.pop("staged_at", None) if df is not None else None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def packed(df: DataFrame) -> DataFrame:
    """All columns as fields of one struct column, row: names that an operator adds can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def fields(names: list[str], put: dict[str, Column] | None = None) -> list[Column]:
    """The named fields of row as columns again, those in put replaced."""
    return [(put[c] if put and c in put else F.col(f"row.`{c}`")).alias(c) for c in names]


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def first_by_hash(df: DataFrame, column: str, n: int) -> list:
    """n distinct values of a column in the order of their hashes (all, if there are fewer).

    A count of the distinct values sets a bar on the hash that about 4n of them pass, so tasks and the driver hold a
    few times n values, however many tasks there are.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    total = values.agg(F.approx_count_distinct("v", 0.05)).first()[0]
    low = F.pmod(F.xxhash64("v"), F.lit(1 << 20))
    if total > 8 * n:
        values = values.where(low < F.lit(int(4 * n / total * (1 << 20)) + 1))
    return [r[0] for r in values.distinct().orderBy(low, F.xxhash64("v"), "v").limit(n).collect()]


def n_words(text: Column) -> Column:
    """Number of words; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> DataFrame:
    """Adds text_key. (doc_id, text_key), compared null-safely, names a document row; exact repeats share the name."""
    return df.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,hit,part>>, positions in code points, end exclusive.

    Between two matches lies one piece of split(); the running length of pieces and hits gives the positions.
    part is the given group of the match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = F.arrays_zip(hits.alias("hit"), F.slice(pieces, 1, F.size(hits)).alias("piece"), parts.alias("part"))
    kind = "array<struct<start:int,end:int,hit:string,part:string>>"
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def span_list(spans: Column, kind: Column | str) -> Column:
    """'kind:start:end' for each span."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", k, s["start"].cast("string"), s["end"].cast("string")))
