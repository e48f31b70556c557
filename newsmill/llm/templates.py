"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its first DEPTH tokens, tokens with digits standing as a variable field. In a
leaf, a token that fewer than `min_docs` documents have at its position is a variable field too; what remains is the
line's template. Templates that recur in `min_docs` documents or more, and are constant enough not to be chance, are
boilerplate: their lines are dropped.

Two sorts of lines are also dropped as they stand, token for token, digits included. Lines of fewer than MIN_TOKENS
tokens go from SHORT_TIMES * min_docs documents on. Lines of LONG_TOKENS tokens or more go from two different documents
on: different texts that aren't near copies of each other, as a near copy repeats nearly all of its lines and belongs
to document dedup. Texts are near copies where at least half of the smaller one's 3-grams, without the lines in
question, are in the other. Only lines of fewer than min_docs documents need that test, so a line has few pairs.

Lines are named by 128 bits, a leaf and a hash of the tokens; joins move those names, and the texts of distinct lines
only in leaves that recur. Equal lines are counted once for all documents that have them, so a line that a third of
the documents share is one row. Documents aren't grouped: each takes the numbers of its dropped lines by a join on its
row key. Joins are planned alike at every size.

Defined results: null and empty texts have no lines with tokens and stay as they are; blank lines
always stay; a text with nothing but shared lines counts as a near copy of what shares them; repeated rows count as documents of their own; null ids are kept; an empty table
gives no rows; `drop_lines` passes other columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import WORD, fields, let, packed, release, stage

DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 10
#: A line of fewer than MIN_TOKENS tokens needs so many times min_docs documents.
SHORT_TIMES = 3
#: A line of so many tokens is boilerplate from two different documents on.
LONG_TOKENS = 50
#: Texts are picked by buckets of their keys before they move; this bounds the broadcast.
BUCKETS = 1 << 20
#: Share of a template's tokens, in percent, that are constant.
CONSTANT = 70
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _leaf(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), F.transform(F.slice(tokens, 1, depth), _mask))


def _named(text: Column, depth: int, more=lambda line, tokens, i: []) -> Column:
    """For each line with tokens its token count, leaf and a hash of its tokens, and what `more` adds."""
    name = lambda t, x, i: F.struct(*more(x, t, i), F.size(t).alias("n"), _leaf(t, depth).alias("leaf"), F.xxhash64(t).alias("line_key"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: let(_tokens(x), lambda t: name(t, x, i)))
    return F.filter(lines, lambda x: x["n"] > 0)


def _keys(docs: DataFrame, depth: int) -> DataFrame:
    """uid (a number of the row), doc_id, text_key, and the lines with tokens: number, token count, leaf and line_key."""
    lines = _named(F.col("text"), depth, lambda x, t, i: [i.alias("at")])
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), lines.alias("lines"))


def recurring(docs: DataFrame, keys: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> DataFrame:
    """leaf and line_key of the lines whose template min_docs documents or more have.

    A template is named by its leaf and two hashes of its constant tokens with their positions. Where one of its lines
    is in min_docs documents it recurs; where all its lines together are in fewer it doesn't; documents are told apart
    only for the templates between, whose lines are all in few documents.
    """
    long = F.filter("lines", lambda x: x["n"] >= MIN_TOKENS)
    own = keys.select("uid", F.explode(F.array_distinct(F.transform(long, lambda x: F.struct(x["leaf"].alias("leaf"), x["line_key"].alias("line_key"))))).alias("x")).select("uid", "x.leaf", "x.line_key")
    leaves = keys.select(F.explode(F.array_distinct(F.transform(long, lambda x: x["leaf"]))).alias("leaf"))
    often = stage(leaves.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    counted = own.groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("docs")).join(often.hint("merge"), "leaf", "left_semi")

    # one text of each of these lines; a bounded set of buckets spares most others the way
    bucket = F.pmod("leaf", F.lit(BUCKETS))
    texts = docs.select(F.explode(F.array_distinct(_named(F.col("text"), depth, lambda x, t, i: [F.array_join(t, " ").alias("line")]))).alias("x")).select("x.leaf", "x.line_key", "x.line", "x.n").where(F.col("n") >= MIN_TOKENS)
    texts = texts.join(F.broadcast(often.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi").select("leaf", "line_key", "line").distinct()
    tokens = F.transform(_tokens(F.col("line")), lambda t: F.when(~t.rlike("[0-9]"), F.xxhash64(t)))
    lines = texts.hint("merge").join(counted, ["leaf", "line_key"]).select("leaf", "line_key", "docs", tokens.alias("tokens"))
    lines = stage(lines, "distinct-lines")
    at = lines.select("leaf", "line_key", "docs", F.posexplode("tokens").alias("pos", "token"))
    known = at.where("token IS NOT NULL").groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).drop("n")
    marked = at.join(known.withColumn("fixed", F.lit(True)).hint("merge"), ["leaf", "pos", "token"], "left")
    name = lambda seed: F.bit_xor(F.when(F.col("fixed"), F.xxhash64(F.lit(seed), "pos", "token")))
    shaped = marked.groupBy("leaf", "line_key", "docs").agg(name(1).alias("t1"), name(2).alias("t2"), F.count("fixed").alias("fixed"), F.count(F.lit(1)).alias("all"))
    shaped = stage(shaped.where(100 * F.col("fixed") >= constant * F.col("all")).select("leaf", "line_key", "docs", "t1", "t2"), "templates")
    release(lines)

    template = ["leaf", "t1", "t2"]
    sums = shaped.groupBy(*template).agg(F.sum("docs").alias("most"), F.max("docs").alias("least")).where(F.col("most") >= min_docs)
    ranked = stage(shaped.join(sums.hint("merge"), template).withColumn("sure", F.col("least") >= min_docs), "ranked-lines")
    open_ = own.join(ranked.where("NOT sure").select("leaf", "line_key", "t1", "t2").hint("merge"), ["leaf", "line_key"])
    enough = open_.select("uid", *template).distinct().groupBy(*template).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    more = ranked.where("NOT sure").join(enough.hint("merge"), template, "left_semi")
    return ranked.where("sure").unionByName(more).select("leaf", "line_key")


def literal(docs: DataFrame, keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """leaf and line_key of the short and long lines to drop as they stand."""
    some = F.filter("lines", lambda x: (x["n"] < MIN_TOKENS) | (x["n"] >= LONG_TOKENS))
    rows = keys.select("text_key", F.explode(F.array_distinct(F.transform(some, lambda x: F.struct(x["n"].alias("n"), x["leaf"].alias("leaf"), x["line_key"].alias("line_key"))))).alias("x")).select("text_key", "x.*")
    rows = rows.groupBy("leaf", "line_key", "n").agg(F.count(F.lit(1)).alias("docs"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi"))
    short = (F.col("n") < MIN_TOKENS) & (F.col("docs") >= SHORT_TIMES * min_docs)
    again = stage(rows.where(short | (F.col("n") >= LONG_TOKENS) & (F.col("lo") != F.col("hi"))), "literal-lines")
    sure = (F.col("n") < MIN_TOKENS) | (F.col("docs") >= min_docs)
    names = again.where(sure).select("leaf", "line_key")

    # the other long lines: those whose texts, the first of them against each, aren't all near copies
    own = keys.select("text_key", F.explode(F.filter("lines", lambda x: x["n"] >= LONG_TOKENS)).alias("x")).select("text_key", "x.at", "x.leaf", "x.line_key")
    own = stage(own.join(again.where(~sure).select("leaf", "line_key", F.col("lo").alias("first")).hint("merge"), ["leaf", "line_key"]).distinct(), "open-lines")
    rest = _rests(docs, own)
    pairs = stage(own.where(F.col("text_key") != F.col("first")).select("leaf", "line_key", "text_key", "first").distinct(), "open-pairs")
    both = pairs.select("text_key", "first").distinct().join(rest.hint("merge"), "text_key")
    both = both.join(rest.select(F.col("text_key").alias("first"), F.col("grams").alias("others")).hint("merge"), "first")
    apart = 2 * F.size(F.array_intersect("grams", "others")) < F.least(F.size("grams"), F.size("others"))
    apart = both.where(apart).select("text_key", "first")
    return names.unionByName(pairs.join(apart.hint("merge"), ["text_key", "first"], "left_semi").select("leaf", "line_key").distinct())


def _rests(docs: DataFrame, own: DataFrame) -> DataFrame:
    """text_key and grams: distinct hashes of a text's 3-grams outside the given lines (whole lines where shorter)."""
    bucket = lambda key: F.pmod(key, F.lit(BUCKETS)).alias("bucket")
    text = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    text = text.join(F.broadcast(own.select(bucket(F.col("text_key"))).distinct()), bucket(F.col("text_key")) == F.col("bucket"), "left_semi")
    gone = own.groupBy("text_key").agg(F.collect_set("at").alias("gone"))  # one text's line numbers
    rows = stage(text.dropDuplicates(["text_key"]).join(gone.hint("merge"), "text_key"), "open-texts")
    grams = lambda t: F.when(F.size(t) < 3, F.array(F.xxhash64(t))).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - 2), lambda i: F.xxhash64(F.slice(t, i, 3))))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("gone", i), _tokens(x)))
    lines = F.filter(lines, lambda t: F.size(t) > 0)
    return stage(rows.select("text_key", F.array_distinct(F.flatten(F.transform(lines, grams))).alias("grams")), "rests")


def drop_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: int = CONSTANT) -> DataFrame:
    """docs with text shortened, and n_lines and n_dropped (columns of these names are replaced)."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = packed(docs)
    docs = docs.select("doc_id", "text")
    keys = stage(_keys(docs, depth), "line-keys")
    gone = stage(recurring(docs, keys, depth, min_docs, constant).unionByName(literal(docs, keys, min_docs)), "boilerplate")
    out = keys.select("doc_id", "text_key", F.explode("lines").alias("x")).select("doc_id", "text_key", "x.at", "x.leaf", "x.line_key")
    out = out.join(gone.hint("merge"), ["leaf", "line_key"], "left_semi")  # 128 bits name a line; no text moves
    out = out.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("gone"))  # one document's line numbers
    text = F.col("row.text")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = rows.join(out.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (key == F.col("text_key")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    short = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(*fields(names, {"text": short}), F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"))
