"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

The mix is counted in blocks of BLOCK words. Blocks go to sources by the highest quotients target / (2k - 1), then
each source's blocks go to its shards by the highest quotients size / (2k - 1); a shard is a hash part of a source, and
a source of n documents has about sqrt(n) of them, so neither the list of a source's shards nor a shard's documents
grow faster than that root. In a shard, documents stand in a seeded order; its words, repeated up to EPOCHS times,
are cut into blocks and the quota's first ones are taken. A document thus gives as many words as its stretch of the
stream overlaps the taken blocks, at most EPOCHS times its size.

Quotients aren't listed up to a source's whole quota: with n parties every final quota lies within bounds that follow
from the divisor (see `apportion`), so about 2n quotients are ranked.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; order
ties fall to equal (doc_id, size) rows only, whose takings are interchangeable; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.common import WORD, fields, n_words, packed, stage

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix has 150 % of all words
EPOCHS = 2
BLOCK = 16
SEED = 17


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> + target, by filling to a common level per weight with a cap at epochs * source_size.

    Sources stand in order of cap / weight; those before the first whose fill level stays under its cap are at their
    caps. One row for each source: the windows over all rows see sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("w", F.get(each, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    rows = rows.withColumn("cap", epochs * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "w_left": F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    # level = (share * total - capped) / w_left, kept as a fraction of whole numbers, whose products outgrow 64 bits
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = (share[0] * wide("total") - share[1] * wide("capped")).cast("decimal(20,0)")
    under = over * wide("w").cast("decimal(9,0)") <= (share[1] * wide("w_left").cast("decimal(12,0)")) * wide("cap")
    rows = rows.withColumn("over", over).withColumn("under", under)
    level = F.min(F.when(F.col("under"), F.struct((F.col("cap") / F.col("w")).alias("r"), "over", "w_left"))).over(everything)
    rows = rows.withColumn("level", level)
    free = (F.col("level.over") * F.col("w")).cast("double") / (share[1] * F.col("level.w_left")).cast("double")
    return rows.select("source", "source_size", F.when(F.col("under"), free).otherwise(F.col("cap").cast("double")).alias("target"))


def apportion(parties: DataFrame, keys: list[str], name: Column, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague within each group: adds quota. votes and seats (the group's, on each row) are columns.

    With W votes, S seats and n parties the final divisor d has S - n/2 <= W/d <= S + n/2, so a quota lies between
    v(S - n/2)/W - 1/2 and v(S + n/2)/W + 1/2. Seats below the lower bound are certain; the others go to the highest
    of the remaining quotients.
    """
    group = Window.partitionBy(*keys)
    p = parties.withColumns({"_v": F.col(votes).cast("double"), "_n": F.count(F.lit(1)).over(group), "_all": F.sum(F.col(votes).cast("double")).over(group)})
    bound = lambda sign: F.when(F.col("_all") > 0, F.col("_v") * (F.col(seats) + sign * F.col("_n") / 2) / F.col("_all") + sign * 0.5).otherwise(0.0)
    p = p.withColumn("_low", F.greatest(F.lit(0), F.floor(bound(-1))).cast("long")).withColumn("_high", F.greatest(F.ceil(bound(1)) + 1, F.col("_low")).cast("long"))
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(group)).withColumn("_name", name)
    tries = p.select(*keys, "_name", "_v", "_low", "_open", F.explode(F.when((F.col("_v") > 0) & (F.col("_high") > F.col("_low")), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array(F.lit(None).cast("long")))).alias("_k"))
    tries = tries.withColumn("_q", F.col("_v") / (2 * F.col("_k") - 1))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_q").desc_nulls_last(), F.col("_v").desc(), F.col("_name").asc_nulls_last()))
    won = tries.withColumn("_won", F.when(F.col("_k").isNotNull() & (rank <= F.col("_open")), 1).otherwise(0))
    return won.groupBy(*keys, "_name").agg((F.first("_low") + F.sum("_won")).cast("long").alias("quota"))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, taken for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = stage(docs.select("doc_id", "source", F.xxhash64(text).alias("text_key"), n_words(F.col("text")).alias("size")), "mix")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aims = targets(per.select("source", "source_size"), weights, share, epochs).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    seats = apportion(aims.withColumn("all", F.lit(0)), ["all"], F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")), "target", "blocks")
    seats = seats.select(F.col("_name.none").alias("none"), F.col("_name.name").alias("name"), F.col("quota").alias("source_quota"))
    flat = lambda df: df.withColumns({"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}).drop("source")
    sources = stage(flat(per).join(flat(aims).drop("source_size"), ["none", "name"]).join(seats, ["none", "name"]), "mix-sources")

    keyed = flat(sized).join(sources.withColumn("shards", F.ceil(F.sqrt("docs")).cast("int")), ["none", "name"])
    order = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    keyed = keyed.withColumns({"order": order, "shard": F.pmod(F.xxhash64(order), F.col("shards")).cast("int")})
    cells = keyed.groupBy("none", "name", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_quota").alias("source_quota"))
    quotas = apportion(cells, ["none", "name"], F.col("shard"), "cell_size", "source_quota").withColumnRenamed("_name", "shard")
    cells = cells.drop("source_quota").join(quotas, ["none", "name", "shard"])

    stream = Window.partitionBy("none", "name", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("begin", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(cells, ["none", "name", "shard"])
    stop = F.least(F.col("quota") * block, epochs * F.col("cell_size"))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), stop - F.col("begin") - e * F.col("cell_size"))) for e in range(epochs)), F.lit(0))
    source = F.when(~F.col("none"), F.col("name"))
    return placed.select("doc_id", source.alias("source"), "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: a document appears once for each whole time that it is taken, then cut to the words left over.

    Exact repeats of a row share their takings as evenly as whole words allow.
    """
    p = plan(docs.select("doc_id", "source", "text"), **how).groupBy("doc_id", "source", "text_key")
    p = p.agg(F.sum("taken").alias("sum"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("sum > 0")
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("text_key"))
    rows = packed(docs).join(p, same)
    once = rows.where("n = 1").withColumn("take", F.col("sum"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "source", "text_key").orderBy(F.lit(0)))
    more = rows.where("n > 1").withColumn("take", F.floor(F.col("sum") / F.col("n")) + (rank <= F.col("sum") % F.col("n")).cast("long"))
    rows = once.unionByName(more).where("take > 0")
    rest = (F.col("take") % F.col("size")).cast("int")
    whole = F.array_repeat(F.col("row.text"), F.floor(F.col("take") / F.col("size")).cast("int"))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("text", F.explode(F.concat(whole, F.when(rest > 0, F.array(_first_words(F.col("row.text"), rest))).otherwise(none))))
    return rows.select(*fields(docs.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))


def _first_words(text: Column, n: Column) -> Column:
    """The text's first n words with the blanks between them as they stand."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    return F.rtrim(F.array_join(F.slice(pieces, 1, n), ""))
