"""From raw documents to a sharded training mix: five stages, each written as Parquet and read again by the next.

Quality rules drop what they reject; of each near-duplicate group (5-word shingles, similarity of 80 %) one
document stays; documents that share a passage with the benchmark go; the rest is mixed to the target weights, which
repeats documents or cuts them; the mix is dealt into shards. All stages but the last return the columns of documents;
the last returns them with size, text_crc32, law, shard, slot and grown_shard, a row for each copy in the mix.

Null texts count as empty and fail the quality rules, as empty texts do; null ids and repeated rows go through: of equal
documents the near-duplicate stage keeps one, one without id only where none has one; an empty table gives an empty
result; other columns of documents pass through all stages, unless they have the name of a result.
"""

from __future__ import annotations

from newsmill.llm import decontaminate, jaccard, mixing, quality, sharding
from newsmill.llm.common import stage, table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    return jaccard.keep_one(docs, width=5, percent=80)


def decontamination(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def shards(spark, docs, sf_dir):
    return sharding.shard(docs, carry=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", shards),
]

#: Apportionment by ranked quotients over hash shards isn't stated in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


