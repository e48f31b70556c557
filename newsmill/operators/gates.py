"""Gates that rows pass by where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a label without a dot may end in as a domain.
LABEL_ENDS = ("", ".com", ".org", ".net", ".co.uk")


def suffixes(name: Column) -> Column:
    """A domain and all that it is a subdomain of: a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def label_domains(label: Column) -> Column:
    """The names that a source's label may stand for as a domain: as it is, closed up, with hyphens, with usual endings."""
    base = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " ")), r"[^a-z0-9. -]+", "")
    closed = F.replace(base, F.lit(" "), F.lit(""))
    ends = F.when(F.contains(closed, F.lit(".")), F.array(closed)).otherwise(F.array(*[F.concat(closed, F.lit(x)) for x in LABEL_ENDS]))
    names = F.concat(F.array(base, F.replace(base, F.lit(" "), F.lit("-"))), ends)
    names = F.transform(names, lambda x: F.btrim(F.trim(x), F.lit(".")))
    return F.when(F.length(closed) > 0, F.array_distinct(F.filter(names, lambda x: x != ""))).otherwise(F.array().cast("array<string>"))


def allowlist(rows: DataFrame, domains: DataFrame, host: str, label: str | None = None, column: str = "domain") -> DataFrame:
    """Rows whose host is a listed domain or a subdomain of one, or whose label stands for one; an empty list allows all.

    Each pair of host and label is judged once, by a join of its names' suffixes with the list; rows are then looked up
    by pair. A list of nulls and blanks is empty; rows with neither host nor label pass an empty list only. Repeated rows
    stay, and so do all columns.
    """
    listed = domains.select(F.ltrim(F.lower(F.trim(column)), F.lit(".")).alias("_suffix")).where("_suffix <> ''").distinct()
    if not listed.take(1):
        return rows
    of_host = F.ltrim(F.lower(F.trim(F.coalesce(F.col(host), F.lit("")))), F.lit("."))
    of_label = F.col(label).cast("string") if label else F.lit(None).cast("string")
    pairs = rows.select(of_host.alias("_host"), of_label.alias("_label")).distinct()
    names = F.array_union(F.array("_host"), label_domains(F.col("_label")))
    good = pairs.withColumn("_suffix", F.explode(F.array_distinct(F.flatten(F.transform(names, suffixes)))))
    good = good.join(listed, "_suffix", "left_semi").select("_host", "_label").distinct()
    return rows.join(good, (of_host == F.col("_host")) & of_label.eqNullSafe(F.col("_label")), "left_semi")
