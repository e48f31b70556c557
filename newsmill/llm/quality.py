"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is a count taken from a row's whole text; every rule bounds a ratio of two counts. The rules are data
(`RULES`), `verdict` turns them into one boolean expression, and `measure` is one narrow projection: no shuffle, no
Python, so a lost executor costs the rerun of its own scan tasks.

Defined results: a null or empty text has no words, all counts are 0, base_failed is true and kept false. Rows are
judged one by one, so repeated rows and null ids pass through, and further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import WORD, fields, let, packed

#: Frequent function words of the corpus languages (en, fr, es, de).
STOP_WORDS = (
    "the of and to in is that it was for on with as by at be this from are have "
    "le la les de des du et un une en est que qui dans pour sur pas au "
    "el los las y del por con para se no su es lo "
    "der die das und den von zu mit ist im auf nicht ein eine dem sich"
).split()
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """least <= 100 * count / per <= most, either bound may be missing; per 1 means the bare count."""

    count: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


#: Shares are percentages, mean word length is in hundredths of a character.
RULES = (
    Rule("word_chars", "n_words", least=200, most=1500),
    Rule("n_symbols", "n_words", most=10),
    Rule("n_stop", "n_words", least=2),
    Rule("n_dup_lines", "n_lines", most=30),
)
BASE = (Rule("n_words", least=50), Rule("n_repeat_words", "n_words", most=50))


#: Up to so many different repeated windows, positions are found by looking each window up in their list.
FEW = 64


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are hashed to 64 bits; equal neighbours in the sorted hashes are the repeated ones. Their positions come
    from a lookup in that list where it is short, else from a sort of (hash, position), so no text costs more than a
    sort. A fold over the ordered positions counts the words that they cover.
    """
    pair = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    hashes = F.when(n >= 3, F.slice(F.zip_with(pair, F.slice(words, 3, n), lambda a, b: F.xxhash64(a, b)), 1, n - 2))

    def by_list(h, again):
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())

    def by_sort(h):
        def twice(s):
            return F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.sort_array(F.transform(let(placed, twice), lambda x: x["p"]))

    def covered(positions):
        zero = F.struct(F.lit(-3).alias("end"), F.lit(0).alias("n"))
        more = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))
        return F.aggregate(positions, zero, more, lambda a: a["n"])

    def count(h):
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))
        return let(again, lambda a: F.when(F.size(a) == 0, 0).when(F.size(a) <= FEW, covered(by_list(h, a))).otherwise(covered(by_sort(h))))

    return F.coalesce(let(hashes, count), F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Adds the counts that rules may use. Columns of those names are replaced; _words and _lines are dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    forms = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    split = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_lines": lines})
    words, n = F.col("_words"), F.size("_words")
    return split.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_stop": F.size(F.filter(words, lambda w: w.isin(forms))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(words, n),
    }).drop("_words", "_lines")


def verdict(rules) -> Column:
    """The rules as one expression; a ratio over nothing passes."""
    ok = F.lit(True)
    for r in rules:
        per = F.col(r.per) if r.per else F.lit(1)
        times = 100 if r.per else 1
        if r.least is not None:
            ok = ok & (times * F.col(r.count) >= r.least * per)
        if r.most is not None:
            ok = ok & (times * F.col(r.count) <= r.most * per)
    return ok


def judge(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Adds counts, base_failed and kept."""
    return measure(docs).withColumn("base_failed", ~verdict(base)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Only the rows that pass, with the columns they came with, whatever their names."""
    rows = packed(docs).withColumn("text", F.col("row.text"))
    return judge(rows, rules, base).where("kept").select(*fields(docs.columns))
