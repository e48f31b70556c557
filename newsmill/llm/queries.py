"""The corpus queries and, where SQL can state them, the same in DuckDB's SQL."""

from __future__ import annotations

from newsmill.llm import decontaminate, jaccard, licenses, merkle, mixing, pii, quality, secrets, sharding, templates, urls, variants, warc
from newsmill.llm.common import table


def op1_secrets(spark, sf_dir):
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_templates(spark, sf_dir):
    return templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_mixing(spark, sf_dir):
    plan = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_variants(spark, sf_dir):
    return variants.group(variants.words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_merkle(spark, sf_dir):
    return merkle.newlines_deleted(table(spark, sf_dir, "documents").select(*merkle.LEAF))


def op13_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark), urls.named_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality.STOP_WORDS)
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest(range(0, 3)) AS u(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
c AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_stop, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
  AND 100 * n_stop >= 2 * n_words AND 100 * n_dup_lines <= 30 * n_lines AS kept
FROM b"""

#: DuckDB's ASCII lower-casing of A-Z alone.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (
  SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM b, unnest(range(1, len(w) - k + 2)) AS u(i)),
lens AS (SELECT DISTINCT k FROM b),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM d, lens, unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT doc_id, i, k, item_id FROM g JOIN wins USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS u(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) > 2
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""

#: crc32 of a list of bytes: a table of 256 remainders made by rule, then a fold.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS r(i)))"""
_CRC = "xor(list_reduce(list_concat([4294967295], {}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
_ORD = "list_transform(string_split({}, ''), lambda x: ord(x))"

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, {_LOW.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
codes AS (SELECT run, k, {_ORD.format("doc_id::VARCHAR || ':' || run")} AS cp FROM r),
h AS (
  SELECT run, k, {_CRC.format("flatten(list_transform(cp, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END))")} AS h
  FROM codes, crc),
v AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut AS c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut AS c JOIN v ON c.rest = v.word),
near AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY v.n DESC, encode(b)) AS best, max(v.n) AS best_n
  FROM pairs JOIN v ON v.word = b GROUP BY a),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
    CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS pos, 0 AS d FROM f UNION ALL SELECT walk.word, f.form, d + 1 FROM walk JOIN f ON f.word = walk.pos WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(pos, d) AS root FROM walk GROUP BY word) AS w USING (word)"""


def _tree_sql(nodes: str, levels: int, tag: str) -> str:
    """Levels of all trees above a table (tree, pos, d), each node with the digests left and right of it in its run."""
    out, below = [], nodes
    for k in range(levels):
        run = "OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {})"
        left, right = run.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
        out.append(f"""{tag}{k} AS (
  SELECT tree, pos, d, size, coalesce(string_agg(d, '') {left}, '') AS l, coalesce(string_agg(d, '') {right}, '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {below}) WHERE size > 1)""")
        out.append(f"{tag}{k}up AS (SELECT tree, pos // 3 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {tag}{k} GROUP BY tree, pos // 3)")
        below = f"{tag}{k}up"
    # the root of a tree is the one node that stands alone on its level
    tops = " UNION ALL ".join(f"SELECT tree, any_value(d) AS d FROM {t} GROUP BY tree HAVING count(*) = 1" for t in [nodes, *[f"{tag}{k}up" for k in range(levels)]])
    return ",\n".join([*out, f"{tag}roots AS ({tops})"])


def _fold_sql(rows: str, pos: str, tree: str, levels: int, tag: str) -> list[str]:
    """CTEs that lead rows (with columns acc and proof) up through a tree's levels."""
    out, below = [], rows
    for k in range(levels):
        out.append(f"""{tag}walk{k} AS (
  SELECT b.* REPLACE (CASE WHEN x.d IS NULL THEN acc ELSE sha256(x.l || acc || x.r) END AS acc, proof || coalesce(x.l || x.r, '') AS proof)
  FROM {below} AS b LEFT JOIN {tag}{k} AS x ON x.tree = b.{tree} AND x.pos = b.{pos} // {3**k})""")
        below = f"{tag}walk{k}"
    return out


def _merkle_sql(deep: int = 9, top: int = 4) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    first = f"""{_CRC_TABLE},
t AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS d, {leaf("replace(text, chr(10), '')")} AS other,
    {_CRC.format(_ORD.format("doc_id::VARCHAR"))} % 2 = 0 AS changed FROM documents, crc),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM t)"""
    top_nodes = "tops AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, d FROM s_roots)"
    begin = "w AS (SELECT n.*, tops.pos AS top_at, '' AS top_tree, tops.d AS subroot, CASE WHEN changed THEN other ELSE n.d END AS acc, '' AS proof FROM n JOIN tops ON tops.source = n.tree)"
    parts = [first, _tree_sql("n", deep, "s_"), top_nodes, _tree_sql("tops", top, "t_"), begin, *_fold_sql("w", "pos", "tree", deep, "s_"), *_fold_sql(f"s_walk{deep - 1}", "top_at", "top_tree", top, "t_")]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, x.d AS leaf, subroot, t_roots.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t_roots.d AS verified
FROM t_walk{top - 1} AS x, t_roots"""


OP12_SQL = _merkle_sql()

_NAMED = ", ".join(f"'{x}'" for x in urls.LISTED_NAMES)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
OP13_SQL = f"""
WITH rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM rest),
bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), CASE WHEN lower(substr(url, 1, 6)) = 'https:' THEN ':443$' ELSE ':80$' END, '') AS h,
    array_to_string(list_sort(list_filter(string_split(query, '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:{"|".join(urls.TRACKING)})(?:=|$)'))), '&') AS q FROM p),
c AS (
  SELECT page_id, host, path, CASE WHEN starts_with(h, 'www.') AND length(h) > 4 THEN substr(h, 5) ELSE h END
    || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS named FROM bare),
listed AS (SELECT DISTINCT named FROM c WHERE list_has_any(string_split(host, '.'), [{_NAMED}])),
rules(h, p, v) AS (VALUES {_RULES}),
fits AS (
  SELECT DISTINCT c.host, c.path, first(h || p ORDER BY length(h || p) DESC) AS rule, first(v ORDER BY length(h || p) DESC) AS v
  FROM (SELECT DISTINCT host, path FROM c) AS c JOIN rules ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p) GROUP BY c.host, c.path)
SELECT page_id, c.host, c.path, rule, coalesce(v, CASE WHEN listed.named IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits ON fits.host = c.host AND fits.path = c.path LEFT JOIN listed ON listed.named = c.named"""

QUERIES = {"op1_secrets": op1_secrets, "op2_warc": op2_warc, "op3_templates": op3_templates, "op4_pii": op4_pii, "op5_mixing": op5_mixing, "op6_jaccard": op6_jaccard, "op7_quality": op7_quality, "op8_decontaminate": op8_decontaminate, "op9_sharding": op9_sharding, "op10_licenses": op10_licenses, "op11_variants": op11_variants, "op12_merkle": op12_merkle, "op13_urls": op13_urls, "pipeline": pipeline}
ORACLES = {"op6_jaccard": OP6_SQL, "op7_quality": OP7_SQL, "op8_decontaminate": OP8_SQL, "op11_variants": OP11_SQL, "op12_merkle": OP12_SQL, "op13_urls": OP13_SQL}
