"""Personal data by weak supervision, in DataFrame functions only.

Labelers vote yes, no or nothing on every candidate span, strict or loose:

- regex: how well formed the span is: yes for a strict format written out in full, no for a sloppy one;
- gazetteer: top-level domains, address blocks, card issuers with their lengths, calling and area codes;
- check: Luhn's digit, octets, the local part of an address, the plan of a national phone number;
- context: cue words shortly before the span, or words that speak against it;
- border: whether the span ends at blanks and punctuation, or goes on in a word.

No labeler sees whether a span is a base span. Expectation-maximisation over the counts of vote patterns (at most 4
kinds x 2 forms x 3^5 patterns, whatever the corpus) estimates how reliable each labeler is, with a share of true
spans for each kind and form; the check labeler starts out as the most trusted, as a check digit is rarely wrong. The
posteriors of the patterns train a logistic span classifier, which is then one SQL expression over the votes. The
corpus is read once: candidates are staged without the texts, pattern counts and final spans come from that narrow table.

Base spans (strict formats) always stay; the classifier adds candidates of looser formats that no base span of their
kind overlaps. Defined results: null and empty texts have no spans; rows are handled one by one, so repeated rows and
null ids keep one result row each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import located, stage

KINDS = ("email", "ip", "card", "phone")
VOTERS = ("regex", "gazetteer", "check", "context", "border")
ABSTAIN, YES, NO = 0, 1, 2
#: The classifier adds a candidate from this probability on.
ACCEPT = 0.8

# Formats. Runs start at their first character or where the last match ended, and possessive groups
# don't backtrack, so each pattern takes linear time and matches what its plain form matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": CARD,
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}
#: Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io dev app de fr es it uk us ca au ch at nl be pl ru cn jp in br eu".split()
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|62[0-9]{14,17}|(?:50|5[6-8]|6[0-9])[0-9]{10,17})$"
#: Area codes and exchanges of the North American plan.
NATIONAL = r"^[2-9][0-8][0-9][2-9][0-9]{6}$"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write to|kontakt|correo|courriel|adresse)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|from|gateway)\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|payment)(?:\s*(?:number|no|nr|num))?\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|telefon|fon|cell|whatsapp)\W*$",
}
ANTI_CUES = r"(?i)(?:version|isbn|issn|order|invoice|serial|article|section|\bv)\W*$"
#: Characters before a span that a context labeler sees.
REACH = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of 13 to 19 digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def strict(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's format passes its check."""
    n = F.length(_digits(hit))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(ABSTAIN)


def _votes(kind: str, text: Column, s: Column, base: bool) -> list[Column]:
    """One vote of each labeler; base only says which format matched, strict or loose."""
    hit, digits, never = s["hit"], _digits(s["hit"]), F.lit(False)
    begin = F.greatest(s["start"] - REACH, F.lit(0))
    before = F.substr(text, begin + 1, s["start"] - begin)
    left, right = F.substr(before, F.length(before), F.lit(1)), F.substr(text, s["end"] + 1, F.lit(1))
    if kind == "email":
        last = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
        local = F.regexp_extract(hit, r"^([A-Za-z0-9._%+-]+)", 1)
        odd, bad = hit.rlike(r"^\.|\.\.|-\.|\.-"), local.rlike(r"^[.%+-]|\.\.|\.$")
        regex = _vote(~odd & (last.rlike("^[a-z]{2,}$") if base else hit.rlike(r"(?i)[(\[]dot[)\]]")), odd)
        gaz = _vote(last.isin(TOP_DOMAINS), ~last.rlike("^[a-z]{2,6}$") if base else F.lit(True))
        check = _vote(never, bad)
    elif kind == "ip":
        first = F.regexp_extract(hit, "^0*([0-9]+)", 1)
        if base:
            regex = _vote(~hit.rlike(r"(?:^|\.)0[0-9]"), never)
            gaz = _vote(first.isin([str(i) for i in (*range(1, 127), *range(128, 224))]), first.isin("0", *[str(i) for i in range(240, 256)]))
            check = _vote(strict("ip", hit), ~strict("ip", hit))
        else:  # eight groups of hex digits: blocks in use start with 2, 3, fc, fd, fe8
            regex = _vote(hit.rlike("^(?:[0-9A-F:]+|[0-9a-f:]+)$"), hit.rlike("[a-f].*[A-F]|[A-F].*[a-f]"))
            gaz = _vote(hit.rlike("^(?i)(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):"), F.lit(True))
            check = _vote(hit.rlike("[A-Fa-f]"), hit.rlike("^[0-9]{1,2}(?::[0-9]{1,2}){7}$"))
    elif kind == "card":
        regex = _vote(hit.rlike(r"^(?:[0-9]+|[0-9]{4}(?:\x20[0-9]{4}){2,3}(?:\x20[0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2,3}(?:-[0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"), hit.rlike(r"\x20.*-|-.*\x20"))
        gaz = _vote(digits.rlike(ISSUERS), F.lit(True))
        check = _vote(_luhn(digits), F.lit(True))
    else:
        regex = _vote(hit.rlike(r"^\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,4}$|^(?:\([0-9]{3}\)\x20?|[0-9]{3}-)[0-9]{3}-[0-9]{4}$"), hit.rlike(r"[.-]{2}|\(\)|\x20{2}"))
        gaz = _vote(hit.rlike(CALLING_CODES) | digits.rlike("^[2-9][0-8][0-9]") & ~hit.startswith("+"), F.lit(True))
        check = _vote(F.when(hit.startswith("+"), F.length(digits).between(10, 14)).otherwise(digits.rlike(NATIONAL)), ~hit.startswith("+"))
    context = _vote(before.rlike(CUES[kind]), before.rlike(ANTI_CUES))
    border = _vote(left.rlike(r"^[\s(\[<\"',;:]?$") & right.rlike(r"^[\s)\]>\"',;:.!?]?$"), left.rlike(r"\w") | right.rlike(r"\w"))
    return [regex, gaz, check, context, border]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands, an array of (kind, start, end, base, one vote for each voter), in order of kind and start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,part:string>>)")
    gates = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"\+[0-9]")}
    loose_gates = {"email": text.rlike(r"[(\[]\x20?(?:at|AT)\x20?[)\]]"), "ip": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "card": gates["card"], "phone": text.rlike(r"[0-9]{3}[-.][0-9]{4}")}
    found = docs.select("doc_id", text.alias("text"), *[F.when(gates[k], located(text, p)).otherwise(none).alias(k) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)], *[F.when(loose_gates[k], located(text, LOOSE[k])).otherwise(none).alias(f"loose_{k}") for k in KINDS if k != "card"])
    parts = []
    for i, k in enumerate(KINDS):
        ok = F.filter(F.col(k), lambda s: strict(k, s["hit"]))
        parts.append(F.transform(ok, lambda s: _cand(i, k, s, True)))
        if k == "card":  # digits that fail the check are candidates where the context speaks of cards
            wide = F.filter(F.col(k), lambda s: ~strict("card", s["hit"]) & F.length(_digits(s["hit"])).between(13, 19))
            wide = F.filter(wide, lambda s: F.substr(F.col("text"), F.greatest(s["start"] - REACH, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH))).rlike(CUES["card"]))
        else:
            wide = F.col(f"loose_{k}")
        wide = F.filter(wide, lambda s: ~F.exists(ok, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        parts.append(F.transform(wide, lambda s: _cand(i, k, s, False)))
    return found.select("doc_id", F.array_sort(F.concat(*parts)).alias("cands"))


def _cand(i: int, kind: str, s: Column, base: bool) -> Column:
    votes = zip(VOTERS, _votes(kind, F.col("text"), s, base), strict=True)  # base is kept for the result and the form
    return F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), *[v.cast("int").alias(n) for n, v in votes])


#: What a labeler's reliability is worth in votes before any are counted: (right, wrong or nothing). A true number
#: fails its check once in two thousand times.
TRUST = {"check": (1000.0, 0.5)}


def estimate(counts: list[tuple], rounds: int = 50) -> tuple[dict, list]:
    """EM over (kind, form, votes..., n) rows: reliabilities P(vote | truth) by voter, and (pattern, posterior, n)."""
    start = {(j, y): {v: TRUST.get(name, (5.0, 1.0))[v != y] for v in (ABSTAIN, YES, NO)} for j, name in enumerate(VOTERS) for y in (YES, NO)}
    rel = {(j, y, v): m / sum(mass.values()) for (j, y), mass in start.items() for v, m in mass.items()}
    groups = {tuple(c[:2]) for c in counts}
    prior = dict.fromkeys(groups, 0.5)
    post = []
    for _ in range(rounds):
        post = []
        for kind, form, *votes, n in counts:
            like = {y: (prior[kind, form] if y == YES else 1 - prior[kind, form]) * math.prod(rel[j, y, v] for j, v in enumerate(votes)) for y in (YES, NO)}
            post.append(((kind, form, *votes), like[YES] / (like[YES] + like[NO]), n))
        for g in groups:
            own = [(p, n) for (kind, form, *_), p, n in post if (kind, form) == g]
            prior[g] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for (j, y), first in start.items():
            mass = dict(first)
            for (_, _, *votes), p, n in post:
                mass[votes[j]] += n * (p if y == YES else 1 - p)
            rel |= {(j, y, v): m / sum(mass.values()) for v, m in mass.items()}
    return rel, post


def train(post: list, steps: int = 300, rate: float = 0.5) -> dict:
    """Logistic regression on one-hot votes, kinds and forms with the posteriors as soft labels; patterns weigh by log count."""
    weights: dict = {"bias": 0.0}
    rows = [(["bias", ("kind", 2 * k + form), *[(j, v) for j, v in enumerate(votes)]], p, math.log1p(n)) for (k, form, *votes), p, n in post]
    total = sum(w for *_, w in rows) or 1.0
    for _ in range(steps):
        grad: dict = {}
        for feats, p, w in rows:
            err = w * (p - 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in feats))))
            for f in feats:
                grad[f] = grad.get(f, 0.0) + err / total
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) + rate * g
    return weights


def _probability(weights: dict, c: Column) -> Column:
    """The classifier as an expression over one candidate; an unseen vote adds nothing."""
    terms = [F.lit(weights["bias"])]
    for f, w in weights.items():
        if f != "bias":
            got = 2 * c["kind"] + c["base"].cast("int") if f[0] == "kind" else c[VOTERS[f[0]]]
            terms.append(F.when(got == f[1], F.lit(w)).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base, probability), for every row of docs."""
    cands = stage(candidates(docs), "pii")
    votes = cands.select(F.explode("cands").alias("c")).groupBy("c.kind", F.col("c.base").cast("int").alias("form"), *[F.col(f"c.{v}") for v in VOTERS]).count()
    weights = train(estimate(sorted(tuple(r) for r in votes.collect()))[1])  # at most 4 * 2 * 243 rows
    scored = F.transform("cands", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), _probability(weights, c).alias("probability")))
    return cands.select("doc_id", F.filter(scored, lambda c: c["base"] | (c["probability"] >= accept)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of spans for each row."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])
    counts = [F.size(F.filter(base, lambda c: c["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
