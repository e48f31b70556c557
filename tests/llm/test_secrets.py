import hashlib
import random
import re

from newsmill.llm import secrets


def brute(t):
    t = t or ""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= n]
    return sorted(out)


def text_of(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_and_table(spark):
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(40)]
    cases = [None, "", "secret:token:abcdefgh", "Password = 'x.y=z-12' é😀 api_key:\"abcdef\"", "token=token=abcdef", "AKIA" + "A" * 15, "AKIAAKIA" + "9" * 12, "a" * 100_000, "token" * 5000 + "=", "password:" + " " * 60_000]
    rows = [(i, t) for i, t in enumerate(cases)] + [(100 + i, f"x {h} y") for i, h in enumerate(hexes)] + [(None, "secret=abcdefg"), (1, "")]
    got = secrets.digest(secrets.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = sorted((str(i), hashlib.sha256(text_of(brute(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), x.base_sha256) for x in got) == want
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    found = secrets.digest(secrets.find(docs)).collect()
    for x in found:
        assert x.base_sha256 == hashlib.sha256(text_of(brute(texts[x.doc_id])).encode()).hexdigest()
    assert sum(x.n_hex for x in found) > 0
    assert secrets.digest(secrets.find(docs.limit(0))).count() == 0


def test_automaton_tells_formats_apart():
    r = random.Random(2)
    make = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    a = secrets.Automaton([make() for _ in range(200)])
    plain = secrets.Automaton(["internationalisation", "thehandthat", "ofthereading", "onlyanders"] * 20)
    assert len({id(x) for x in a.next}) and a.bits(make()) > -5 > a.bits("Hello-World_Again9")
    assert a.bits(make()) > plain.bits(make()) + 1 and plain.bits("thereading") > a.bits("thereading")


def test_added_span_of_a_bare_credential(spark):
    r = random.Random(5)
    make = lambda: "".join(r.choice("0123456789abcdef") for _ in range(18))
    rows = [(i, f"use password={make()} here") for i in range(60)] + [(1000, f"we saw {make()} lying about"), (1001, "plain words internationalisation everywhere")]
    got = {x.doc_id: x.spans for x in secrets.digest(secrets.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1000] == "assign:7:25" and got[1001] == ""


def test_all_characters_count():
    r = random.Random(6)
    make = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    a = secrets.Automaton([make(40) for _ in range(200)])
    head = make(96)
    assert a.bits(head + "/Internationalisation_Of-Words" * 20) < a.bits(head) - 2
    path = "xyzzy/lorem-ipsum/" * 6 + "1"
    assert a.bits(path + make(900)) > a.bits(path) + 2


def test_automaton_keeps_length_and_position():
    """Fixed-length credentials: their length scores better than others; a prefix that all share stays where it is."""
    r = random.Random(7)
    make = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mean = lambda a, words: sum(map(a.bits, words)) / len(words)
    for n in (105, 320):
        a = secrets.Automaton([make(32) for _ in range(n)])
        assert len(a.states()) >= 32
        own = mean(a, [make(32) for _ in range(50)])
        assert all(own > mean(a, [make(k) for _ in range(50)]) + 0.1 for k in (20, 28, 31, 33, 36, 64))
    b = secrets.Automaton(["key_" + make(24) for _ in range(200)])
    assert mean(b, ["key_" + make(24) for _ in range(20)]) > mean(b, [make(24) + "key_" for _ in range(20)]) + 0.5
    few = secrets.Automaton([make(32) for _ in range(3)])
    assert few.bits(make(32)) > few.bits("Hello-World_Again")
    assert secrets.Automaton([]).bits("anything") < 0


def test_recall_and_precision_on_planted_tokens(spark):
    """Bare tokens of the formats that labelled ones have are added; words, paths, times and names aren't."""
    r = random.Random(9)
    alnum, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    make = lambda s, n: "".join(r.choice(s) for _ in range(n))
    word = lambda n: "".join(r.choice("etaoinshrdlu") for _ in range(n))
    prose = lambda: " ".join(word(r.randint(2, 9)) for _ in range(12)) + " " + word(r.randint(12, 16))
    digits = lambda n: make("0123456789", n)
    decoys = [lambda: digits(16), lambda: f"+{digits(12)}", lambda: digits(13), lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"20{digits(2)}-1{digits(1)}-0{digits(1)}T11.{digits(2)}.00", lambda: f"{digits(3)}.{digits(3)}.{digits(2)}.{digits(3)}", lambda: f"{word(6)}-{digits(6)}/{word(5)}"]
    fake = [*decoys, lambda: f"{word(5)}/{word(6)}/{word(4)}.html", lambda: f"2024-01-{r.randint(10, 28)}T10.{r.randint(10, 59)}.00", lambda: f"{word(5)}_{word(6)}_{word(4)}", lambda: word(18), lambda: f"{word(8)}-{word(8)}"]
    rows, want = [], set()
    for i in range(200):
        rows.append((i, f"{prose()} api_key = {make(alnum, 28)} {prose()} AKIA{make('ABCDEFGHIJ0123456789', 16)} {make(hexa, 40)}"))
    for i in range(200, 500):
        head = prose() + " "
        if i % 2:
            token = make(alnum, 28) if i % 3 else make(hexa, 20)
            rows.append((i, head + token + " " + prose()))
            want.add((i, len(head), len(head) + len(token)))
        else:
            rows.append((i, head + r.choice(fake)() + " " + prose()))
    rows += [(2000 + i, f"{prose()} password = {digits(6)}{make(alnum, 22)} call +{digits(12)} pay {digits(16)}") for i in range(50)]
    got = set()
    for x in secrets.digest(secrets.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        got |= {(x.doc_id, *map(int, s.split(":")[1:])) for s in x.spans.split(",") if s and 200 <= x.doc_id < 500}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (len(got & want), len(want), len(got))


def test_added_spans_of_the_table_are_no_numbers(spark):
    """The table's own payment cards and phone numbers are not taken for secrets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = secrets.find(docs).where("size(added) > 0")
    hits = found.join(docs, "doc_id").selectExpr("explode(transform(added, s -> substr(text, s.start + 1, s.end - s.start))) as hit").collect()
    assert not [x.hit for x in hits if re.fullmatch("[0-9+/_.=-]+", x.hit)]


def test_tables_agree_with_automata():
    r = random.Random(8)
    some = [secrets.Automaton(["".join(r.choice(a) for _ in range(n)) for _ in range(80)]) for a, n in (("0123456789abcdef", 32), ("ABCxyz019", 20), ("0123456789", 16))] + [secrets.Automaton([])]
    words = ["".join(r.choice(secrets.ALPHABET) for _ in range(n)) for n in (12, 13, 40, 12, 300, 1)] + ["0" * 64]
    got = secrets.Tables(some).bits(words)
    assert all(abs(got[i, k] - a.bits(w)) < 1e-9 for i, w in enumerate(words) for k, a in enumerate(some))
    assert secrets.Tables(some).bits([]).shape == (0, 4)
