import hashlib
import random
import zlib

import numpy as np
import pytest

from newsmill.llm import merkle


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and, for each leaf, the sibling lists of its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(at):
            run = range(p // 3 * 3, min(len(nodes), p // 3 * 3 + 3))
            paths[leaf].append((p - run[0], [nodes[i] for i in run if i != p]))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def brute(rows):
    key = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, H(*map(field, row))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        groups[s].sort(key=lambda x: (key(x[0][0]), x[1]))
        subs[s] = tree([leaf for _, leaf in groups[s]])
    root, tops = tree([subs[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (row, leaf), path in zip(groups[s], subs[s][1], strict=True):
            way = path + top
            now = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = H(*map(field, (*row[:4], row[4].replace("\n", ""))))
            for i, others in way:
                now = H(*others[:i], now, *others[i:])
            out.append((row[0], leaf, subs[s][0], root, H(*(x for _, o in way for x in o)), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, root string"


def result(df):
    return sorted([tuple(x) for x in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_against_brute_force(spark, height):
    r = random.Random(height)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", "Z", "", None]), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "x\ny", "plain", "\U0001f600\n" * 50])) for i in range(140)]
    rows += [(7, "a", "en", 1, "x\ny")] * 40 + [(None, "a", None, None, None), (None, None, None, None, "t\n"), (2**60 + 1, "one", "en", 1, "l\n" * 30_000), (3, "two", "en", 3, "c"), (4, "two", "en", 3, "c")]
    docs = spark.createDataFrame([(*x, "c", 1, "d") for x in rows], SCHEMA).repartition(5)
    even = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = result(merkle.manifest(docs, even, merkle.F.regexp_replace("text", "\n", ""), height=height))
    want = brute(rows)
    assert got == want
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_small_and_empty_tables(spark):
    one = [(1, None, "en", 1, "only")]
    for rows in (one, one * 2, one + [(2, "a", None, 0, None)]):
        assert result(merkle.newlines_deleted(spark.createDataFrame([(*x, "", 0, "") for x in rows], SCHEMA))) == brute(rows)
    none = merkle.newlines_deleted(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.schema["doc_id"].dataType.simpleString() == "bigint"
    untouched = merkle.manifest(spark.createDataFrame([(*x, "", 0, "") for x in one], SCHEMA)).first()
    assert untouched.verified and untouched.leaf == untouched.root


def test_layout():
    """Every address once; each half-height subtree is contiguous; fewer pages on the way up than by levels."""
    for height in range(9):
        at = merkle.layout(height)
        assert sorted(np.concatenate(at).tolist()) == list(range(merkle.nodes_of(height + 1)))
    at = merkle.layout(7)
    for depth in (4,):
        for i in range(3**depth):
            below = np.concatenate([at[depth + k][i * 3**k : (i + 1) * 3**k] for k in range(4)])
            assert below.max() - below.min() == merkle.nodes_of(4) - 1
    at = merkle.layout(8)
    level = np.cumsum([0] + [3**d for d in range(8)])
    r = random.Random(1)
    page = lambda addresses: len({a // 128 for a in addresses})
    leaves = [r.randrange(3**8) for _ in range(200)]
    own = sum(page([at[d][i // 3 ** (8 - d)] for d in range(9)]) for i in leaves)
    plain = sum(page([level[d] + i // 3 ** (8 - d) for d in range(9)]) for i in leaves)
    assert own < 0.8 * plain


def test_block_round_trip():
    for n in (1, 2, 3, 4, 9, 10, 27, 80):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        block = merkle.Block(n, merkle.height_of(n))
        root = block.fill(leaves)
        again = merkle.Block(n, merkle.height_of(n), bytes(block.store))
        assert all(merkle.folded(leaf.hex(), merkle.decode(merkle.encode(again.siblings(i)))) == root.hex() for i, leaf in enumerate(leaves))
