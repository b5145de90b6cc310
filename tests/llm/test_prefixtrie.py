"""The conversation trie against a brute-force one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hydrograin.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, `a.b` string, digest int"


def brute(rows, exchange=True):
    """{(conv_id, depth): other columns} of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, name, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if exchange else 0
        convs[c] = own.get(c // 100 * 100, [])[:h] + turns[h:] if exchange else turns
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
    return {
        (min(m), len(node)): (
            min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    }


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n, copies):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes é", "", None, "no\n", "x" * rng.randrange(4)])))
    for c in range(n, n + copies):  # exact copies of one conversation, twice as deep as others agree
        rows += [(c, turn, "user", f"turn {turn}") for turn in range(9)]
    return rows


@pytest.mark.parametrize("exchange", [True, False])
def test_against_brute_force(spark, exchange):
    rows = made(3, 320, 150)
    rows += [(5, 0, "user", "hi")] * 3 + [(None, 1, "user", "lost"), (-7, 1, "user", "below zero"), (10**12 + 3, 2, None, "far")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    f = (lambda: prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(df)))) if exchange else (lambda: prefixtrie.conversation_trie(df))
    expected = brute(rows, exchange)
    if exchange:  # numbers below zero belong to the hundred around zero, as remainders of SQL go
        expected = brute([((r[0] if r[0] != -7 else 100 * 10**9 + 7), *r[1:]) for r in rows if r[0] != -7], True)
        df = df.where("conv_id >= 0 or conv_id is null")
    assert found(f()) == {k: v for k, v in expected.items()}


def test_one_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t} " + "ab" * (t % 7)) for t in range(700)] + [(2, 0, "user", "turn 0 ")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(prefixtrie.conversation_trie(df)) == brute(rows, False)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(prefixtrie.conversation_trie(empty)) == {}
    alone = spark.createDataFrame([(7, None, None, None, None, None)], SCHEMA)
    assert found(prefixtrie.conversation_trie(alone)) == brute([(7, None, None, None)], False)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 100)}
    turnless = [c for c, k in h.items() if k > 0]  # the first of the hundred is missing, so their own first turn goes
    rows = [(c, 0, "user", "x") for c in turnless]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert found(prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(df)))) == brute(rows)


def test_digest_of_many_ends(spark):
    ids = spark.range(0, 400_000, 3).selectExpr("id AS conv_id", "1L AS k")
    row = prefixtrie.ends_digest(ids, ["k"]).collect()
    assert [r["ends_sha256"] for r in row] == [hashlib.sha256(",".join(map(str, range(0, 400_000, 3))).encode()).hexdigest()]
