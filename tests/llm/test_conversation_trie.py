"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from quaymark.llm import conversation_trie as c

SCHEMA = "conv_id long, turn long, role string, text string, one long, words string, heavy int, depth string, last int"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


def slow(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {k: [(r, t) for _, r, t in sorted(v)] for k, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        path = tuple(turns.get(conv - conv % 20, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path in members:
        own = (len(members[path]) - 1) * len(path[-1][1].encode().split()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += path not in children
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()
    )


def key(row):
    return tuple(-1 << 63 if x is None else x for x in row)


def check(found, rows):
    assert found.columns == list(c.COLUMNS)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(slow(rows), key=key)


def some_rows(rng, convs, roles=("user", "assistant", None)):
    texts = ["", None, "one", "two words", " a\tb\x0bc \r\n", "é ß 😀"]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def test_equals_all_prefixes_whatever_is_heavy(spark):
    rng = random.Random(13)
    rows = some_rows(rng, rng.sample(range(400), 250)) + [(None, 1, "user", "x"), (-3, 0, "user", "x"), (-20, 0, "user", "y")]
    for conv in range(1000, 1060):
        rows += [(conv, t, "user", f"copy {t}") for t in range(9)]
    for heavy, shard in ((1000, 50_000), (5, 40), (1, 10), (0, 7)):
        check(c.prefix_nodes(make(spark, rows), heavy, shard), rows)


def test_long_conversations_and_many_ends(spark, monkeypatch):
    rows = [(20 * i, t, "user", f"turn {t}") for i in range(3) for t in range(150)] + [(20 * i + 1, t, "user", f"turn {t}") for i in range(30) for t in range(3)]
    check(c.prefix_nodes(make(spark, rows), 2, 100), rows)
    many = spark.range(5000).selectExpr("id % 3 one", "id % 3 two", "id * 7 conv_id")
    found = {r["one"]: r["ends_sha256"] for r in c.ends_of(many).collect()}
    assert found == {k: c.digest(np.array([i * 7 for i in range(5000) if i % 3 == k])) for k in range(3)}


def test_conversations_without_turns_and_no_rows(spark):
    # 3 and 6 take all of their turns from a conversation that isn't there.
    rows = [(i, 0, "user", "hello") for i in range(1, 20)]
    assert any(zlib.crc32(str(i).encode()) % 4 > 0 for i in range(1, 20))
    check(c.prefix_nodes(make(spark, rows)), rows)
    assert c.prefix_nodes(make(spark, [])).collect() == []
    assert c.prefix_nodes(make(spark, [(None, 1, "user", "x")])).collect() == []


def test_louds_of_a_small_forest():
    #   0 - 1, 2; 2 - 3; 4
    trie = c.Trie(np.array([-1, 0, 0, 2, -1]), np.array([1, 2, 2, 3, 1]))
    assert trie.order.tolist() == [0, 4, 1, 2, 3]
    assert "".join("01"[int(b)] for b in trie.louds) == "11011000100"
    assert trie.children().tolist() == [2, 0, 0, 1, 0]
    assert trie.parents().tolist() == [-1, -1, 0, 0, 3]
    assert trie.rollup(np.array([1, 10, 100, 1000, 10000])).tolist() == [11101, 10, 100, 11000, 10000]


def test_registered_query_equals_all_prefixes(spark, sf_dir):
    from quaymark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op13_conversation_trie"](spark, sf_dir), rows)
