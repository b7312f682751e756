import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from check_oracle import compare, connect
from tallygrid.llm.trie import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KINDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every prefix as a tuple of turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(first, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(inside) - 1) * words
            leaves[node[:d]] += not kids[node]
    out = set()
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if len(whole[c]) == len(node))
        out.add((
            inside[0], len(node), members[node[:-1]][0] if node else None, len(inside), kids[node], leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def trie(spark, rows, **more):
    found = prefix_trie(spark.createDataFrame(rows, KINDS), **more).select(*COLUMNS).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


def conversation(conv, *texts, roles=("user", "assistant")):
    return [(conv, k, roles[k % 2], t) for k, t in enumerate(texts)]


ODD = [
    *conversation(0, "hi there", "hello", "how are you", "fine thanks", "bye", "bye bye"),
    *conversation(1, "hi there", "hello", "how are you", "fine thanks", "bye"),
    *conversation(2, "hi there", "hello", "other"), *conversation(3, "x"), *conversation(4, "x", ""),
    *conversation(-7, "hi there", "hello"), *conversation(-20, "a", "b", "c"), *conversation(47, "no", "first", "one"),
    (5, None, None, None), (5, 3, "user", "after"), (5, None, "user", None), (6, 1, "user", " \t two  words\n"),
    (7, 1, "a", "bc"), (8, 1, "ab", "c"), (None, 1, "user", "nobody"),
    *conversation(9, *[f"turn {k} of many" for k in range(40)]), *conversation(10, *[f"turn {k} of many" for k in range(39)]),
    (11, 1, "user", "same"), (11, 1, "user", "same"), (12, 1, "user", "word " * 20_000),
    *[(100 + k, j, "user", f"copy {j}") for k in range(60) for j in range(9)],
]


@pytest.mark.parametrize("block", [1, 4])
def test_agrees_with_all_prefixes(spark, block):
    assert trie(spark, ODD, block=block) == brute(ODD)


def test_ids_far_apart_end_at_one_node(spark):
    """The list of a node is cut into ranges of ids, which come in numerical order."""
    rows = [(c, 1, "user", "same words here") for c in (3, 20_007, 9, 100_000, 5000, -3, 99_999)]
    assert trie(spark, rows) == brute(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    # Without the first of its family a conversation loses the turns it would take from it.
    short = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:5]
    rows = [(c, 1, "user", "gone") for c in short]
    got = trie(spark, rows)
    assert got == brute(rows) and len(got) == 1


def test_empty_table_and_clashing_columns(spark):
    assert trie(spark, []) == set()
    assert trie(spark, [(None, 1, "user", "x")]) == set()
    odd = spark.createDataFrame(ODD[:16], KINDS)
    names = ["depth", "a", "b", "k", "n", "rep", "words", "turns", "last", "fork", "family", "place", "chunk", "saves"]
    assert {tuple(r) for r in prefix_trie(odd.withColumns({c: F.lit("x") for c in names})).collect()} == brute(ODD[:16])


def test_query_agrees_with_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), sf_dir, "op11_prefix_trie") is None
    assert registry.queries()["op11_prefix_trie"](spark, sf_dir).columns == COLUMNS
