"""The prefix trie against brute force: nulls, repeated rows, long and turnless conversations, many small ranges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from vitalweave.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, key string, part int"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn, digest, role, text))
    own = {c: [x[3:] for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    found = {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves = sum(found[x][5] for x in children[prefix]) or 1
        saved = sum(found[x][6] for x in children[prefix]) + ((len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0)
        ends = ",".join(str(c) for c in sorted(members[prefix]) if len(made[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        found[prefix] = (min(members[prefix]), len(prefix), parent, len(members[prefix]), len(children[prefix]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(found.values())


def some_rows():
    draw = random.Random(2)
    rows = []
    for c in range(120):
        if c % 7 == 3:
            continue
        for turn in range(draw.choice([1, 2, 3, 5, 12])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", draw.choice(["a", "é", "hello"]), "k", 1))
    rows += [(200, t, "user", f"long {t}", "k", 1) for t in range(400)]
    rows += [(None, 0, "user", "no id", None, None), (300, None, None, None, None, None), (300, None, "user", None, None, None)]
    rows += [(305, 1, "user", "same", "k", 1)] * 20 + [(311, 0, "user", "x" * 100_000, "k", 1), (3, 0, "user", "short", "k", 1)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("task_nodes, task_links", [(prefix_trie.TASK_NODES, prefix_trie.TASK_LINKS), (40, 1000), (40, 5)])
def test_trie_is_brute_force(spark, task_nodes, task_links):
    rows = some_rows()
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, ROWS).repartition(6), task_nodes=task_nodes, task_links=task_links).collect()
    assert sorted(tuple(r)[:8] for r in found) == brute(rows)
    # The places are one tour: every arc once, a subtree's arcs between the two of its node.
    assert sorted([r.enter for r in found] + [r.exit for r in found]) == list(range(1, 2 * len(found) + 1))
    by_name = {(r.conv_id, r.depth): r for r in found}
    for r in found:
        if r.depth:
            above = by_name[r.parent_conv_id, r.depth - 1]
            assert above.enter > r.enter > r.exit > above.exit


def test_lists_are_ranked():
    draw = random.Random(1)
    order = list(range(50))
    draw.shuffle(order)
    follows = np.full(50, -1)
    for a, b in zip(order[:30], order[1:30]):
        follows[a] = b
    sums, tail = prefix_trie.ranked(follows, np.ones((1, 50), np.int64))
    assert [sums[0, x] for x in order[:30]] == list(range(30, 0, -1)) and {tail[x] for x in order[:30]} == {order[29]}
    assert all(sums[0, x] == 1 and tail[x] == x for x in order[30:])


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", 1)], ROWS)).count() == 0
