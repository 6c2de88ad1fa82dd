"""The trie of conversations against a plain one, whole and cut into tiny pieces."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeline.llm import conversation_trie as trie
from lodeline.llm.conversation_trie import RadixTree, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(some)] for c, some in own.items()}
    new = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        new[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * n + sum(saved[k] for k in kids[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(new[c]) == len(node))
        out.append(
            (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]),
             leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        )
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    turns = [(f"r{k % 3}" if k % 11 else None, f"text {k} " * (k % 5) if k % 7 else None) for k in range(40)]
    out, old = [], []
    for c in range(-30, 260):
        if c % 6 == 5 and rng.random() < 0.5:
            continue
        start = old[rng.integers(len(old))][: rng.integers(0, 9)] if old and rng.random() < 0.7 else []
        conv = [*start, *(turns[k] for k in rng.integers(0, 40, rng.integers(0 if start else 1, 7)))]
        if not conv:
            conv = [turns[1]]
        old.append(conv)
        out += [(c, t if t else None, *x, "x", 1) for t, x in enumerate(conv)]
    long = [turns[k] for k in rng.integers(0, 40, 700)]
    out += [(c, t, *x, "x", 1) for c, n in ((300, 700), (301, 700), (303, 650), (305, 300)) for t, x in enumerate(long[:n])]
    out += [(c, t, *long[t], "x", 1) for c in range(400, 520) for t in range(5)]  # copies
    return [*out, out[3], out[3], (None, 1, "user", "no conversation", "x", 1), (900, None, None, None, None, None), (900, None, "", "", None, None), (901, 3, "r1", "x" * 100_000, None, None)]


@pytest.mark.parametrize(("piece", "tree", "block", "segment"), [(512, 1 << 22, 4096, 4096), (3, 600, 4, 7)])
def test_equals_plain(spark, rows, piece, tree, block, segment, monkeypatch):
    for name, value in (("PIECE", piece), ("TREE", tree), ("BLOCK", block), ("SEGMENT", segment)):
        monkeypatch.setattr(trie, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert Counter(map(tuple, conversation_trie(df).collect())) == plain(rows)


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [3, 40, 200, 256])
def test_radix_tree_keeps_every_prefix(width):
    """Nodes of every layout, keys that end inside others, repeated keys."""
    rng = np.random.default_rng(width)
    keys = [bytes(rng.integers(0, width, rng.integers(1, 6), dtype=np.uint8)) for _ in range(3000)] + [bytes([b]) for b in range(width)]
    tree = RadixTree()
    for k, key in enumerate(keys):
        tree.insert(key, key, k, (1, k))
    found = {}
    for begin, node, end in tree.nodes():
        assert node.example[begin:end] == node.path and node.size in (4, 16, 48, 256)
        assert len(node.children()) <= node.size and (node.size == 4 or len(node.children()) > {16: 4, 48: 16, 256: 48}[node.size])
        for n in range(begin + 1, end + 1):
            found[node.example[:n]] = (node.low, *node.sums)
    wanted = {key[:n] for key in keys for n in range(1, len(key) + 1)}
    assert found.keys() == wanted
    for prefix in list(wanted)[:500]:
        held = [k for k, key in enumerate(keys) if key.startswith(prefix)]
        assert found[prefix] == (min(held), len(held), sum(held))
    assert {n.size for _, n, _ in tree.nodes()} | {tree.root.size} >= ({4} if width == 3 else {4, 16} if width == 40 else {4, 16, 256})
