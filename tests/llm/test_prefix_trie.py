"""Prefix trie against a plain version."""

import hashlib
import random
import re
import zlib

import pytest

from scribegauge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + ts[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole)))

    def words(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text))

    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(not any(len(m) > len(n) and m[: len(n)] == n for m in below) for n in below)
        gained = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c, size in who if size == len(node))))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in who), len(node), parent, len(who), len(kids), leaves, gained, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    found = prefix_trie.conversation_trie(frame).select(*FIELDS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain(rows)))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for turn in range(rng.choice((0, 1, 2, 3, 4, 7, 12))):
            rows.append((c, turn, rng.choice(("user", "assistant", None)), rng.choice(("a b", "c", "", None, "d  e\tf"))))
    copied = [(turn, "user", f"t {turn % 3}") for turn in range(9)]
    rows += [(c, *t) for c in (100, 120, 140, 161, 4000, 9000) for t in copied]
    rows += [(c, *t) for c in (180, 200) for t in [*copied, (9, "user", "other")]]
    rows += [(c, None, "user", "late"), (c, None, "user", "late"), (c, 1, "user", "x"), (c, 1, "user", "y"), (None, 0, "user", "nobody")]
    monkeypatch.setattr(prefix_trie, "FIRST_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "TURNS", 3)
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 5)
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", "a"), (7, 1, "user", None)], [(41, 0, None, None)], [(20, i, "user", "w") for i in range(150)], [(c, 0, "user", "same") for c in (20, 40, 60)]])
def test_few_conversations(spark, rows):
    check(spark, rows)
