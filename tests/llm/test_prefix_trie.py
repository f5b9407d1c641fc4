"""The prefix trie against a plain one, at any size of bucket."""

import hashlib
import random
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
BIG = prefix_trie.NONE


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    """Each conversation's rebuilt turns; ``rows`` have no ties of turn and role."""
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (BIG if r[0] is None else r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(BIG if c is None else c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = 0 if c == BIG else zlib.crc32(str(c).encode()) % 4
        out[c] = [*(own.get(c - c % 20, []) if c != BIG else [])[:h], *turns[h:]]
    return out


def brute(rows):
    members = {}
    every = rebuilt(rows)
    for c, turns in every.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda path: len(path[-1][1].translate({k: 32 for k in range(9, 14)}).replace("\x20", " ").split(" ")) - path[-1][1].translate({k: 32 for k in range(9, 14)}).split(" ").count("") if path else 0
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    show = lambda c: None if c == BIG else c
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in found if len(every[c]) == len(path))
        out.append((
            show(min(found)), len(path), show(min(members[path[:-1]])) if path else None, len(found), len(children.get(path, [])), sum(1 for p in below if p not in children),
            sum((len(members[p]) - 1) * words(p) for p in below), digest(",".join("null" if c == BIG else str(c) for c in ends)),
        ))
    return sorted(out, key=str)


def got(spark, rows, **options):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    rows = []
    for c in range(90):
        kind = rng.randrange(4)
        first = ["hello there", "a  b\tc", "", "common start of many"][kind if rng.random() < 0.8 else 3]
        turns = [first] + [rng.choice(["yes", "no", "yes no", "x y z w"]) for _ in range(rng.randrange(0, 7))]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(turns)]
    for c in range(200, 230):  # copies, none of which begins like the first of its group
        rows += [(c, k, "user", t) for k, t in enumerate(["same", "same too", "same again", "and on", "to the end"])]
    rows += [(400, k, "user", f"turn {k} of a long one") for k in range(60)]
    rows += [(401, k, "user", f"turn {k} of a long one") for k in range(40)]
    rows += [(None, None, None, None), (None, 1, "user", "hello there"), (505, 0, "user", "alone"), (506, None, "user", "none first"), (506, 0, None, "then")]
    return rows


@pytest.mark.parametrize("local", [200_000, 3])
def test_nodes_are_those_of_a_plain_trie(spark, talk, local):
    assert got(spark, talk, local_turns=local, stretch=7) == brute(talk)


def test_one_conversation_and_none(spark):
    one = [(7, k, "user", f"w {k}") for k in range(5)]
    assert got(spark, one) == brute(one)
    copies = [(c, k, "user", f"w {k}") for c in (20, 40, 60) for k in range(5)]
    assert got(spark, copies, local_turns=1, stretch=2) == brute(copies)
    assert got(spark, []) == []
    turnless = [(9, 0, "user", "gone")] if zlib.crc32(b"9") % 4 else [(11, 0, "user", "gone")]
    assert got(spark, turnless) == brute(turnless)


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (20, 0, "user", "é " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rep long, digest string")
    found = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame).collect()), key=str)
    assert found == brute(rows)


sequences = st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(sequences)
def test_multikey_quicksort_emits_each_prefix_once(lists):
    own = sorted({tuple([9, *x]) for x in lists})
    found = [(k, lists.count(list(x[1:])), list(x), [t + 1 for t in x]) for k, x in enumerate(own)]
    nodes = prefix_trie.multikey_nodes(3, 77, found)
    want = {}
    for rep, copies, ids, _ in found:
        for d in range(1, len(ids) + 1):
            want.setdefault(tuple(ids[:d]), []).append((rep, copies))
    assert len(nodes) == len(want)
    by = {(n[1], n[2]): n for n in nodes}
    for path, members in want.items():
        node = by[min(r for r, _ in members), len(path) + 2]
        assert node[4] == sum(c for _, c in members)
        below = [p for p in want if p[: len(path)] == path]
        assert node[5] == sum(len(p) == len(path) + 1 for p in below)
        assert node[6] == sum(not any(q != p and q[: len(p)] == p for q in want) for p in below)
        assert node[7] == sum((sum(c for _, c in want[p]) - 1) * (p[-1] + 1) for p in below)
        assert node[8] == next((r for r, _ in members if len(found[r][2]) == len(path)), None)
