"""Exact dedup and SimHash against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, exact_dedup, simhash
from tidemark.llm.common import components

DOCS = "doc_id long, text string, lang string, digest string, repeats string, fp string, whole string, _gone string, _ID string, Score string"
#: Extra columns are named as the operators name theirs.
EXTRA = ("en", "d", "r", "f", "w", "g", "i", "s")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)


ROWS = [
    (5, "a b  c"), (3, "a b c"), (9, "a\tb\nc"), (4, "other"), (4, "other"), (7, None), (8, ""), (None, "a b c"), (None, "only null id"),
    (None, "only null id"), (11, " "), (12, "  \n"), (13, "unique text"), (14, "long " * 60_000), (15, "long " * 60_000 + "x"), (2, "long " * 60_000),
]


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, first = [], set()
    for (i, _), n in sorted(zip(rows, norm, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        kept = i == keep and n not in first
        if kept:
            first.add(n)
        out.append((i, keep, len(ids), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_decisions_equal_brute_force(spark):
    got = exact_dedup.decide(docs(spark, ROWS))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(ROWS)


def test_a_full_filter_changes_nothing(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    got = exact_dedup.decide(docs(spark, rows), bits_per_row=0, broadcast_words=0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(300)]
    got = exact_dedup.decide(docs(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows)


def test_exact_rows_stay_whole(spark):
    got = exact_dedup.deduplicated(docs(spark, ROWS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = sorted(((i, t) for i, t in {(r[0], r[4]): (i, t) for r in brute_exact(ROWS) if r[3] for i, t in ROWS if i == r[0] and hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() == r[4]}.values()), key=str)
    assert kept == want
    assert got.first().lang == "en"


def test_columns_of_any_type_stay(spark):
    rows = [(2, "a b", {"k": "v"}, [1]), (1, "a  b", {"k": "w"}, None), (1, "a\tb", None, [2]), (3, "c", {}, [])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>, list array<int>")
    got = exact_dedup.deduplicated(frame)
    assert got.schema == frame.schema and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_only_what_repeats_goes_through_the_filter(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(if(id % 100 < 5, id % 100, id)) as h")
    flagged = exact_dedup.may_repeat(rows, rows, rows.count(), bits_per_row=64, broadcast_words=1 << 20)
    assert 1000 <= flagged.where("repeats").count() < 1100


@pytest.mark.parametrize("words", [1, 7, 400, 100_000])
def test_every_hash_that_comes_twice_has_its_bits_in_the_filter(spark, words):
    # hashes that come once to four times, in words that are crowded, shared and empty
    hashes = spark.range(2000).selectExpr("xxhash64(id) as h", "id % 4 + 1 as n").selectExpr("h", "explode(sequence(1, n))").select("h")
    found = {r.word: r.twice for r in exact_dedup.bloom_filter(hashes, words).collect()}
    every = hashes.select("h", exact_dedup._word(words).alias("word"), exact_dedup._bits().alias("bits")).collect()
    count, bits = {}, {}
    for r in every:
        count[r.h] = count.get(r.h, 0) + 1
        bits.setdefault(r.word, []).append(r.bits)
    assert all(found.get(r.word, 0) & r.bits == r.bits for r in every if count[r.h] > 1)
    for word, of in bits.items():
        sets = [sum(b >> k & 1 for b in of) for k in range(64)]
        again = sum(1 << k for k, n in enumerate(sets) if n > 1)
        want = sum(1 << k for k, n in enumerate(sets) if n) if max(sets) > 2 else again
        assert found.get(word, 0) % 2**64 == want


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    frame = docs(spark, [(i, "same words here" if i % 3 == 0 else f"text number {i} of many") for i in range(2, 62)] + [(1, None), (0, "")])
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert len(got) == 62 and all(got[i][1] == 3 for i in range(3, 62, 3)) and got[1] == got[0] == (0, 0)


@pytest.mark.parametrize("bits", [1, 2, 5, 6])
def test_other_numbers_of_bits(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 25, dtype=np.uint64)
    flips = [base]
    for n in range(1, bits + 2):
        x = base.copy()
        for _ in range(n):
            x ^= np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)
        flips.append(x)
    keys = np.unique(np.concatenate(flips))
    prints = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    for heavy in (None, 2):
        roots = {r.node: r.root for r in components(simhash.near_links(prints, bits=bits, heavy=heavy, chunk_rows=40)).collect()}
        got = [roots.get(int(k), int(k)) for k in keys.view(np.int64)]
        want = brute_classes(keys, bits)
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


@pytest.mark.parametrize("make", [exact_dedup.decide, exact_dedup.deduplicated, simhash.near_duplicates, simhash.one_of_each])
def test_empty_tables(spark, make):
    assert make(docs(spark, [])).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One Two", "a b c d e f", "É é É x", "a b c a b c a b c", "x" * 5000, "A\x0bB\x0cC\x1cD e f"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000)) + "  end"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(common, "BLOCK_BYTES", 97)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def brute_classes(keys, budget=3):
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if int(keys[i] ^ keys[j]).bit_count() <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_trie_finds_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    keys = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3)]]))
    a, b = simhash.trie_pairs(keys, keys.view(np.int64), 0, most=50)
    label = {int(k): i for i, k in enumerate(keys.view(np.int64))}
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(label[x]), root(label[y])
        parent[max(p, q)] = min(p, q)
    assert [root(i) for i in range(len(keys))] == brute_classes(keys)


def test_a_dense_ball_gives_few_links():
    center = np.uint64(0x0123456789ABCDEF)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    keys = np.unique(np.concatenate([[center], center ^ bits, (center ^ bits[:, None] ^ bits[None, :]).ravel()]))
    a, _ = simhash.trie_pairs(keys, keys.view(np.int64), 0)
    assert len(a) == len(keys) - 1


@pytest.mark.parametrize("heavy", [None, 3])
def test_near_links_on_spark(spark, heavy):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [base]
    for n in (1, 2, 3, 4):
        x = base.copy()
        for _ in range(n):
            x ^= np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)
        flips.append(x)
    keys = np.unique(np.concatenate(flips))
    prints = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    found = components(simhash.near_links(prints, heavy=heavy, chunk_rows=30))
    roots = {r.node: r.root for r in found.collect()}
    got = [roots.get(int(k), int(k)) for k in keys.view(np.int64)]
    want = brute_classes(keys)
    assert {(g, w) for g, w in zip(got, want, strict=True)} and len(set(got)) == len(set(want)) == len({(g, w) for g, w in zip(got, want, strict=True)})


def test_crowded_subtrees_are_cut_to_the_last_level(spark):
    center = 0x0123456789ABCDEF
    low = [1 << b for b in range(27)]
    ball = {center} | {center ^ a for a in low} | {center ^ a ^ b for a in low for b in low if a != b}
    apart = {center ^ (0x1F << 40), 17}
    prints = spark.createDataFrame([(k,) for k in sorted(ball | apart)], "fp long")
    links = simhash.near_links(prints, heavy=2, chunk_rows=50).cache()
    roots = {r.node: r.root for r in components(links).collect()}
    assert set(roots) == ball and set(roots.values()) == {min(ball)}
    assert all(int(a ^ b).bit_count() <= 6 for a, b in links.collect())
    links.unpersist()


def test_near_duplicates_equal_brute_force(spark):
    body = [f"w{i * 37 % 211}" for i in range(400)]
    changed = [*body[:200], "other", *body[201:]]
    rows = [(3, " ".join(body)), (1, " ".join(changed)), (2, " ".join(body).upper()), (8, None), (7, ""), (9, "x y z"), (9, "x y z"), (None, "x y z"), (None, "q")]
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    label = brute_classes([np.uint64(p) for p in prints])
    smallest = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            smallest[x] = min(i, smallest.get(x, i))
    assert got == sorted(((i, p, smallest.get(x)) for (i, _), p, x in zip(rows, prints, label, strict=True)), key=str)


def test_one_of_each_keeps_columns_and_smallest_ids(spark):
    rows = [(3, "a b c d"), (1, "A b C d"), (4, "quite another text here"), (7, None), (6, "")]
    got = simhash.one_of_each(docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 6]


def test_one_of_each_where_ids_repeat(spark):
    rows = [(3, "a b c d"), (1, "A b C d"), (1, "quite another text here"), (None, "a b c d"), (None, "and some more text there")]
    got = simhash.one_of_each(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)


def test_components_of_chains_stars_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    links = spark.createDataFrame([*chain, *star, *star, (7, 7), (None, 5), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
