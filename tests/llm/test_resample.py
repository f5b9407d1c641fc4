"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, run=2, buckets=10_000):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, *, percent=25, least=20, run=2, buckets=10_000, seed=7):
    found = [(i, *buckets_of(t, run, buckets)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in buckets_of(x, run, buckets)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets))))
    rows = []
    for i, words, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(drawn[: percent * len(drawn) // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    pool = ["Alpha", "beta", "GAMMA", "élan", "ÉLAN", "x1", "漢字", "the", "of"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "_", " - "]) for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(150)] + [(500, None), (501, ""), (None, text(40)), (502, "the " * 60_000), (503, text(30)), (503, "of " * 25)]
    docs += [(k, "one text of twenty words " * 5) for k in range(600, 700)]
    return docs, [text(25) for _ in range(6)] + [None, ""]


def got(spark, docs, target, **options):
    own = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, slot string, batch int").repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    return sorted((tuple(r) for r in resample.resample(own, aim, **options).collect()), key=str)


def test_default_draw(spark, corpus):
    assert got(spark, *corpus) == brute(*corpus)


def test_small_batches_and_other_settings(spark, corpus):
    found = got(spark, *corpus, percent=60, least_words=3, run=3, buckets=64, slots=5, seed=11, batch_docs=4)
    assert found == brute(*corpus, percent=60, least=3, run=3, buckets=64, seed=11)


def test_no_target_and_no_documents(spark, corpus):
    assert got(spark, corpus[0][:20], []) == brute(corpus[0][:20], [])
    assert got(spark, [], corpus[1]) == []


def test_runs_end_with_their_text():
    found, words = resample.features("Ab c-d", 3)
    assert words == 3 and sorted(found) == sorted(zlib.crc32(x) % 10_000 for x in (b"ab", b"c", b"d", b"ab c", b"c d", b"ab c d"))
    assert [len(x) if not isinstance(x, int) else x for x in resample.features("...")] == [0, 0]


def test_memory_of_a_batch_and_of_a_task_are_bounded(spark):
    """Pairs are sorted in place, as small numbers; rows of postings are dealt to tasks by their number, not by what AQE merges."""
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 100 * 64, 200_000).astype(np.int32)
    keys, counts = np.unique(pairs, return_counts=True)
    tracemalloc.start()
    found = list(resample._inverted(pairs, 100, 4, 64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    docs, n = np.concatenate([f[4] for f in found]), np.concatenate([f[5] for f in found])
    assert (docs == keys % 64).all() and (n == counts).all() and sum(int(f[2].sum()) for f in found) == len(pairs)
    assert peak < pairs.nbytes * 1.2
    assert list(resample._inverted(np.zeros(0, np.int32), 100, 4, 64)) == []
    docs = spark.createDataFrame([(i, f"word{i} and other words of text {i % 7}") for i in range(600)], "doc_id long, text string")
    plan = resample.weighted(docs, docs.limit(5), batch_docs=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [slot" in plan and ", 7" in plan.partition("RepartitionByExpression [slot")[2].split("\n")[0]


def test_stored_postings_are_read_in_small_parts(spark, monkeypatch):
    """A reader decodes a row group, or some thousand rows of it, at a time: groups must not grow with the input of the task that wrote them.
    Postings are single values, as levels for each element would take a reader more memory than they do."""
    monkeypatch.setattr(resample, "GROUP_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(resample, "staged", lambda df, name, *more, f=resample.staged: kept.append(f(df, name, *more)) or kept[-1])
    kept, rng = [], random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(400)] + [(400, "the " * 70_000), (401, "of of " * 200)]
    own = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = sorted(tuple(r) for r in resample.resample(own, own.limit(5), batch_docs=4).collect())
    assert found == sorted(brute(docs, [t for _, t in docs[:5]]))
    groups = [m.row_group(i) for f in kept[0].inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for i in range(m.num_row_groups)]
    assert len(groups) > 10 and max(g.num_rows for g in groups) < 1000 and sum(g.num_rows for g in groups) == kept[0].count()
    assert dict(kept[0].dtypes)["docs"] == dict(kept[0].dtypes)["counts"] == "binary"
    most = kept[0].where("slot >= 0").selectExpr("max(length(counts) / (length(docs) / 2))").first()[0]
    assert most == 4  # of the text with 70,000 equal words


def test_sums_are_dealt_by_the_number_of_batches(spark):
    """Batches meet with their shares in tasks that AQE does not merge, whatever it thinks a task can hold."""
    docs = spark.createDataFrame([(i, f"word{i} and other words of text {i % 7}") for i in range(600)], "doc_id long, text string").coalesce(1)
    plan = resample.weighted(docs, docs.limit(5), batch_docs=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [batch" in plan and ", 10" in plan.partition("RepartitionByExpression [batch")[2].split("\n")[0]
