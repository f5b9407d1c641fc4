"""The pipeline, and the registered queries, against brute force on a small corpus."""

import random

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import common, registry, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A table folder with planted copies, near copies, leaks and junk."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(11)
    pool = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    clean = [(i, "\n".join(text(rng.randrange(20, 60)).capitalize() + "." for _ in range(rng.randrange(3, 9)))) for i in range(120)]
    item = text(40)
    copies = [(200 + i, clean[i][1].replace(" ", "  ", 3)) for i in range(10)]
    leaks = [(300 + i, clean[50 + i][1] + "\n" + item + "\n" + text(30)) for i in range(8)]
    junk = [(400 + i, "\n".join(" ".join(f"{rng.choice(pool).upper()}!!" for _ in range(20)) for _ in range(6))) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in [*clean, *copies, *leaks, *junk]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 400 <= i < 500 else 1, 0) for i, *_ in rows if i % 10 or i >= 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_drop_what_is_planted_and_nothing_else(spark, corpus):
    docs = common.read(spark, corpus, "documents")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        if name != corpus_pipeline.STAGES[-1][0]:
            before = docs.columns
            docs = common.staged(stage(spark, docs, corpus), name)
            assert docs.columns == before
            seen[name] = ids(docs)
    assert seen["quality_classifier"] == {*range(120), *range(200, 210), *range(300, 308)}
    assert seen["exact_dedup"] == seen["quality_classifier"] - {*range(200, 210)}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in common.read(spark, corpus, "documents").collect()}
    near = {i for i in seen["exact_dedup"] if any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in seen["exact_dedup"])}
    assert seen["simhash_near_dedup"] == seen["exact_dedup"] - near
    assert seen["benchmark_decontamination"] == seen["simhash_near_dedup"] - {*range(300, 308)}
    packed = corpus_pipeline.run(spark, corpus)
    assert ids(packed) == seen["benchmark_decontamination"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run_on_the_smallest_tables(spark, name):
    made = registry.queries()[name](spark, SF).toArrow()
    assert made.num_rows > 0 and len(set(made.column_names)) == made.num_columns
    if name in registry.oracle_sql():
        with duckdb.connect() as duck:
            for table in ("documents", "pages", "benchmark", "conversations"):
                duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
            want = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
        assert made.num_rows == want.num_rows and rows(made) == rows(want)


def rows(found):
    names = sorted(found.column_names)
    return sorted((tuple(r[n] for n in names) for r in found.to_pylist()), key=str)


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
