"""License scans, decontamination and URL filters."""

import itertools
import random
import time

import pytest

from tidemark.llm import decontaminate, license_scan, url_filter

DOCS = "doc_id long, text string, words string, seed string, license string, item_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "s", "l", 1) for i, t in rows], DOCS)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def filler(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_seeds_find_every_pattern_of_three_substitutions():
    spots = [{o + i for i in s} for s in decontaminate.SEEDS for o in range(decontaminate.WINDOW - s[-1])]
    for changed in itertools.combinations(range(decontaminate.WINDOW), 3):
        assert any(not spot & set(changed) for spot in spots)


def with_changes(text, places):
    words = text.split()
    for p in places:
        words[p] = f"changed{p}"
    return " ".join(words)


def test_overlaps_equal_brute_force(spark):
    items = [(1, filler(30, 1)), (2, filler(15, 2)), (3, filler(9, 3)), (4, "short item only"), (5, None), (6, "")]
    rows = []
    for k in range(40):
        item = items[k % 4]
        n = len(item[1].split())
        rng = random.Random(100 + k)
        part = with_changes(item[1], rng.sample(range(n), min(n, k % 6)))
        rows.append((k, f"{filler(k % 7, k)} {part} {filler(5, 50 + k)}" if k % 5 else part))
    rows += [(50, None), (51, ""), (52, filler(3000, 9)), (53, items[0][1].upper().replace(" ", ", ")), (None, items[0][1]), (54, items[0][1]), (54, items[0][1])]

    def brute(text, item):
        a, b = (text or "").lower().replace(",", " ").split(), (item or "").split()
        n = len(b)
        least = n if n < 7 else -(-min(15, n) * 8 // 10)
        for start in range(-n + 1, len(a)):
            equal = [0 <= start + i < len(a) and a[start + i] == b[i] for i in range(n)]
            if n and any(sum(equal[i : i + min(15, n)]) >= least for i in range(max(1, n - 14))):
                return True
        return False

    want = {(i, k) for i, t in rows for k, x in items if brute(t, x) and not (k == 3 and t and not _all_equal(t, x))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, rows), bench(spark, items)).collect()}
    assert got == want
    wide = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, rows), bench(spark, items), broadcast_hashes=0).collect()}
    assert wide == want


def _all_equal(text, item):
    return f" {item} " in f" {text.lower().replace(',', ' ')} "


@pytest.mark.parametrize("hashes", [2_000_000, 0])
def test_short_items_are_found_with_every_allowed_pattern(spark, hashes):
    items = [(n, filler(n, n)) for n in range(5, 15)]
    rows, want = [], set()
    for n, text in items:
        may = 0 if n < 7 else n - -(-n * 8 // 10)
        for changes in range(may + 2):
            for places in itertools.combinations(range(n), changes):
                key = 1000 * n + len(rows)
                rows.append((key, f"{filler(key % 4, key)} {with_changes(text, places)} {filler(key % 3, key + 1)}"))
                if changes <= may:
                    want.add((key, n, n - changes, n))
    # the first word lies before the document
    rows += [(-n, " ".join(text.split()[1:])) for n, text in items]
    want |= {(-n, n, n - 1, n) for n in range(7, 15)}
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, items), broadcast_hashes=hashes).collect()
    assert {(r.doc_id, r.item_id, r.equal_words, r.item_words) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("window, similarity", [(20, 0.7), (5, 0.6), (10, 0.8), (30, 0.95)])
def test_other_windows_lose_nothing(spark, window, similarity):
    items = [(n, filler(n, n)) for n in (4, 6, 8, 12, 19, 24, 31)]
    rows = []
    for k in range(140):
        n, text = items[k % 7]
        rng = random.Random(k)
        rows.append((k, f"{filler(k % 3, k)} {with_changes(text, rng.sample(range(n), rng.randrange(n // 2 + 1)))} {filler(2, k + 9)}"))

    def brute(text, n, item):
        a, b = text.split(), item.split()
        span = n if n < 7 else min(window, n)
        least = n if n < 7 else -(-span * round(similarity * 100) // 100)
        for start in range(-n + 1, len(a)):
            equal = [0 <= start + i < len(a) and a[start + i] == b[i] for i in range(n)]
            if any(sum(equal[i : i + span]) >= least for i in range(n - span + 1)):
                return True
        return False

    want = {(i, n) for i, t in rows for n, x in items if brute(t, n, x)}
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, items), window=window, similarity=similarity).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_clean_keeps_columns_and_other_rows(spark):
    items = [(1, filler(20, 1))]
    got = decontaminate.clean(docs(spark, [(1, "x " + items[0][1]), (2, filler(20, 5)), (3, None), (None, "")]), bench(spark, items))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id for r in got.collect()), key=str) == [2, 3, None]


def test_clean_goes_by_text_not_by_id(spark):
    leak, fine = f"x {filler(20, 1)} y", filler(20, 5)
    rows = [(None, leak), (None, fine), (7, fine), (7, leak), (8, leak), (8, leak), (9, fine), (9, fine)]
    got = decontaminate.clean(docs(spark, rows), bench(spark, [(1, filler(20, 1))])).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, fine), (7, fine), (9, fine), (9, fine)], key=str)
    nested = spark.createDataFrame([(1, leak, {"k": "v"}), (2, fine, {"k": "v"})], "doc_id long, text string, extra map<string,string>")
    assert [r.doc_id for r in decontaminate.clean(nested, bench(spark, [(1, filler(20, 1))])).collect()] == [2]


def test_of_rows_that_share_an_id_each_is_compared_by_its_text(spark):
    item = filler(30, 1)
    rows = [(7, with_changes(item, [0, 1, 2])), (7, with_changes(item, [0])), (7, filler(9, 2)), (None, with_changes(item, [5, 9])), (None, filler(9, 3))]
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, [(1, item)])).collect()
    assert {tuple(r) for r in got} == {(7, 1, 29, 30), (None, 1, 28, 30)} and len(got) == 2


@pytest.mark.parametrize("hashes", [2_000_000, 0])
def test_repeated_words_equal_brute_force(spark, hashes):
    rng = random.Random(5)
    period = lambda words, n: " ".join((words.split() * n)[:n])
    items = [(1, period("a", 40)), (2, period("a b", 33)), (3, period("a", 9)), (4, period("a a b", 20)), (5, " ".join(rng.choice("ab") for _ in range(50)))]
    texts = [period("a", 70), period("b a", 21), period("a b a", 90), " ".join(rng.choice("ab") for _ in range(120)), period("a", 12) + " c " + period("a", 12), period("b", 30), period("a", 5), "c " * 30]
    rows = list(enumerate(texts))

    def brute(text, item):
        a, b = text.split(), item.split()
        n, found = len(b), []
        for start in range(-n + 1, len(a)):
            equal = [0 <= start + i < len(a) and a[start + i] == b[i] for i in range(n)]
            if any(sum(equal[i : i + min(15, n)]) >= -(-min(15, n) * 8 // 10) for i in range(max(1, n - 14))):
                found.append(sum(equal))
        return max(found, default=None)

    want = {(i, k, brute(t, x), len(x.split())) for i, t in rows for k, x in items if brute(t, x)}
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, items), broadcast_hashes=hashes).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_runs_of_one_word_are_no_square(spark):
    rows, items = [(1, "a " * 20_000), (2, "b " * 1000), (3, filler(50, 1))], [(1, "a " * 2000), (2, "b " * 14)]
    began = time.monotonic()
    got = decontaminate.overlaps(docs(spark, rows), bench(spark, items)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2000, 2000), (2, 2, 14, 14)} and time.monotonic() - began < 60


def test_empty_benchmark_and_documents(spark):
    assert decontaminate.overlaps(docs(spark, [(1, "a b c")]), bench(spark, [])).count() == 0
    assert decontaminate.overlaps(docs(spark, []), bench(spark, [(1, "a b c")])).count() == 0


def test_licenses_are_found_in_place(spark):
    mit = license_scan.TEMPLATES[2][1]
    words = mit.split()
    edited = " ".join(["Permission", "is", "herewith", *words[3:]])
    rows = [
        (1, f"{filler(30, 1)} Released under the MIT License. {filler(9, 2)}"), (2, "Licensed under CC BY-NC 4.0."), (3, filler(400, 3)), (4, f"{filler(77, 4)}\n{mit}\n{filler(5, 5)}"),
        (5, edited), (6, " ".join(words[:20])), (7, None), (8, ""), (9, "licensed under the apache"), (None, "LICENSED under the Apache License, version 2.0"), (2, "Licensed under CC BY-NC 4.0."),
        (10, filler(20_000, 6) + " This work is licensed under the GNU General Public License, version 3. " + filler(20_000, 7)),
    ]
    want = {(1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "MIT"), (5, "MIT"), (None, "Apache-2.0"), (10, "GPL-3.0")}
    templates = license_scan.templates_table(spark)
    got = license_scan.scan(docs(spark, rows), templates).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(got) == len(want)
    assert next(r for r in got if r.doc_id == 5).containment < 1
    wide = license_scan.scan(docs(spark, rows), templates, broadcast_keys=0).collect()
    assert {tuple(r) for r in wide} == {tuple(r) for r in got}


def test_license_containment_equals_brute_force(spark):
    rows = []
    for k in range(60):
        rng = random.Random(k)
        words = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)][1].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "zzz"
        rows.append((k, f"{filler(rng.randrange(12), k)} {' '.join(words)} {filler(rng.randrange(12), k + 1)}"))

    def shingles(text):
        cleaned = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        return {tuple(cleaned[i : i + 5]) for i in range(len(cleaned) - 4)}

    want = {(i, name) for i, t in rows for name, x in license_scan.TEMPLATES if len(shingles(x) & shingles(t)) >= 0.8 * len(shingles(x))}
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs(spark, rows), license_scan.templates_table(spark)).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_templates_of_one_shingle_are_found_for_certain(spark, limit):
    # of 30,000 such templates at the start of a text, the bands alone miss these
    ids = [6509, 6729, 8348, 22396]
    templates = license_scan.templates_table(spark, [(f"L{i}", f"a{i} b c d e") for i in ids])
    rows = [(k, f"{before}a{i} b c d e f{i} g h i") for k, (i, before) in enumerate(itertools.product(ids, ("", "x ", "x y z ")))]
    got = license_scan.scan(docs(spark, rows), templates, broadcast_keys=limit).collect()
    assert {(r.doc_id, r.license, r.containment) for r in got} == {(k, f"L{ids[k // 3]}", 1.0) for k in range(len(rows))} and len(got) == len(rows)


def test_empty_license_tables(spark):
    assert license_scan.scan(docs(spark, []), license_scan.templates_table(spark)).count() == 0
    assert license_scan.scan(docs(spark, [(1, "a b c d e f")]), license_scan.templates_table(spark).limit(0)).count() == 0


URLS = [
    (1, "http://a.b.com/en/7", "a.b.com", "/en/7", "com/en/", "block"), (2, "https://X.Example.COM/en/723?q#f", "x.example.com", "/en/723", "example.com/en/7", "allow"),
    (3, "https://example.net/de/80", "example.net", "/de/80", "example.net/de/8", "block"), (4, "ftp://m.net/de/", "m.net", "/de/", "net/de/", "allow"), (5, None, "", "", None, "allow"),
    (6, "example.com/en/7", "", "", None, "allow"), (7, "http://", "", "", None, "allow"), (8, "http://badcom/en/", "badcom", "/en/", None, "allow"), (9, "http://org?x=://y", "org", "", None, "allow"),
    (10, "http://org/es/#", "org", "/es/", "org/es/", "block"), (11, "x://y://com/en/", "y:", "//com/en/", None, "allow"), (None, "http://com/en/a", "com", "/en/a", "com/en/", "block"),
    (12, "http://com/EN/", "com", "/EN/", None, "allow"), (12, "http://com/EN/", "com", "/EN/", None, "allow"), (13, "http://com\n/en/" + "z" * 5000, "com\n", "/en/" + "z" * 5000, None, "allow"), (14, "", "", "", None, "allow"),
]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame([(i, u, "h", "x", "v") for i, u, *_ in URLS], "page_id long, url string, host string, path string, verdict string")
    got = url_filter.judge(pages, url_filter.rules_table(spark), broadcast_rules=limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, h, p, r, v) for i, _, h, p, r, v in URLS), key=str)


def test_url_tables_may_be_empty(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rules_table(spark).limit(0)).collect()[0].verdict == "allow"
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_rule_precedence(spark):
    rules = url_filter.rules_table(spark, [("block", "b.com", "/a"), ("allow", "com", "/a/bb"), ("allow", "B.COM", "/a"), ("block", "b.com", "/")])
    pages = spark.createDataFrame([(1, "http://x.b.com/a"), (2, "http://b.com/c"), (3, "http://b.com/a/bbc")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {1: ("b.com/a", "block"), 2: ("b.com/", "block"), 3: ("com/a/bb", "allow")}


def test_long_hosts_and_paths(spark):
    rows = [(1, "http://" + "a." * 300_000 + "com/en/" + "x" * 300_000), (2, "http://" + "." * 500_000), (3, "http://" + "b" * 1_000_000 + "/en/"), (4, "http://x.com/" + "/" * 1_000_000), (5, "http://..com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    began = time.monotonic()
    assert {r.page_id: r.rule for r in url_filter.judge(pages, url_filter.rules_table(spark)).collect()} == {1: "com/en/", 2: None, 3: None, 4: None, 5: "com/en/"}
    assert time.monotonic() - began < 60


def test_hot_urls_are_answered_like_others(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "HOT_ROWS", 3)
    urls = ["http://a.com/en/1", None, "http://a.com/fr/", "no url", "http://b.net/de/"]
    rows = [(k, urls[k % 5]) for k in range(60)] + [(100 + k, f"http://c{k}.org/es/{k}") for k in range(9)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rules_table(spark)).collect()
    rules = {0: "com/en/", 4: "net/de/"}
    assert {r.page_id: r.rule for r in got} == {k: rules.get(k % 5) if k < 60 else "org/es/" for k, _ in rows} and len(got) == len(rows)
