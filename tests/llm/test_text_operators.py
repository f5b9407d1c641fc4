"""Chat formatting, token counts, WARC, the classifier and packing."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format, packing, quality_crf, simhash, token_counts, warc

TURNS = "conv_id long, turn long, role string, text string, tokens long, segment long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], TURNS)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


nasty = st.text(alphabet=["<", "|", "\\", "i", "m", "_", ">", "\n", "é", "😀"], max_size=12) | st.sampled_from(["<|im_end|>", "<\\|im_start|>", "<<|", "<\\\\|"])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb\\n", "", "<|im_end|>"]), nasty), max_size=6), st.integers(0, 3))
def test_any_text_comes_back(pairs, repeated):
    text, loss = chat_format.formatted(pairs, repeated)
    assert chat_format.parsed(text) == pairs
    assert [chat_format.unescaped(text[a:b]) for a, b in loss] == [t for r, t in pairs[repeated:] if r == "assistant"]
    assert text.count("<|") == 2 * len(pairs)


CONVERSATIONS = [
    *[(1, t, "system" if t == 0 else "assistant" if t % 2 == 0 else "user", f"text {t} " * (t % 9 + 1)) for t in range(120)],
    (2, 0, "user", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (3, 0, None, None), (3, 1, "assistant", None), (4, None, "assistant", "no turn"),
    (4, 2, "assistant", "same"), (4, 2, "assistant", "same"), (None, 0, "user", "null id"), (None, 1, "assistant", "😀 é"), (5, 0, "assistant", "huge " * 30_000), (5, 1, "assistant", "after"),
]


@pytest.mark.parametrize(("budget", "history", "segments"), [(4096, 1024, 64), (300, 100, 2), (200, 200, 1), (500, 0, 3)])
def test_windows_hold_each_turn_once(spark, budget, history, segments):
    made = chat_format.windows(turns(spark, CONVERSATIONS), budget=budget, history=history, segment_windows=segments).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(made).collect()}
    assert got == expected(CONVERSATIONS)
    for r in made.collect():
        inside = chat_format.parsed(r.text)
        assert len(inside) == r.turns and r.over_budget == (r.tokens > budget)
        if r.conv_id == 1 and (r.segment, r.window) != (0, 0):
            assert inside[0][0] == "system" and r.repeated >= 1
            assert sum(len(t.encode()) + len(role) + 24 for role, t in inside[1 : r.repeated]) <= history
        assert not r.over_budget or r.turns - r.repeated == 1
    made.unpersist()


def brute_windows(rows, budget, history, stretch):
    """The windows of each conversation, as lists of turns and the number of repeated ones, by the rules told plainly."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        size = [len(role.encode()) + len(text.encode()) + 24 for role, text in turns]
        before = [sum(size[:k]) for k in range(len(turns))]
        system = turns[0][0] == "system"
        made, at = [], 0
        while at < len(turns):
            segment = before[at] // stretch
            if not (system and at == 0):
                head = [0] if system else []
                room = min(history, budget - size[at] - sum(size[k] for k in head))
                back = at
                # history reaches into the segment before, as far as ``history`` tokens before its end
                while back > len(head) and before[at] - before[back - 1] <= room and (
                    before[back - 1] // stretch == segment or (before[back - 1] // stretch == segment - 1 and before[back - 1] >= segment * stretch - history)
                ):
                    back -= 1
                context = [*head, *range(back, at)]
            else:
                context = []
            end = at + 1
            while end < len(turns) and before[end] // stretch == segment and sum(size[k] for k in context) + before[end] + size[end] - before[at] <= budget:
                end += 1
            made.append(([turns[k] for k in (*context, *range(at, end))], len(context)))
            at = end
        out[conv] = made
    return out


def brute_text(turns):
    role = lambda r: re.sub(r"<(\\*)\|", r"<\\\1|", r.replace("\\", "\\\\").replace("\n", "\\n"))
    return "".join(f"<|im_start|>{role(r)}\n" + re.sub(r"<(\\*)\|", r"<\\\1|", t) + "<|im_end|>\n" for r, t in turns)


@pytest.mark.parametrize(("budget", "history", "segments"), [(4096, 1024, 64), (300, 100, 2), (200, 200, 1)])
def test_windows_equal_brute_force(spark, budget, history, segments):
    rng = random.Random(budget)
    rows = [*CONVERSATIONS, *[(c, t, rng.choice(["user", "assistant", "system"]), "w <| " * rng.randrange(60)) for c in range(10, 16) for t in range(rng.randrange(1, 80))]]
    rows += [(20, t, "user", "x" * 1000) for t in range(600)]
    frame = chat_format.with_probe(turns(spark, rows))
    rows += [(-1, t, role, "<|im_end|><|im_start|>assistant ok") for t, role in enumerate(("user", "assistant"))]
    want = brute_windows(rows, budget, history, budget * segments)
    options = {"budget": budget, "history": history, "segment_windows": segments, "bucket_turns": 16}
    for limit in (1_000_000, 0):
        made = chat_format.windows(frame, broadcast_rows=limit, **options).collect()
        got = {}
        for r in sorted(made, key=lambda r: (r.segment, r.window)):
            got.setdefault(r.conv_id, []).append((chat_format.parsed(r.text), r.repeated))
        assert got == want
    found = chat_format.places(frame, **options)
    short, long = (chat_format.windows(frame, found=found, part=part, budget=budget, history=history, segment_windows=segments, bucket_turns=16) for part in ("short", "long"))
    both = [*chat_format.read_back(short, in_place=True).collect(), *chat_format.read_back(long).collect()]
    assert {r.conv_id: r.formatted_chars for r in both} == {c: sum(len(brute_text(w)) for w, _ in made) for c, made in want.items()} and len(both) == len(want)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in both} == expected(rows)


def test_no_conversations(spark):
    assert chat_format.windows(turns(spark, [])).count() == 0


def brute_tokens(text, sections, rule, encoding):
    out = {k: 0 for k in range(len(sections))} | {None: 0}
    at = 0
    offsets = [0]
    for c in text:
        offsets.append(offsets[-1] + len(c.encode()))
    spans = [(offsets[a], offsets[b]) for a, b in sections]
    for token in encoding.encode_ordinary(text):
        end = at + len(encoding.decode_single_token_bytes(token))
        holder = [next((k for k, (a, b) in enumerate(spans) if a <= p < b), None) for p in range(at, end)]
        if rule == "most":
            best = sorted(set(holder), key=lambda k: (-holder.count(k), k is None, k or 0))[0]
        else:
            best = holder[0 if rule == "first" else -1]
        out[best] += 1
        at = end
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_are_attributed_by_rule(spark, rule):
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY)
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = "".join(rng.choice(["hello ", "wörld", "😀", " the", "\n", "ing", "12 "]) for _ in range(rng.randrange(30)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(6))
        rows.append((k, text, [{"name": str(i), "start": a, "end": b} for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=True))]))
    frame = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, spans array<struct<name:string,start:int,end:int>>, tokens int")
    got = {}
    for r in token_counts.attribute(frame, sections_col="spans", rule=rule).collect():
        got.setdefault(r.doc_id, {})[None if r.section is None else int(r.section)] = r.tokens
    for i, text, spans in rows:
        want = brute_tokens(text, [(s["start"], s["end"]) for s in spans], rule, encoding)
        assert got[i].get(None, 0) == want.pop(None)
        assert {k: v for k, v in got[i].items() if k is not None} == want


@pytest.mark.parametrize("run", [" " * 150_000, "\n" * 150_000, " \t\u3000" * 60_000])
@pytest.mark.parametrize("frame", ["{}", "a {} b", "{}'s", "x{}", "y {}z{}é"])
def test_long_blanks_are_the_tokens_of_the_whole_text(run, frame):
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY)
    text = frame.replace("{}", run)
    assert token_counts.encoded(text, encoding) == encoding.encode_ordinary(text)


def test_a_run_of_blanks_beyond_the_stack(spark):
    rows = token_counts.attribute(spark.createDataFrame([(1, "x" + " " * 2_000_000 + "y")], "doc_id long, text string")).collect()
    assert [(r.section, r.tokens) for r in rows] == [("0", 2_000_001)]


def test_lines_and_odd_texts(spark):
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY)
    texts = {1: "one\n\ntwo é\n", 2: None, 3: "", 4: "a" * 100_000, 5: "x\n" * 3000}
    frame = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    rows = token_counts.attribute(frame).collect()
    for i, t in texts.items():
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.tokens for r in own) == len(encoding.encode_ordinary(t or "")) * (2 if i == 1 else 1)
        assert len(own) == max(1, len((t or "").splitlines())) * (2 if i == 1 else 1)
    assert token_counts.attribute(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute(frame, rule="any")


def test_rendered_fields(spark):
    frame = spark.createDataFrame([(1, "ab", None, "c d"), (2, None, "x", "")], "doc_id long, a string, b string, c string")
    for r in token_counts.rendered(frame, ["a", "b", "c"], between="::").collect():
        assert [r.text[s["start"] : s["end"]] for s in r.sections] == r.text.split("::")


PAGES = "page_id long, url string, html string, payload string, digest string, r_id string"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_archives_come_back(spark, tmp_path, limit):
    same, small = "<p>same</p>" * 20, "<p>small</p>"
    rows = [(5, "http://a/", same), (2, "http://b/ x\r\nY: é", same), (9, None, same), (4, "http://c/", small), (3, "http://d/", small), (7, "u", None), (8, "u", ""), (None, "n", same), (11, "big", "é" * 400_000), (2, "twice", same), (12, "other", "<p>other</p>" * 30)]
    pages = spark.createDataFrame([(*r, "p", "d", "r") for r in rows], PAGES)
    folder = str(tmp_path / "warc")
    warc.write(pages, folder, dictionary_bytes=2000, sample_bytes=1000, broadcast_revisits=limit)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(spark, folder).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == same and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    files = [p.read_bytes() for p in (tmp_path / "warc").glob("part-*") if p.stat().st_size]
    assert files and all(int.from_bytes(f[:4], "little") == warc.DICTIONARY_FRAME for f in files)


def test_text_files_keep_any_bytes(spark, tmp_path):
    data = bytes(range(256)) * 3 + b"\xff\xfe\r\n\n" + b"\xed\xa0\x80"
    frame = spark.createDataFrame([(data,), (data[::-1],)], "frame binary").coalesce(1)
    frame.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", warc.BETWEEN).text(str(tmp_path / "t"))
    written = next(p.read_bytes() for p in (tmp_path / "t").glob("part-*") if p.stat().st_size)
    between = warc.BETWEEN.encode("ascii")
    assert written == data + between + data[::-1] + between


def test_hot_payloads_are_met_like_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 3)
    same, pair = "<p>hot</p>" * 20, "<p>pair</p>" * 20
    rows = [(k, "u", same) for k in range(10, 30)] + [(k, "u", pair) for k in (3, 4)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r.refers_to for r in warc.read_back(spark, str(tmp_path / "w")).collect()}
    assert got == {10: None, 3: None, 4: 3} | {k: 10 for k in range(11, 30)}


def test_an_archive_that_ends_early_is_an_error():
    data = b"".join(warc.archive(iter([warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None, "d")]), level=3, dictionary_bytes=500, sample_bytes=10))
    assert warc.parsed(next(iter(warc.frames(data))))[:2] == (1, 500)
    with pytest.raises(ValueError):
        list(warc.frames(data[:-5]))


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], PAGES), folder)
    assert warc.read_back(spark, folder).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 3])
    good, step = rng.normal(size=10), rng.normal(size=(2, 2))
    share, counts = quality_crf.marginals(good, step, lines, pairs=True)
    at, want, total = 0, [], np.zeros((2, 2))
    for n in lines:
        paths = [[(p >> i) & 1 for i in range(n)] for p in range(2**n)]
        weights = np.exp([sum(good[at + i] for i in range(n) if p[i]) + sum(step[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        weights /= weights.sum()
        want += [sum(w for w, p in zip(weights, paths, strict=True) if p[i]) for i in range(n)]
        for w, p in zip(weights, paths, strict=True):
            for i in range(n - 1):
                total[p[i], p[i + 1]] += w
        at += n
    assert np.allclose(share, want) and np.allclose(counts, total)


KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", ".,;:?'\"()-", "!", "|", "*%$#&@^~_=+<>[]{}\\/`"]


def brute_own(line, text):
    n = len(line)
    shares = [sum(chr(b) in k for b in line) / max(n, 1) for k in KINDS] + [sum(b >= 128 for b in line) / max(n, 1)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", line)
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words) if words else 0
    upper, lower = (sum(chr(b) in k for b in line) for k in KINDS[:2])
    return [*shares, math.log1p(n) / 8, float(n == 0), float(text.split(b"\n").count(line) > 1), echo, upper / max(upper + lower, 1)]


def brute_score(text, model):
    lines = text.split(b"\n")
    own = [brute_own(x, text) for x in lines]
    none = [0.0] * len(own[0])
    good = [float(np.dot(model.unary, [*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), 1.0])) for i in range(len(own))]
    total = np.zeros((len(lines), 2))
    # every path over the states of all lines, by the lines before and after
    ahead = [[0.0, good[0]]]
    for g in good[1:]:
        ahead.append([float(np.logaddexp(ahead[-1][0] + model.step[0, j], ahead[-1][1] + model.step[1, j])) + (g if j else 0.0) for j in (0, 1)])
    behind = [[0.0, 0.0]]
    for g in reversed(good[1:]):
        behind.insert(0, [float(np.logaddexp(model.step[j, 0] + behind[0][0], model.step[j, 1] + g + behind[0][1])) for j in (0, 1)])
    total = np.array(ahead) + np.array(behind)
    share = 1 / (1 + np.exp(total[:, 0] - total[:, 1]))
    weight = np.array([len(x) + 1 for x in lines])
    return float(share @ weight / weight.sum())


LINES = st.lists(st.sampled_from(["", "a", "a a b", "A B!", "x | 1", "é ü", "same line here", "\t", "3 3 3", "[~]", "\x0b\x0c\r"]), max_size=14)


@given(st.lists(LINES, max_size=5), st.integers(0, 3))
def test_scores_equal_brute_force_whatever_the_pieces(many, seed):
    rng = np.random.default_rng(seed)
    model = quality_crf.Model(rng.normal(size=3 * quality_crf.OWN + 1), 2 * rng.normal(size=(2, 2)))
    texts = ["\n".join(x).encode() for x in many]
    want = [brute_score(t, model) for t in texts]
    assert np.allclose(quality_crf.score(texts, model), want)
    for lines, size in ((1, 1), (3, 1000), (100, 7)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(quality_crf, "PIECE_LINES", lines)
            patch.setattr(quality_crf, "PIECE_BYTES", size)
            assert np.allclose(quality_crf.score(texts, model), want)


def test_long_chains_equal_the_plain_recursion():
    rng = np.random.default_rng(3)
    model = quality_crf.Model(rng.normal(size=3 * quality_crf.OWN + 1), rng.normal(size=(2, 2)))
    text = "\n".join(rng.choice(["", "some words", "MORE !!", "1 2 3"]) for _ in range(1000)).encode()
    assert np.allclose(quality_crf.score([text, b"", text[:300]], model), [brute_score(t, model) for t in (text, b"", text[:300])])


def test_millions_of_lines_take_bounded_memory():
    model = quality_crf.Model(np.linspace(-1, 1, 3 * quality_crf.OWN + 1), np.array([[0.5, 0.0], [0.0, 0.5]]))
    tracemalloc.start()
    found = quality_crf.score([b"\n" * 1_000_000, b"a\nb\n" * 200_000], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((found > 0) & (found < 1)).all() and peak < 100_000_000


def test_the_fit_takes_stretches_of_long_texts_and_no_more_rows_than_it_says(spark):
    frame = spark.createDataFrame([(i, "\n".join([f"{'GOOD' if i % 2 else 'bad'} {k}" for k in range(500)])) for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    held = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality_crf, "fit", lambda texts, q: held.append((texts, q)) or quality_crf.untrained())
        # most labels have no document here
        quality_crf.train(frame, labels, sample_docs=20, sample_lines=50, sample_chars=120)
        quality_crf.train(frame, labels, sample_docs=2000)
    (few, _), (many, quality) = held
    assert len(few) == 20 and all(t.count(b"\n") < 50 and len(t) <= 120 for t in few)
    assert len(many) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60)) and all(t.count(b"\n") == 99 for t in many)
    assert all(t.startswith(b"GOOD") == bool(q) for t, q in zip(many, quality, strict=True))


def labelled(n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioutrn") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        good = i % 4 != 0
        lines = [" ".join(word() if good else word().upper() + "!!" for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join([*([] if good else ["a clean line first"]), *lines]), int(good)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = labelled(400)
    frame = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows] + [(None, None, 7.0), (1000, "", 7.0), (1001, "x\n" * 50_000, 7.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality_crf.classify(frame, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    kept = quality_crf.accepted(frame, labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r.predicted for r in got)


def test_classifier_without_labels(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_crf.classify(frame, labels.limit(0)).collect()] == [0.5, 0.5]
    assert [r.predicted for r in quality_crf.classify(frame, labels).collect()] == [1, 1]
    assert quality_crf.classify(frame.limit(0), labels).count() == 0


def brute_pack(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["free"], n) for n, b in enumerate(bins) if b["free"] >= size and b["free"] > 0 and source not in b["s"] and cluster not in b["c"]]
        if fits:
            n = min(fits)[1]
        else:
            bins.append({"free": capacity, "s": set(), "c": set()})
            n = len(bins) - 1
        out.append((n, capacity - bins[n]["free"]))
        bins[n]["free"] -= size
        bins[n]["s"].add(source)
        bins[n]["c"].add(cluster)
    return out


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4), st.integers(0, 5)), max_size=60))
def test_packing_takes_the_tightest_compatible_bin(items):
    items.sort(reverse=True)
    assert packing.pack_shard(items, 20) == brute_pack(items, 20)


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_blocks_of_bins_change_nothing(most):
    rng = random.Random(most)
    for sources, clusters in ((1, 1000), (1000, 1), (3, 3), (40, 500)):
        items = sorted(((rng.randrange(50), rng.randrange(sources), rng.randrange(clusters)) for _ in range(400)), reverse=True)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(packing.Bins.__init__, "__defaults__", (most,))
            assert packing.pack_shard(items, 60) == brute_pack(items, 60)


def test_one_source_is_no_square():
    items = sorted(((i % 900 + 1, 0, i) for i in range(20_000)), reverse=True)
    began = time.monotonic()
    packed = packing.pack_shard(items, 16384)
    assert len({b for b, _ in packed}) == len(items) and time.monotonic() - began < 20


def brute_packed(rows, capacity):
    """Bins of pieces (id, piece, tokens) as one shard gives them, from plain rows (id, text, source)."""
    cut = []
    for i, text, source in rows:
        data = (text or "").encode()
        for k in range(max(1, -(-len(data) // capacity))):
            cut.append((i, k, min(capacity, len(data) - k * capacity), source, re.sub(r"[\x20\x09-\x0D]+", " ", text or "")))
    # no two pieces here are of one size, but for repeated rows
    cut.sort(key=lambda x: (-x[2], x[0] is not None, x[0] or 0, x[1]))
    bins = {}
    for (i, k, n, *_), (b, at) in zip(cut, brute_pack([(x[2], x[3], x[4]) for x in cut], capacity), strict=True):
        bins.setdefault(b, []).append((i, k, n, at))
    return sorted((sorted(x, key=str) for x in bins.values()), key=str)


def test_a_shard_on_spark_equals_brute_force(spark):
    rng = random.Random(8)
    sizes = rng.sample(range(1, 300), 150)
    rows = [(i, rng.choice("abc") * n, f"s{i % 5}") for i, n in enumerate(sizes)] + [(500, "z" * 777, "s1"), (501, None, None), (502, "q q", "t"), (502, "q q", "t"), (502, "q q", "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bins = {}
    for r in packing.pack(frame, capacity=300, shard_rows=10_000).collect():
        bins.setdefault(r.bin_id, []).append((r.doc_id, r.piece, r.tokens, r.bin_offset))
    assert sorted((sorted(x, key=str) for x in bins.values()), key=str) == brute_packed(rows, 300)


def test_near_copies_are_packed_apart(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.randrange(60, 90))
        for copy in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join([*base, *["z"] * (copy // 2)]) + " " * copy, f"s{len(rows)}", "extra"))
    rows += [(None, None, None, "extra"), (900, "", "t", "extra"), (901, "Tea  for TWO", "u", "extra"), (902, "tea for two", "v", "extra"), (902, "tea for two", "v", "extra"), (903, "long " * 700, "w", "extra")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string")
    got = packing.pack_apart(frame, capacity=2000, shard_rows=10_000).collect()
    # components by comparing all pairs
    prints = [simhash.fingerprint(text) for _, text, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group = [group[b] if g == group[a] else g for g in group]
    assert len(set(group)) < len({(text or "").strip().lower() for _, text, *_ in rows})  # not only equal texts are linked
    items = [(i, k, min(2000, len((text or "").encode()) - 2000 * k), source, g) for (i, text, source, _), g in zip(rows, group, strict=True) for k in range(max(1, -(-len((text or "").encode()) // 2000)))]
    cluster, by_bin = {(i, k): g for i, k, _, _, g in items}, {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    assert sorted((r.doc_id or -1, r.piece, r.tokens) for r in got) == sorted((i or -1, k, n) for i, k, n, *_ in items)
    for own in by_bin.values():
        assert len({cluster[r.doc_id, r.piece] for r in own}) == len(own) and sum(r.tokens for r in own) <= 2000
    order = sorted(items, key=lambda x: (-x[2], x[0] is not None, x[0] or 0, x[1]))
    want = {}
    for (i, k, *_), (b, at) in zip(order, brute_pack([(n, s, g) for _, _, n, s, g in order], 2000), strict=True):
        want.setdefault(b, []).append((i, k, at))
    assert sorted(sorted(map(str, x)) for x in want.values()) == sorted(sorted(str((r.doc_id, r.piece, r.bin_offset)) for r in x) for x in by_bin.values())
    assert packing.pack_apart(frame.limit(0)).count() == 0


def test_equal_rows_are_spread_over_shards(spark):
    frame = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'same text' as text", "cast(null as string) as source")
    got = packing.pack(frame, shard_rows=4096)
    shards = [r["count"] for r in got.groupBy(F.shiftright("bin_id", 32)).count().collect()]
    assert sum(shards) == 100_000 and max(shards) <= 2 * 4096 and got.select("bin_id").distinct().count() == 100_000


def test_packing_on_spark(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(60), "hot" if i % 3 == 0 else f"s{i % 7}", "b") for i in range(500)] + [(None, None, None, "b"), (900, "y" * 1050, "z", "b"), (901, "é" * 100, None, "b"), (901, "é" * 100, None, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id string")
    got = packing.pack(frame, capacity=100, shard_rows=64).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
    source = {r[0]: r[2] for r in rows}
    for own in by_bin.values():
        assert sum(r.tokens for r in own) <= 100
        assert len({source[r.doc_id] for r in own}) == len(own)
        spans = sorted((r.bin_offset, r.bin_offset + r.tokens) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.tokens
    assert size == {i: len((t or "").encode()) * (2 if i == 901 else 1) for i, t, *_ in rows}
    assert packing.pack(frame.limit(0)).count() == 0
