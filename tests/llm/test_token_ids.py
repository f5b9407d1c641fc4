"""Simple-8b files: round trips of ids, of files and of whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from tidemark.llm import token_ids
from tidemark.llm.common import new_path


@settings(max_examples=150, deadline=None)
@given(hnp.arrays(np.uint64, st.integers(0, 900), elements=st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1))), st.sampled_from([1, 7, 256, 4096]))
def test_words_give_their_ids_back(ids, block):
    words, offsets, escapes = token_ids.packed(ids, block)
    assert (token_ids.unpacked(words, escapes) == ids).all()
    assert len(escapes) <= (ids >= 2**60 - 64).sum() and len(offsets) == -(-len(ids) // block) + 1


def test_selectors_take_as_many_as_fit():
    words, _, _ = token_ids.packed(np.array([0] * 240 + [1] * 60 + [32767] * 4 + [2**60], np.uint64))
    assert [int(w >> np.uint64(60)) for w in words] == [1, 2, 12, 0]


def test_a_record_is_read_block_by_block():
    ids = np.random.default_rng(3).integers(0, 50_257, 10_000).astype(np.uint64)
    record = token_ids.Record(token_ids.record(4, 2, [5, None, 5], [9_000, 0, 1_000], ids, block=512))
    assert (record.part, record.seq, record.doc_ids, record.counts.tolist()) == (4, 2, [5, None, 5], [9_000, 0, 1_000])
    for low, high in ((0, None), (511, 513), (512, 1024), (9_999, 20_000), (7, 7)):
        assert (record.ids(low, high) == ids[low:high]).all()
    with pytest.raises(ValueError):
        token_ids.Record(b"x" * 100)
    with pytest.raises(ValueError):
        token_ids.Record(token_ids.record(0, 0, [1], [100], ids[:100])[:-8])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\n\t'sdl1é漢\x85\xa0\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_give_the_tokenizer_s_ids(text):
    encode = token_ids.encoder(None)
    assert all(encode(t) == encode.whole(t) for t in (text, f"x {text}y", text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Zs", "Zl", "Zp", "Cc"]), min_size=1, max_size=5), min_size=1, max_size=9), st.randoms())
def test_even_texts_go_by_words(words, rng):
    encode = token_ids.encoder(None)
    text = "".join(w + rng.choice([" ", "\n", "\n\n"]) for w in words).strip(" \n")
    assert encode(text) == encode.whole(text)


def test_words_are_kept_and_given_up(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHED", 5)
    encode = token_ids.Encoder(token_ids.vocabulary_path(None))
    texts = [" ".join(f"w{k % n} it's\nso" for k in range(30)) for n in (1, 2, 7, 29)]
    assert [encode(t) for t in texts] == [encode.whole(t) for t in texts]


def test_odd_texts():
    encode = token_ids.encoder(None)
    for text in ("", " ", "\n", "a  b", "<|endoftext|>", "x <|endoftext|> y", " lead", "trail ", "can't won't 'tis", "\x00a b", "a\n\nb", "ab " * 50_000, "word" * 20_000, "\t" * 3_000, "one two\n" * 200_000 + "end"):
        assert encode(text) == encode.whole(text), text[:50]


def expected(rows, encode):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode.whole(text or "") + b"\0" * 4
        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def test_files_hold_all_documents_in_order(spark):
    rows = [(k * 37 % 101 - 50, f"Text {k}\nof some {'long ' * (k % 9)}words") for k in range(101)] + [(None, "no id"), (60, None), (61, ""), (62, "same"), (62, "same"), (63, "l'été " * 3_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, tie string, part int").repartition(5)
    encode = token_ids.encoder(None)
    for size in (1, 100, 1 << 23):
        got = [tuple(r) for r in token_ids.round_trip(docs, file_ids=size, block=16).orderBy("start").collect()]
        assert got == expected(rows, encode)
    folder = new_path(spark, "ids")
    token_ids.write(docs, folder, file_ids=500)
    lists = {(r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in token_ids.read_ids(spark, folder).collect()}
    assert lists == {(d, encode.whole(t or "") + b"\0" * 4) for d, t in rows}


def test_rows_of_one_id_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "doc_id long, text string")
    got = token_ids.round_trip(docs).orderBy("start").collect()
    encode = token_ids.encoder(None)
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(encode.whole(t) + b"\0" * 4) for t in "bab") and [r.start for r in got] == [0, 2, 4]
    assert token_ids.round_trip(docs.limit(0)).count() == 0
