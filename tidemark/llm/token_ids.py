"""Token ids as binary files: Simple-8b words with escapes, in blocks whose offsets allow decoding them one by one."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, shipped, staged

#: Ids that a 64-bit word holds and bits of each, by the selector in its top four bits. Selector 0 is an
#: escape: its word holds the place of one id, too wide for 60 bits, among the record's escapes.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
#: The first word of a record, what the text writer puts behind each, and the words of a record's head.
MAGIC, MARK, HEAD = b"S8BTOK01", "S8BEND01", 9
#: Ids of a block, and ids after which a file ends with the document it is in.
BLOCK, FILE_IDS = 4096, 1 << 22
VOCABULARY = "byte_bpe_50k.json"
#: Words are told apart by single blanks and line breaks; a text with other blanks, or more of them, goes to the tokenizer whole.
OTHER_BLANKS = re.compile("[\\t\\r\\v\\f\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
UNEVEN = ("  ", " \n", "\n ", "\n\n\n")
#: Words kept with their ids: so many, and so many older ones (about 150 MB of a worker in all).
CACHED = 400_000
RECORD_OUT = "record binary"
FACTS_OUT = "part long, seq long, at long, doc_id long, n_tokens long, ids_crc32 long"
IDS_OUT = "doc_id long, ids array<long>"


#: Letters below are such in every version of Unicode; stops that are a part of their own behind letters.
LATIN, STOPS = "\u0250", tuple(".,;:!?")


def shown() -> dict[int, int]:
    """The characters by which a byte-level model names bytes: itself where Latin-1 prints it, else the next beyond."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


SHOWN = shown()


class Known(dict):
    """What ``make`` gives for each key. When there are ``CACHED`` keys they become the old ones, and those asked for again move on; so
    twice that number is kept at most."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """The ids of a text as little-endian 32-bit bytes.

    A byte-level vocabulary merges within the parts of its pattern alone, and a blank between two words begins the part of the
    second, a line break is one of its own; so a text's ids are those of its words, each with what stands before it. The
    tokenizer cuts and merges each different word once, and its ids are kept.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        described = json.loads(self.tokenizer.to_str())
        cut = described["pre_tokenizer"] or {}
        self.by_words = described["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if self.by_words:
            self.blank, self.line_break = self.cut.pre_tokenize_str(" ")[0][0], self.whole("\n")
        self.part = Known(self._merged).__getitem__
        self.word = Known(self._word).__getitem__

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word: of one that begins with its line break, or else of one behind a blank."""
        if word.isalpha() and max(word) < LATIN:  # one part
            return self._merged(self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)))
        if word[-1:] in STOPS and word[:-1].isalpha():
            return self.word(word[:-1]) + self.part(word[-1])
        after_break = word[:1] == "\n"
        parts = self.cut.pre_tokenize_str(word[1:] if after_break else " " + word)
        return (self.line_break if after_break else b"") + b"".join([self.part(p) for p, _ in parts])

    def is_even(self, text: str) -> bool:
        """Whether words can be told apart by single blanks and line breaks."""
        if not self.by_words or not text or text[0] in " \n" or text[-1] in " \n" or OTHER_BLANKS.search(text):
            return False
        return not any(s in text for s in (*UNEVEN, *self.special))

    def __call__(self, text: str) -> bytes:
        if not self.is_even(text):
            return self.whole(text) if text else b""
        words = ("\n" + text).replace("\n", " \n").split(" ")
        return b"".join(map(self.word, words[1:]))[len(self.line_break) :]  # without the line break put before the text


def vocabulary_path(vocabulary: str | None) -> str:
    """The file of a vocabulary, by default of the public byte-level one."""
    if vocabulary is not None:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None) -> Encoder:
    return Encoder(vocabulary_path(vocabulary))


#: Bits of the numbers below 2^16.
SHORT = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned id, as uint8; beyond 53 bits it may be one too many."""
    if len(ids) and ids.max() < len(SHORT):
        return SHORT[ids]
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _fitting(bits: np.ndarray) -> np.ndarray:
    """The selector of the word that begins at each place of a block (rows of ``bits``; 255 beyond an end): the one that holds most ids."""
    size = bits.shape[1]
    top = {1: bits}

    def widest(n: int, of: int) -> np.ndarray:
        """The widest of ``n`` neighbours, from those of ``of`` of them, at least half as many."""
        out = np.full_like(bits, 255)
        if n <= size:
            a = top[of]
            np.maximum(a[:, : size - n + 1], a[:, n - of : size - of + 1], out=out[:, : size - n + 1])
        return out

    for n, of in ((2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 5), (12, 6), (15, 8), (20, 10), (30, 15), (60, 30), (120, 60), (240, 120)):
        top[n] = widest(n, of)
    chosen = np.zeros_like(bits)
    for selector in range(15, 0, -1):
        chosen[top[int(COUNTS[selector])] <= WIDTHS[selector]] = selector
    return chosen


def _word_starts(steps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of each block (rows of ``steps``, of which the first ``sizes`` count) begin, block by block, and how many each has:
    all blocks go on by a word at a time."""
    rows = np.arange(len(steps))
    at, places = np.zeros(len(steps), np.int64), []
    while len(rows):
        places.append((rows, at))
        at = at + steps[rows, at]
        going = at < sizes[rows]
        if not going.all():
            rows, at = rows[going], at[going]
    every, starts = (np.concatenate([p[k] for p in places]) for k in (0, 1))
    order = np.argsort(every, kind="stable")
    return every[order] * steps.shape[1] + starts[order], np.bincount(every, minlength=len(steps))


def packed(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, escapes) of unsigned ids: offsets[k] is the first word of block k, and the last one their number."""
    words, sizes, escapes, at = [], [np.zeros(1, np.int64)], [], 0
    blocks_at_once = max(1, (1 << 20) // block)
    for low in range(0, len(ids), blocks_at_once * block):
        part = ids[low : low + blocks_at_once * block].astype(np.uint64)
        rows = -(-len(part) // block)
        bits = np.full((rows, block), 255, np.uint8)
        bits.reshape(-1)[: len(part)] = bit_lengths(part)
        chosen = _fitting(bits)
        place, counts = _word_starts(COUNTS.astype(np.uint8)[chosen], np.minimum(len(part) - np.arange(rows) * block, block))
        sizes.append(counts)
        selectors = chosen.reshape(-1)[place]
        out = selectors.astype(np.uint64) << np.uint64(60)
        for selector in np.unique(selectors):
            own = np.flatnonzero(selectors == selector)
            if selector == 0:
                out[own] |= np.arange(at, at + len(own), dtype=np.uint64)
                escapes.append(part[place[own]])
                at += len(own)
                continue
            first, payload = place[own], out[own]
            for j in range(int(COUNTS[selector]) if WIDTHS[selector] else 0):
                payload |= part[first + j] << np.uint64(j * int(WIDTHS[selector]))
            out[own] = payload
        words.append(out)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return join(words), np.cumsum(np.concatenate(sizes)).astype(np.uint64), join(escapes)


def unpacked(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of consecutive words, all words of a selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        first = ends[own] - COUNTS[selector]
        payload = words[own] & np.uint64((1 << 60) - 1)
        if selector == 0:
            out[first] = escapes[payload]
        elif WIDTHS[selector]:
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            for j in range(int(COUNTS[selector])):
                out[first + j] = (payload >> np.uint64(j * int(WIDTHS[selector]))) & mask
    return out


def record(part: int, seq: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One file's content, in 64-bit little-endian words: the head (magic, part, seq, ids, documents, block, blocks, words,
    escapes), doc_ids, which of them are known, ids of each document, block offsets, packed words, escapes."""
    words, offsets, escapes = packed(ids, block)
    head = np.array([int.from_bytes(MAGIC, "little"), part, seq, len(ids), len(doc_ids), block, len(offsets) - 1, len(words), len(escapes)], "<u8")
    known = np.array([d is not None for d in doc_ids], "<u8")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join(x.tobytes() for x in (head, names, known, np.array(counts, "<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")))


class Record:
    """A file's content, read back; ids are decoded when asked for."""

    def __init__(self, data: bytes):
        every = np.frombuffer(data, "<u8", count=len(data) // 8)
        if len(every) < HEAD or data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        self.part, self.seq, self.n_ids, docs, self.block, blocks, words, escapes = (int(x) for x in every[1:HEAD])
        ends = np.cumsum([HEAD, docs, docs, docs, blocks + 1, words, escapes])
        if ends[-1] > len(every):
            raise ValueError("a file of token ids ends too early")
        names, known, counts, self.offsets, self.words, self.escapes = (every[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        self.doc_ids = [int(n) if k else None for n, k in zip(names.view("<i8"), known, strict=True)]
        self.counts = counts.astype(np.int64)

    def ids(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids ``low`` to ``high`` of the file, from the blocks that hold them alone."""
        high = self.n_ids if high is None else min(high, self.n_ids)
        if low >= high:
            return np.zeros(0, np.uint64)
        first, last = low // self.block, (high - 1) // self.block
        found = unpacked(self.words[int(self.offsets[first]) : int(self.offsets[last + 1])], self.escapes)
        return found[low - first * self.block : high - first * self.block]


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, block: int = BLOCK) -> None:
    """Writes the ids of all texts, each with ``end_id`` behind it, to files in ``folder``.

    Documents are dealt by ranges of (id, hash of the text) and sorted there, so files in order of their (part, seq) hold them
    in ascending order of ids (null first; rows that share an id by their text). A whole text is encoded at once; a file
    ends with the document that fills it (``file_ids``), so it holds whole documents and is read as one cell. A task holds
    one file's ids. Spark's text writer commits the files, one record each: it keeps bytes that are no valid text as they
    are, and its "line separator" is the mark at a file's end.

    Null texts count as empty: ``end_id`` alone. Repeated rows are written each; an empty table gives no record. Extra
    columns are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = own.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        names: list[int | None] = []
        found: list[bytes] = []
        seq = size = 0

        def made() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(found), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([record(part, seq, names, [len(x) // 4 for x in found], ids, block)], pa.binary())], names=["record"])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                names.append(name)
                found.append(encode(text.as_py()) + end)
                size += len(found[-1]) // 4
                if size >= file_ids:
                    yield made()
                    names, found, size, seq = [], [], 0, seq + 1
        if names:
            yield made()

    shipped(docs.sparkSession)
    out = dealt.mapInArrow(run, RECORD_OUT).select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", MARK).option("maxRecordsPerFile", 1).text(folder)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content")


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, seq, at, doc_id, n_tokens, ids_crc32) of each document in the files of ``folder``, decoded: its file, the ids before it
    there, and the unsigned crc32 of its ids as 32-bit little-endian numbers. A task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                own = Record(content.as_py())
                ids = memoryview(own.ids().astype("<u4")).cast("B")
                ends = np.cumsum(own.counts)
                starts = ends - own.counts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                columns = [pa.array(np.full(n, own.part)), pa.array(np.full(n, own.seq)), pa.array(starts), pa.array(own.doc_ids, pa.int64()), pa.array(own.counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FACTS_OUT.split(", ")])

    shipped(spark)
    return _records(spark, folder).mapInArrow(run, FACTS_OUT)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of each document in the files of ``folder``, its end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                own = Record(content.as_py())
                ends = np.cumsum(own.counts)
                for low in range(0, len(ends), 256):
                    some = slice(low, low + 256)
                    first, last = int(ends[low] - own.counts[low]), int(ends[some][-1])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends[some] - first], pa.int32()), pa.array(own.ids(first, last).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids[some], pa.int64()), lists], names=["doc_id", "ids"])

    shipped(spark)
    return _records(spark, folder).mapInArrow(run, IDS_OUT)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; ``start`` counts the ids of all documents before
    it. Ids are added up by file, along the files of a part and along the parts: one row for each of them."""
    found = staged(read_facts(spark, folder), "token-facts")
    files = found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda *by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier(order="part")), F.lit(0)).alias("before"))
    inside = files.select("part", "seq", F.coalesce(F.sum("n").over(earlier("part", order="seq")), F.lit(0)).alias("inside"))
    placed = inside.join(bases, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    return found.join(placed, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` to a new folder and reads the files back: see ``write`` and ``read_back``."""
    folder = new_path(docs.sparkSession, "token-ids")
    write(docs, folder, **options)
    return read_back(docs.sparkSession, folder)
