"""Token counts: whole documents are encoded once, and token spans are joined to sections by position."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

#: Fixed value: how the public 50k byte-level vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of characters that are blanks to the pattern (Unicode's White_Space), long enough to be handled apart.
LONG_BLANKS = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
OUT = "doc_id long, section string, span_start long, span_end long, tokens long, crossing long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer of a rank file, and each token's length in bytes."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encoded(text: str, encoding) -> list[int]:
    """The text's tokens. The pattern takes a run of blanks but for the last as one part (all, at the end of the text), and the
    engine's stack ends in runs of about a million; so a very long run is handed over as the part it is."""
    tokens, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        tokens += encoding.encode_ordinary(text[at : run.start()])
        tokens += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return tokens + encoding.encode_ordinary(text[at:])


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin; a line keeps its break, and the empty text is one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.r_[0, breaks[breaks < len(data)]]


def joined(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether it crosses a section's border. Sections [low, high) are sorted
    and do not overlap; so are tokens [starts, ends): one binary search per token end is the interval join."""

    def holder(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(low, at, side="right") - 1
        # an empty section holds nothing; of those that begin together the last is the one with characters
        return np.where((k >= 0) & (at < high[np.maximum(k, 0)]), k, -1)

    if not len(low):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    first, last = holder(starts), holder(ends - 1)
    borders = np.sort(np.r_[low[low < high], high[low < high]])
    crossing = np.searchsorted(borders, starts, side="right") < np.searchsorted(borders, ends, side="left")
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for t in np.flatnonzero(crossing):
        spans = np.arange(np.searchsorted(high, starts[t], side="right"), np.searchsorted(low, ends[t]))
        shared = np.minimum(high[spans], ends[t]) - np.maximum(low[spans], starts[t])
        outside = ends[t] - starts[t] - shared.sum()
        best = int(np.argmax(shared)) if len(spans) else 0
        out[t] = spans[best] if len(spans) and shared[best] >= outside else -1
    return out, crossing


def attribute(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per (document, section): doc_id, section, span_start, span_end (characters), tokens, crossing.

    ``sections_col`` names an array<struct<name, start, end>> of character spans, sorted and without overlaps (see
    ``rendered``); without it each line is a section, named by its number from 0, its line break included. A document is
    encoded once, whole, so that its counts add up to what a model sees. A token that crosses a border goes to the
    section of its first byte (``first``), of its last (``last``) or with most of its bytes (``most``; ties to the
    first); ``crossing`` counts the crossing tokens that a section got. Tokens outside all sections are a row with a
    null section, so a document's rows always add up to its tokens.

    Null texts count as empty: a row with no tokens. A null list of sections is an empty one. Repeated rows give their
    rows again; an empty table gives an empty result; extra columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sections = F.lit(None).cast("array<struct<name:string,start:long,end:long>>")
    if sections_col is not None:
        sections = F.transform(
            F.coalesce(F.col(sections_col), F.array()),
            lambda s: F.struct(s["name"].cast("string").alias("name"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")),
        )
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), sections.alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = encoder(vocabulary, pattern)
        for batch in batches:
            rows = [_counted(t.as_py(), s.as_py(), encoding, sizes, rule) for t, s in zip(batch.column("text"), batch.column("sections"), strict=True)]
            take = pa.array(np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows]))
            columns = [batch.column("doc_id").take(take), pa.array([n for r in rows for n in r[0]], pa.string())]
            columns += [pa.array(np.concatenate([r[k] for r in rows]) if rows else [], pa.int64()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "span_start", "span_end", "tokens", "crossing"])

    shipped(docs.sparkSession)
    return own.mapInArrow(run, OUT)


def _counted(text: str, sections: list[dict] | None, encoding, sizes: np.ndarray, rule: str) -> tuple:
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    ends = np.cumsum(sizes[np.array(encoded(text, encoding), np.int64)]) if text else np.zeros(0, np.int64)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    plain = len(data) == len(text)
    # byte offset of each character's first byte, and one past the end
    chars = None if plain else np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
    if sections is None:
        low = line_starts(data)
        high = np.r_[low[1:], len(data)]
        names = [str(k) for k in range(len(low))]
        span = (low, high) if plain else (np.searchsorted(chars, low), np.searchsorted(chars, high))
    else:
        names = [s["name"] for s in sections]
        span = tuple(np.array([min(max(s[k], 0), len(text)) for s in sections], np.int64) for k in ("start", "end"))
        low, high = span if plain else (chars[span[0]], chars[span[1]])
    holder, crossing = joined(starts, ends, low, high, rule)
    tokens = np.bincount(holder + 1, minlength=len(low) + 1)
    crossed = np.bincount(holder[crossing] + 1, minlength=len(low) + 1)
    if tokens[0]:  # outside all sections
        return [*names, None], np.r_[span[0], 0], np.r_[span[1], len(text)], np.r_[tokens[1:], tokens[0]], np.r_[crossed[1:], crossed[0]]
    return names, span[0], span[1], tokens[1:], crossed[1:]


def rendered(rows: DataFrame, fields: list[str], *, id_col: str = "doc_id", between: str = "\n") -> DataFrame:
    """Rows as documents: doc_id, text (the fields one after another, ``between`` after each but the last) and sections
    (one span per field, what stands between excluded). A null field is empty."""
    value = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields}
    spans, at = [], F.lit(0).cast("long")
    for f in fields:
        end = at + F.length(value[f])
        spans.append(F.struct(F.lit(f).alias("name"), at.alias("start"), end.alias("end")))
        at = end + len(between)
    return rows.select(F.col(id_col).alias("doc_id"), F.concat_ws(between, *value.values()).alias("text"), F.array(*spans).alias("sections"))
