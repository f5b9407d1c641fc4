"""Quality classifier: a linear-chain conditional random field marks every line good or bad."""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, unused, word_blocks

#: Byte classes whose shares of a line are features.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t",
    b".,;:?'\"()-",
    b"!",
    b"|",
    b"*%$#&@^~_=+<>[]{}\\/`",
    bytes(range(128, 256)),
)
OWN = len(CLASSES) + 5
#: Columns of a line's own features after the shares.
LENGTH, EMPTY, REPEATED, ECHO, CAPITALS = range(len(CLASSES), OWN)
#: Lines, and bytes of whole lines, that are scored at a time (a longer line alone).
PIECE_LINES, PIECE_BYTES = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Model:
    """``unary``: weights of a line's features for the state good (bad has none). ``step[i, j]``: weight of state j after i."""

    unary: np.ndarray
    step: np.ndarray


def untrained() -> Model:
    return Model(np.zeros(3 * OWN + 1), np.zeros((2, 2)))


def _class_of_bytes() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k
    return table


CLASS_OF = _class_of_bytes()


def own_features(lines: list[bytes]) -> np.ndarray:
    """Features of each line by itself: its byte-class shares, length, emptiness, the share of its words that equal the
    word before and the share of capitals among its letters (being repeated is a matter of its text, and zero here)."""
    own = np.zeros((len(lines), OWN))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = len(CLASSES) + 1
    if len(lines) == 1:
        data = np.frombuffer(lines[0], np.uint8)
        counts = sum((np.bincount(CLASS_OF[data[at : at + PIECE_BYTES]], minlength=kinds) for at in range(0, len(data), PIECE_BYTES)), np.zeros(kinds, np.int64))[None, :]
    else:
        kind = CLASS_OF[np.frombuffer(b"".join(lines), np.uint8)]
        counts = np.bincount(np.repeat(np.arange(len(lines)) * kinds, size) + kind, minlength=len(lines) * kinds).reshape(-1, kinds)
    own[:, : len(CLASSES)] = counts[:, :-1] / np.maximum(size, 1)[:, None]
    own[:, LENGTH] = np.log1p(size) / 8
    own[:, EMPTY] = size == 0
    own[:, ECHO] = np.fromiter(map(_echo, lines), float, len(lines))
    own[:, CAPITALS] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    return own


def _echo(line: bytes) -> float:
    total, equal, last = 0, 0, None
    for words in word_blocks(line):
        total += len(words)
        equal += sum(map(eq, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
    return equal / total if total else 0.0


def _coded(lines: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct lines, and which of them each line is."""
    distinct = list(dict.fromkeys(lines))
    index = dict(zip(distinct, range(len(distinct)), strict=True))
    return distinct, np.fromiter(map(index.__getitem__, lines), np.int64, len(lines))


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All lines, the number of lines of each text, and whether a line's text has it again."""
    lines: list[bytes] = []
    again: list[bool] = []
    count = []
    for text in texts:
        parts = text.split(b"\n")
        seen = Counter(parts)
        again += [seen[x] > 1 for x in parts]
        lines += parts
        count.append(len(parts))
    return lines, np.array(count, np.int64), np.array(again, float)


def _starts(count: np.ndarray) -> np.ndarray:
    first = np.zeros(count.sum(), bool)
    first[np.cumsum(count) - count] = True
    return first


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines of all texts, and the number of lines of each text.

    A line's own features (and whether its text has it again); then those of the line before and of the line after
    (zeros at the ends); then one.
    """
    lines, count, again = _split(texts)
    distinct, code = _coded(lines)
    own = own_features(distinct)[code]
    own[:, REPEATED] = again
    head = np.cumsum(count) - count
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[head] = 0
    after[head + count - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), count


def _moves(good: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The matrix [i, j] of each line: the weight of its state j after state i of the line before; of a text's first line
    the same whatever comes before."""
    top = np.maximum(good, 0)
    unary = np.stack([np.exp(-top), np.exp(good - top)], axis=1)
    moves = np.exp(step - step.max())[None] * unary[:, None, :]
    moves[first] = unary[first][:, None, :]
    return moves


def _messages(moves: np.ndarray, start: np.ndarray, width: int = 64) -> np.ndarray:
    """``start`` times the product of the matrices up to each line, scaled to a sum of one.

    Lines are cut into stretches of ``width``; the products inside of all stretches run side by side, and only one vector
    for each stretch is carried on in turn.
    """
    n = len(moves)
    width = max(1, min(width, n))
    rows = -(-n // width)
    padded = np.concatenate([moves.reshape(n, 4), np.broadcast_to(np.eye(2).ravel(), (rows * width - n, 4))])
    inside = np.ascontiguousarray(padded.reshape(rows, width, 4).transpose(1, 2, 0))
    for k in range(1, width):
        a, b = inside[k - 1], inside[k]
        product = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
        inside[k] = product / product.sum(axis=0)
    starts, (x, y) = [], start.tolist()
    for p, q, r, s in inside[-1].T.tolist():
        starts.append((x, y))
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x, y = np.array(starts).T
    out = np.stack([x * inside[:, 0] + y * inside[:, 2], x * inside[:, 1] + y * inside[:, 3]], axis=2).transpose(1, 0, 2).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


def _back(moves: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The weight of all that comes after each line, by the line's state; ``end`` is that of the last line."""
    turned = np.concatenate([np.eye(2)[None], moves[:0:-1].transpose(0, 2, 1)])
    return _messages(turned, end)[::-1]


ONES = np.ones(2)


def marginals(good: np.ndarray, step: np.ndarray, lines: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: each line's probability of being good, and (with ``pairs``) the expected
    counts of the four steps. ``good`` is each line's score of the state good, ``lines`` the number of lines of each text."""
    counts = np.zeros((2, 2))
    if not len(good):
        return np.zeros(0), counts
    first = _starts(lines)
    moves = _moves(good, step, first)
    forward, backward = _messages(moves, ONES), _back(moves, ONES)
    both = forward * backward
    if pairs and not first.all():
        at = np.flatnonzero(~first)
        joint = forward[at - 1][:, :, None] * moves[at] * backward[at][:, None, :]
        counts = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both[:, 1] / both.sum(axis=1), counts


def fit(texts: list[bytes], quality: np.ndarray, *, rounds: int = 2, iterations: int = 120, rate: float = 0.1, penalty: float = 1e-5) -> Model:
    """Conditional likelihood by gradient steps. Only whole texts have labels, so lines begin with their text's label;
    after each round lines of bad texts that the model holds for good (over 0.9) are relabelled, and it is fitted again.
    Without texts of both kinds the model is untrained (all scores one half), and a warning says so."""
    if len(set(quality.tolist())) < 2:
        warnings.warn("no labelled texts of both kinds: the quality model is untrained", stacklevel=2)
        return untrained()
    x, lines = line_features(texts)
    spread = np.maximum(x.std(axis=0), 1e-3)
    spread[-1] = 1
    x = x / spread
    text_label = np.repeat(quality.astype(float), lines)
    label, model = text_label, untrained()
    at = np.flatnonzero(~_starts(lines))
    for again in range(rounds):
        seen = np.array([[((label[at - 1] == i) & (label[at] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
        params = np.r_[model.unary, model.step.ravel()]
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, iterations + 1):
            unary, step = params[:-4], params[-4:].reshape(2, 2)
            share, counts = marginals(x @ unary, step, lines, pairs=True)
            slope = np.r_[(label - share) @ x, (seen - counts).ravel()] / len(x) - penalty * params
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            params = params + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        model = Model(params[:-4], params[-4:].reshape(2, 2))
        if again + 1 < rounds:
            share, _ = marginals(x @ model.unary, model.step, lines)
            label = np.where((text_label == 0) & (share > 0.9), 1.0, text_label)
    return Model(model.unary / spread, model.step)


def score(texts: list[bytes], model: Model) -> np.ndarray:
    """Each text's quality: its lines' probabilities of being good, weighted by their lengths (the line break included).
    An empty text is one empty line. Texts beyond one piece are scored piece by piece."""
    out = np.zeros(len(texts))
    held: list[int] = []
    lines = size = 0
    for k, text in enumerate([*texts, None]):
        count = text.count(b"\n") + 1 if text is not None else 0
        if held and (text is None or lines + count > PIECE_LINES or size + len(text) > PIECE_BYTES):
            out[held] = _score_short([texts[h] for h in held], model)
            held, lines, size = [], 0, 0
        if text is None:
            break
        if count > PIECE_LINES or len(text) > PIECE_BYTES:
            out[k] = _score_long(text, model)
        else:
            held.append(k)
            lines, size = lines + count, size + len(text)
    return out


def _parts(distinct: list[bytes], code: np.ndarray, again: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What each line adds to the score of itself, of the line after and of the line before; and the lines' weights."""
    weights = model.unary[:-1].reshape(3, OWN).T
    size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1.0
    return (own_features(distinct) @ weights)[code] + again[:, None] * weights[REPEATED], size[code]


def _score_short(texts: list[bytes], model: Model) -> np.ndarray:
    lines, count, again = _split(texts)
    own, weight = _parts(*_coded(lines), again, model)
    head = np.cumsum(count) - count
    before, after = np.roll(own[:, 1], 1), np.roll(own[:, 2], -1)
    before[head] = 0
    after[head + count - 1] = 0
    share, _ = marginals(own[:, 0] + before + after + model.unary[-1], model.step, count)
    return np.add.reduceat(share * weight, head) / np.add.reduceat(weight, head)


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of whole lines, without the line break behind them: PIECE_LINES lines and PIECE_BYTES bytes at most, or one line."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at <= len(text):
        end = len(text) if at + PIECE_BYTES >= len(text) else text.rfind(b"\n", at, at + PIECE_BYTES + 1)
        if end < 0:
            end = text.find(b"\n", at + PIECE_BYTES)
            end = len(text) if end < 0 else end
        breaks = np.flatnonzero(data[at:end] == 10)
        if len(breaks) >= PIECE_LINES:
            end = at + int(breaks[PIECE_LINES - 1])
        yield at, end
        at = end + 1


def _repeated(text: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Sorted hashes of the lines that the text has twice or more; it holds one hash for each distinct line of a piece."""
    once, twice = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a, b in spans:
        seen = Counter(text[a:b].split(b"\n"))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        once.append(hashes)
        twice.append(hashes[np.fromiter(seen.values(), np.int64, len(seen)) > 1])
    hashes, count = np.unique(np.concatenate(once), return_counts=True)
    return np.union1d(hashes[count > 1], np.concatenate(twice))


def _score_long(text: bytes, model: Model) -> float:
    """The score of one text, piece by piece. A first pass carries the forward message and keeps it at each piece's border;
    a second one goes from the last piece to the first, makes each piece's forward messages again and carries the backward one."""
    spans = list(_pieces(text))
    repeated = _repeated(text, spans)

    def parts(k: int) -> tuple[np.ndarray, np.ndarray]:
        distinct, code = _coded(text[spans[k][0] : spans[k][1]].split(b"\n"))
        again = np.isin(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)), repeated)
        return _parts(distinct, code, again[code].astype(float), model)

    def moves(k: int, own: np.ndarray, before: float, after: float) -> np.ndarray:
        good = own[:, 0] + np.r_[before, own[:-1, 1]] + np.r_[own[1:, 2], after] + model.unary[-1]
        first = np.zeros(len(own), bool)
        first[0] = k == 0
        return _moves(good, model.step, first)

    borders = np.zeros((len(spans) + 1, 2))  # what the line before a piece gives its first line, and the line after its last
    starts = [ONES]
    own, _ = parts(0)
    for k in range(len(spans)):
        following = parts(k + 1)[0] if k + 1 < len(spans) else np.zeros((1, 3))
        borders[k + 1, 0], borders[k, 1] = own[-1, 1], following[0, 2]
        starts.append(_messages(moves(k, own, *borders[k]), starts[k])[-1].copy())
        own = following
    total = size = 0.0
    end = ONES
    for k in reversed(range(len(spans))):
        own, weight = parts(k)
        own_moves = moves(k, own, *borders[k])
        backward = _back(own_moves, end)
        both = _messages(own_moves, starts[k]) * backward
        total += float((both[:, 1] / both.sum(axis=1)) @ weight)
        size += float(weight.sum())
        end = own_moves[0] @ backward[0]
        end = end / end.sum()
    return total / size


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000, sample_lines: int = 100, sample_chars: int = 16384) -> Model:
    """Fits the model on ``sample_docs`` labelled rows at most: those of the smallest hashes of their ids among the rows of
    ``docs`` that have a label and are outside the held-out fifth. A longer text gives ``sample_lines`` lines from a place
    that its id's hash chooses, ``sample_chars`` characters at most; so what reaches the driver is bounded (these are bounds
    of the sample; scoring has none). Ids with contradicting labels are left out."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("other")).where("q = other")
    known = known.where(~held_out(F.col("doc_id"))).select("doc_id", "q")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    taken = 2 * sample_docs
    while True:  # more candidates only where too few of the first have a document
        some = F.broadcast(known.orderBy(*order).limit(taken)) if taken <= 1_000_000 else known
        chosen = [r[0] for r in own.join(some, "doc_id").select("doc_id").distinct().orderBy(*order).limit(sample_docs).collect()]
        if len(chosen) == sample_docs or taken > 1_000_000 or known.limit(taken).count() < taken:
            break
        taken *= 8
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("doc_id", known.schema["doc_id"].dataType)]))
    lines = F.split("text", "\n", -1)
    at = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.size(lines) - sample_lines + 1, F.lit(1))).cast("int")
    stretch = F.substring(F.array_join(F.slice(lines, at + 1, sample_lines), "\n"), 1, sample_chars)
    rows = own.join(F.broadcast(ids.join(known, "doc_id")), "doc_id").select("doc_id", "q", stretch.alias("text"))
    sample = rows.orderBy(*order, F.xxhash64("text")).limit(sample_docs).select(F.col("text").cast("binary").alias("text"), "q").toPandas()
    return fit([bytes(t) for t in sample["text"]], sample["q"].to_numpy())


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, every row's quality from its whole text (null: the empty text)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(texts, model))], names=[*batch.schema.names, out])

    shipped(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 where the score is at least ``threshold``).

    Only the text is an input of a score. Null and empty texts get the score of one empty line; repeated rows stay
    repeated; an empty table gives an empty result; without usable labels every score is one half. Extra columns are
    ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(own, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rows that ``classify`` predicts as bad, all columns as they were."""
    out = unused("score", docs)
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return with_score(docs, model, text_col, out).where(F.col(out) >= threshold).drop(out)
