"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a self-join over binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import components, shipped, staged, unused, without

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: How often crowded subtrees are cut.
CUTS = 3
#: A fingerprint is hot beyond this share of all rows and this number of rows.
HOT_SHARE, HOT_ROWS = 1e-5, 1000


def levels(bits: int) -> list[tuple[int, int]]:
    """Of each cut of the tries: the bits that it fixes, and the first turn beyond it. Of so many blocks of the bits that are left,
    one more than may differ, one is equal; each cut has one turn for each choice of blocks. Three bits give blocks of
    16, 12 and 9 and turns 0 to 3, 4 to 19 and 20 to 83."""
    out, done, turns = [], 0, 0
    for cut in range(1, CUTS + 1):
        width = (64 - done) // (bits + 1)
        done, turns = done + width, turns + (bits + 1) ** cut
        out.append((width, turns))
    return out




def fingerprint(text: str | None) -> int:
    """SimHash of the text: A-Z lower-cased, words between ASCII blanks, shingles of three words with repeats.

    A bit is one if it is set in over half of the shingles' XXH64 (seed 42). Fewer than three words are one shingle;
    no word (or null) gives zero.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for block in common.word_blocks(data):
        words = carry + block
        if len(words) >= SHINGLE_WORDS:
            hashes = _shingle_hashes(words)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            total += len(hashes)
        carry = words[-(SHINGLE_WORDS - 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _shingle_hashes(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE_WORDS].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)), "<u8", len(starts))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the column ``out``: the fingerprint as a signed 64-bit integer."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, out])

    shipped(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _rotated(value: Column, by: int, width: int) -> Column:
    """The low ``width`` bits of ``value`` rotated left by ``by``."""
    if by == 0:
        return value
    turned = F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, width - by))
    return turned if width == 64 else turned.bitwiseAND(F.lit((1 << width) - 1))


def near_links(prints: DataFrame, *, bits: int = MAX_BITS, heavy: int | None = None, chunk_rows: int = 400_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) at ``bits`` or fewer differing bits, as a spanning forest of each task's links.

    Told for three bits: by the pigeonhole principle one of four 16-bit blocks of a linked pair is equal. So each of four
    tries, one with each block on top, is cut into the subtrees below its 16 top levels, where no error may have been
    spent; subtrees are independent tasks' work, and a fingerprint is sent four times, however many there are. (More bits
    make more and shorter blocks: subtrees grow and copies multiply, which is the price.) A subtree of over
    ``heavy`` fingerprints (default: 50,000, or a hundred-thousandth of all if that is more) is cut again in the same
    way by four 12-bit blocks of the other 48 bits, and what is still crowded by four 9-bit blocks of the other 36; the
    bound grows fourfold with the copies, so at most 400,000 subtrees are crowded. Within a task, node pairs of the
    subtrees are traversed together (see ``trie_pairs``). Connectivity is that of all links; links that close a circle
    within a task are left out, so a dense group gives no more rows than it has members.
    """
    heavy = max(50_000, prints.count() // 100_000) if heavy is None else heavy
    if not 1 <= bits <= 7:
        raise ValueError("bits is 1 to 7")
    blocks, cuts = bits + 1, levels(bits)
    rows = prints.select("fp", F.lit(-1).alias("turn"), F.col("fp").alias("key"))
    parts, done = [], 0
    for level, (fixed, _) in enumerate(cuts):
        width = 64 - done
        rest = F.col("key").bitwiseAND(F.lit((1 << width) - 1)) if done else F.col("key")
        head = F.shiftleft(F.shiftrightunsigned("key", width), width) if done else F.lit(0)
        turns = [F.struct(F.col("turn") * blocks + blocks + s, head.bitwiseOR(_rotated(rest, fixed * s, width))) for s in range(blocks)]
        done += fixed
        rows = rows.select("fp", F.inline(F.array(*turns))).toDF("fp", "turn", "key").withColumn("subtree", F.shiftrightunsigned("key", 64 - done))
        if level + 1 == len(cuts):
            parts.append(rows)
            break
        counts = rows.groupBy("turn", "subtree").agg(F.count("*").alias("n")).where(F.col("n") > heavy * blocks**level)
        crowded = staged(counts.select("turn", "subtree", F.lit(True).alias("crowded")), "crowded")
        if crowded.isEmpty():
            parts.append(rows)
            break
        marked = rows.join(F.broadcast(crowded), ["turn", "subtree"], "left")
        parts.append(marked.where("crowded is null").select(rows.columns))
        rows = marked.where("crowded").select("fp", "turn", "key")
    all_rows = parts[0]
    for part in parts[1:]:
        all_rows = all_rows.unionByName(part)
    dealt = all_rows.repartition("turn", "subtree").sortWithinPartitions("turn", "subtree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # whole subtrees, but for the last
        size = 0
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("turn", "subtree", "key", "fp")])
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            ends = int(last[-1]) + 1 if len(last) else 0  # where the batch's last subtree begins
            if not ends and held and (held[-1][:2, -1] != rows[:2, -1]).any():
                yield from _emit(np.concatenate(held, axis=1), bits)
                held, size = [], 0
            elif ends and size + ends >= chunk_rows:
                yield from _emit(np.concatenate([*held, rows[:, :ends]], axis=1), bits)
                held, size, rows = [], 0, rows[:, ends:]
            held.append(rows)
            size += rows.shape[1]
        if size:
            yield from _emit(np.concatenate(held, axis=1), bits)

    shipped(prints.sparkSession)
    return dealt.mapInArrow(run, "a long, b long")


def _emit(rows: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for turn in np.unique(rows[0]):
        own = rows[:, rows[0] == turn]
        depth = 0
        for width, beyond in levels(bits):
            depth += width
            if turn < beyond:
                break
        a, b = trie_pairs(own[2].view(np.uint64), own[3], depth, bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def trie_pairs(keys: np.ndarray, prints: np.ndarray, depth: int, budget: int = MAX_BITS, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of ``prints``, of the links among ``keys`` that share their top ``depth`` bits.

    The sorted keys are a binary trie: a node is a range of them. Pairs of nodes go down together, level by level; a
    step to unlike children spends one of the ``budget`` errors, and pairs beyond it are dropped with all below them.
    Pairs of single leaves are compared at once. Where the levels left are no more than the errors left, all below
    links. At most ``most`` pairs are expanded at a time; others wait on a stack.
    """
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    n = len(keys)
    heads = keys >> np.uint64(64 - depth)
    first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n]
    many = last - first > 1
    first, last = first[many], last[many]
    label = np.arange(n)
    stack = [(depth, first, last, first, last, np.zeros(len(first), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > most and len(a0) > 1:
            half = len(a0) // 2
            stack += [(d, *(x[:half] for x in (a0, a1, b0, b1, spent))), (d, *(x[half:] for x in (a0, a1, b0, b1, spent)))]
            continue
        if not len(a0):
            continue
        # all below links
        done = spent + (64 - d) <= budget
        if done.any():
            for lo, hi in ((a0[done], a1[done]), (b0[done], b1[done])):
                spread = np.repeat(np.arange(len(lo)), hi - lo)
                inside = np.arange(len(spread)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[spread]
                _union(label, a0[done][spread], inside)
        # single leaves
        single = ~done & (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            _union(label, x[near], y[near])
        go = ~done & ~single
        if not go.any():
            continue
        a0, a1, b0, b1, spent = (x[go] for x in (a0, a1, b0, b1, spent))
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)]
        count = ones[d]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, spent),
            (am, a1, bm, b1, spent),
            (a0, am, bm, b1, spent + np.int8(1)),
            tuple(x[~same] for x in (am, a1, b0, bm, spent + np.int8(1))),
        ]
        nxt = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        keep = (nxt[4] <= budget) & (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        stack.append((d + 1, *(x[keep] for x in nxt)))
    root = _roots(label)
    joined = root != np.arange(n)
    return prints[joined], prints[root[joined]]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merges the classes of x[i] and y[i]; ``label`` always points to smaller or equal positions."""
    while len(x):
        label[:] = _roots(label)
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id, the smallest doc_id that links of ``bits`` reach.

    Fingerprints are computed once and staged; equal ones are one class, so copies cost no pairs. Null and empty texts
    have fingerprint zero and link like any other. A null id gets its group's smallest id (null if the group has none).
    Repeated rows stay repeated. An empty table gives an empty result; extra columns are ignored.
    """
    prints = with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fp").drop("text")
    return grouped(staged(prints, "simhash"), bits)


def grouped(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Adds component_id to staged rows (doc_id, fp)."""
    return _named(prints, bits).select(*prints.columns, "component_id")


def clustered(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Adds ``cluster``, which is the component's own whatever the ids, to staged rows (doc_id, fp and others)."""
    return _named(prints, bits).select(*prints.columns, F.col("root").alias("cluster"))


def _named(prints: DataFrame, bits: int) -> DataFrame:
    """Adds n, root and component_id. They go to the rows of hot fingerprints by broadcast, to others by a shuffle join."""
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), bits=bits)).withColumnsRenamed({"node": "fp", "root": "root"})
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = staged(rooted.join(smallest, "root").select("fp", "n", "root", "component_id"), "simhash-named")
    hot = F.col("n") > max(HOT_ROWS, int((named.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # at most 1 / HOT_SHARE fingerprints can be hot
    marked = prints.join(F.broadcast(named.where(hot)), "fp", "left")
    others = marked.where("n is null").select(*prints.columns).join(named.where(~hot), "fp")
    return marked.where("n is not null").unionByName(others)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near copies: of each group the row of the smallest id stays, all columns as they were.

    Where every id is one row's (a count over the staged ids tells), the rows to go are named by id and whole rows stay
    in place. Where ids repeat, rows carry their fingerprint along, and the pair names a row; rows that share the kept
    row's id and fingerprint then stay with it (exact dedup, which runs before, leaves none).
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(with_fingerprint(own, "text", "fp").drop("text"), "simhash")
    groups = staged(grouped(prints, bits), "simhash-groups")
    if prints.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without(docs, F.col(f"`{id_col}`"), groups.where("not (doc_id <=> component_id)").select("doc_id"))
    mark = unused("fp", docs)
    own_id, own_fp = unused("_id", docs), unused("_fp", docs)
    stay = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(own_id), F.col("fp").alias(own_fp)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_fp))
    return with_fingerprint(docs, text_col, mark).join(stay, same, "left_semi").drop(mark)
