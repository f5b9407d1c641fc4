"""Conversation prefix trie: conversations are sequences of dictionary-encoded turns, split turn by turn until a bucket is one task's work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shipped, staged

#: Conversations whose ids share the quotient by this begin alike: those of its first one's turns that their hash asks for, less than HEADS.
GROUP, HEADS = 20, 4
#: Turns of a bucket that a task finishes, and of a stretch of a long chain.
LOCAL_TURNS, STRETCH = 200_000, 65_536
#: A turn is hot beyond this share of all turns and this number of them.
HOT_SHARE, HOT_ROWS = 1e-5, 1000
WORD = r"[^\x20\x09-\x0D]+"
NODES = "top boolean, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
#: Stands for the null conv_id, which is larger than all others.
NONE = (1 << 63) - 1


def ordered_turns(conversations: DataFrame, *, bucket_turns: int = 256) -> DataFrame:
    """(conv, at, digest, words) of each turn: its place in its conversation from 0, by turn (null first), then by role and the text's
    hash; the digest of role and text; the words of the text. Places go in two levels, within stretches of turn numbers and by
    the stretches' counts, so a conversation may be many tasks' work. Null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("tie"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    ).withColumn("stretch", F.coalesce(F.floor(F.col("turn") / bucket_turns), F.lit(-(1 << 60))))
    earlier = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    passed = own.groupBy("conv", "stretch").agg(F.count("*").alias("n")).select("conv", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"))
    within = F.row_number().over(W.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "tie", "digest"))
    return own.withColumn("within", within).join(passed, ["conv", "stretch"]).select("conv", (F.col("passed") + F.col("within") - 1).alias("at"), "digest", "words")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.when(conv == NONE, F.lit(0)).otherwise(F.crc32(conv.cast("string").cast("binary")) % HEADS)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, words) of rebuilt conversations, positions from 1, and all of them as (conv): those without a turn have no row in
    the first. A group's first turns go to its at most ``GROUP`` conversations."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", shared_turns(F.col("conv")))
    base = F.when(F.col("conv") != NONE, F.col("conv") - F.pmod("conv", F.lit(GROUP)))
    convs = staged(convs.select("conv", "h", base.alias("base")), "trie-conversations")
    heads = staged(turns.where((F.col("conv") != NONE) & (F.pmod("conv", F.lit(GROUP)) == 0) & (F.col("at") < HEADS - 1)).withColumnRenamed("conv", "base"), "trie-heads")
    taken = convs.join(heads, "base").where("at < h").select("conv", (F.col("at") + 1).alias("pos"), "digest", "words")
    had = convs.join(heads.groupBy("base").agg(F.count("*").alias("n")), "base", "left").select("conv", "h", F.least(F.col("h"), F.coalesce("n", F.lit(0))).alias("kept"))
    own = turns.withColumn("h", shared_turns(F.col("conv"))).where("at >= h")
    shifted = had.where("h <> kept").select("conv", (F.col("h") - F.col("kept")).alias("gap"))  # the group's first one has fewer turns
    placed = own.join(shifted, "conv", "left").select("conv", (F.col("at") + 1 - F.coalesce("gap", F.lit(0))).alias("pos"), "digest", "words")
    return placed.unionByName(taken), convs.select("conv")


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, rep, copies, len): conversations of one sequence of turns share ``rep``, their smallest. A sequence is known by its length and
    128 bits over its (place, turn) pairs, which add up with map-side partials, whatever its length."""
    marks = [F.bit_xor(F.xxhash64("pos", "digest", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    known = turns.groupBy("conv").agg(F.count("*").alias("len"), *marks)
    every = staged(convs.join(known, "conv", "left").na.fill(0, ["len", "mark0", "mark1"]), "trie-marks")
    key = ["len", "mark0", "mark1"]
    groups = every.groupBy(*key).agg(F.min("conv").alias("rep"), F.count("*").alias("copies"))
    many = groups.where("copies > 1")
    hot = many.where(F.col("copies") > HOT_ROWS)
    # conversations of hot sequences get theirs by broadcast where these are few, so they do not meet in one task
    few = hot.count() <= 1_000_000
    marked = every.join(F.broadcast(hot) if few else hot, key, "left")
    rest = marked.where("copies is null").select(*every.columns).join(groups.where(F.col("copies") <= HOT_ROWS), key)
    return marked.where("copies is not null").unionByName(rest).select("conv", "rep", "copies", "len")


def encoded(turns: DataFrame) -> DataFrame:
    """(rep, pos, id, words): turns by the number that the dictionary of all different turns has for them. The dictionary is written
    once, so its numbers stay; those of hot turns go out by broadcast."""
    held = staged(turns.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    hot = F.col("n") > max(HOT_ROWS, int((held.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # at most 1 / HOT_SHARE turns can be hot
    marked = turns.join(F.broadcast(held.where(hot).select("digest", "id")), "digest", "left")
    rest = marked.where("id is null").drop("id").join(held.where(~hot).select("digest", "id"), "digest")
    return marked.where("id is not null").unionByName(rest).select("rep", "pos", "id", "words")


def end_digests(sequences: DataFrame) -> DataFrame:
    """(rep, ends_sha256): the digest of the decimal ids of each sequence's conversations, ascending, comma-joined. It has to be made in
    order: the ids of one sequence stream through one task, which holds none of them."""
    name = F.when(F.col("conv") != NONE, F.col("conv").cast("string")).otherwise("null")
    alone = sequences.where("copies = 1").select("rep", F.sha2(name, 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for rep, conv in zip(batch.column("rep").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if rep != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = rep, hashlib.sha256(conv.encode())
                else:
                    digest.update(b"," + conv.encode())
            if done:
                yield _rows(done, "rep long, ends_sha256 string")
        if now is not None:
            yield _rows([(now, digest.hexdigest())], "rep long, ends_sha256 string")

    shipped(sequences.sparkSession)
    many = sequences.where("copies > 1").select("rep", "conv", name.alias("name")).repartition("rep").sortWithinPartitions("rep", "conv").select("rep", "name")
    return alone.unionByName(many.mapInArrow(run, "rep long, ends_sha256 string"))


def _rows(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names = [k.split() for k in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def multikey_nodes(depth: int, parent: int | None, found: list[tuple[int, int, list[int], list[int]]]) -> list[tuple]:
    """The nodes of a bucket: sequences (rep, copies, ids, words) that share their first turn, which ends at ``depth``.

    Multikey quicksort: at a place, sequences are parted into those with a smaller, an equal and a larger turn than the
    pivot; the equal ones are a child node and go on at the next place, the others stay at this one. A node is emitted
    when its sequences are known, before its children, so sums over subtrees run backwards over the nodes.
    """
    nodes: list[list] = []
    waiting: list[tuple[list, int, int | None]] = [(found, 1, None)]  # sequences equal up to a place, that place, the node above
    splits: list[tuple[list, int, int]] = []
    while waiting or splits:
        if splits:
            some, place, above = splits.pop()
            if not some:
                continue
            pivot = some[len(some) // 2][2][place]
            lower, equal, higher = [], [], []
            for x in some:
                key = x[2][place]
                (equal if key == pivot else lower if key < pivot else higher).append(x)
            splits += [(lower, place, above), (higher, place, above)]
            waiting.append((equal, place + 1, above))
            continue
        some, place, above = waiting.pop()
        while True:
            own = len(nodes)
            copies = sum(x[1] for x in some)
            ends = next((x[0] for x in some if len(x[2]) == place), None)
            tokens = (copies - 1) * some[0][3][place - 1] if place else 0
            nodes.append([min(x[0] for x in some), depth + place - 1, above, copies, 0, 0, tokens, ends])
            if above is not None:
                nodes[above][4] += 1
            if len(some) > 1:
                splits.append(([x for x in some if len(x[2]) > place], place, own))
                break
            if ends is not None:  # a single sequence goes on to its end
                break
            place, above = place + 1, own
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] is not None:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    return [(n[2] is None, n[0], n[1], parent if n[2] is None else nodes[n[2]][0], n[3], n[4], n[5], n[6], n[7]) for n in nodes]


def finished(tails: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of local buckets: ``tails`` has (rep, bucket, depth, parent, copies). A bucket's turns from its depth on meet in
    one task, LOCAL_TURNS at most."""
    rows = turns.join(tails, "rep").where("pos >= depth").select("bucket", "depth", "parent", "rep", "copies", "pos", "id", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            out: list[tuple] = []
            for bucket, depth, parent, rep, copies, turn, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "depth", "parent", "rep", "copies", "id", "words")), strict=True):
                if now is None or (bucket, depth) != now[:2]:
                    if found:
                        out += multikey_nodes(*now[1:], found)
                    now, found = (bucket, depth, parent), []
                if not found or found[-1][0] != rep:
                    found.append((rep, copies, [], []))
                found[-1][2].append(turn)
                found[-1][3].append(words)
            if out:
                yield _rows(out, NODES)
        if found:
            yield _rows(multikey_nodes(*now[1:], found), NODES)

    shipped(turns.sparkSession)
    return rows.repartition("bucket", "depth").sortWithinPartitions("bucket", "depth", "rep", "pos").mapInArrow(run, NODES)


def _sums_below(rows: DataFrame, key: str, value: Column, stretch: int) -> DataFrame:
    """Adds ``below``: the sum of ``value`` over a key's rows from this ``depth`` on, in two levels, so that a key may have very many rows."""
    cut = rows.withColumn("_stretch", F.floor(F.col("depth") / stretch)).withColumn("_value", value)
    later = W.partitionBy(key).orderBy(F.desc("_stretch")).rowsBetween(W.unboundedPreceding, -1)
    bases = cut.groupBy(key, "_stretch").agg(F.sum("_value").alias("_all")).select(key, "_stretch", F.coalesce(F.sum("_all").over(later), F.lit(0)).alias("_base"))
    inside = W.partitionBy(key, "_stretch").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cut.withColumn("_inside", F.sum("_value").over(inside)).join(bases, [key, "_stretch"]).withColumn("below", F.col("_base") + F.col("_inside")).drop("_stretch", "_value", "_inside", "_base")


def chains(tails: DataFrame, turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The nodes of buckets of one sequence that is too long for a task: each turn is a node."""
    rows = turns.join(tails, "rep").where("pos >= depth").select("rep", F.col("depth").alias("top"), "parent", "copies", "len", F.col("pos").alias("depth"), "words")
    summed = _sums_below(rows, "rep", (F.col("copies") - 1) * F.col("words"), stretch)
    ends, top = F.col("depth") == F.col("len"), F.col("depth") == F.col("top")
    return summed.select(
        top.alias("top"), F.col("rep").alias("conv_id"), F.col("depth").cast("int").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("below").alias("saved_tokens"),
        F.when(ends, F.col("rep")).alias("ends"),
    )


def split(assigned: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the radix partition: ``assigned`` has (rep, bucket, depth, parent, words, copies, len) of buckets of at least two sequences.

    A bucket's sequences share their turns up to the first place at which the smallest and the largest id differ or a sequence has
    ended; there they part by their turn. Gives the nodes of the shared stretch (bucket, depth, words) with the bucket's facts,
    the children (bucket, id, child, n_seqs, n_convs, turns, words, depth) and the sequences that go on (rep, bucket, id).
    """
    beyond = turns.join(assigned.select("rep", "bucket", "depth", "len"), "rep").where("pos > depth")
    facts = assigned.groupBy("bucket", "depth", "parent", "words").agg(F.count("*").alias("n_seqs"), F.sum("copies").alias("n_convs"))
    levels = staged(beyond.groupBy("bucket", "pos").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.min("words").alias("words")), "trie-levels")
    parting = levels.join(facts.select("bucket", "n_seqs"), "bucket").where("low <> high or n < n_seqs").groupBy("bucket").agg(F.min("pos").alias("at"))
    parted = staged(facts.join(parting, "bucket"), "trie-parted")
    shared = levels.select("bucket", F.col("pos").alias("level"), F.col("words").alias("own")).join(parted, "bucket").where("level < at")
    tops = parted.select("*", F.col("depth").alias("level"), F.col("words").alias("own"))
    chain = tops.unionByName(shared.select(tops.columns))
    going = staged(beyond.join(parted.select("bucket", "at"), "bucket").where("pos = at").select("rep", "bucket", "id", "words", "pos", (F.col("len") - F.col("pos") + 1).alias("turns")), "trie-going")
    children = going.join(assigned.select("rep", "copies"), "rep").groupBy("bucket", "id").agg(
        F.min("rep").alias("child"), F.count("*").alias("n_seqs"), F.sum("copies").alias("n_convs"), F.sum("turns").alias("turns"), F.min("words").alias("words"), F.min("pos").alias("depth")
    )
    return chain, staged(children, "trie-children"), going


def trie(turns: DataFrame, found: DataFrame, *, local_turns: int = LOCAL_TURNS, stretch: int = STRETCH) -> DataFrame:
    """All nodes of sequences: ``turns`` has (rep, pos, id, words), ``found`` (rep, copies, len) of each different sequence. Gives ``NODES`` without top.

    The root's bucket is parted by the first turn, a child's bucket by the next one, and so on; a round moves only the
    buckets that are still larger than ``local_turns``. Runs that a bucket's sequences share are passed over in one
    round, so a round always parts its buckets. Buckets that fit a task, and chains, are finished; then what they hold is
    added up along the rounds, from the last to the first.
    """
    root = found.agg(F.min("rep")).first()[0]
    if root is None:
        return found.sparkSession.createDataFrame([], NODES).drop("top")
    top = {"bucket": F.lit(root), "depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long"), "words": F.lit(0)}
    assigned = staged(found.withColumns(top), "trie-assigned")
    if found.limit(2).count() == 1:  # one sequence: the root and its chain
        first = found.withColumns({"bucket": F.lit(root), "depth": F.lit(1).cast("long"), "parent": F.lit(root)})
        return _rolled([(_single_root(found), None)], [chains(first, turns, stretch)], stretch)
    rounds: list[tuple[DataFrame, DataFrame]] = []
    tails, long = [], []
    while True:
        chain, children, going = split(assigned, turns)
        rounds.append((chain, _ended(assigned, chain)))
        facts = children.select(F.col("bucket").alias("parent"), "id", F.col("child").alias("bucket"), "depth", "words", "n_seqs", "turns")
        large = facts.where((F.col("n_seqs") > 1) & (F.col("turns") > local_turns))
        count = large.count()  # each has local_turns at least
        next_to = going.select("rep", F.col("bucket").alias("parent"), "id").join(found, "rep")
        chosen = F.broadcast(large) if count <= 100_000 else large
        small = next_to.join(chosen.select("parent", "id"), ["parent", "id"], "left_anti").join(facts.where((F.col("n_seqs") == 1) | (F.col("turns") <= local_turns)), ["parent", "id"])
        small = staged(small, "trie-tails")
        tails.append(small.where(F.col("turns") <= local_turns).select("rep", "bucket", "depth", "parent", "copies"))
        long.append(small.where(F.col("turns") > local_turns).select("rep", "bucket", "depth", "parent", "copies", "len"))
        if not count:
            break
        assigned = staged(next_to.join(chosen, ["parent", "id"]).select("rep", "copies", "len", "bucket", "depth", "parent", "words"), "trie-assigned")
    done = [finished(reduce(DataFrame.unionByName, tails), turns), chains(reduce(DataFrame.unionByName, long), turns, stretch)]
    return _rolled(rounds, done, stretch)


def _single_root(found: DataFrame) -> DataFrame:
    """The root above one sequence, as the chain of a bucket that is parted at the first place."""
    none = F.lit(None).cast("long")
    return found.select(F.col("rep").alias("bucket"), F.lit(0).cast("long").alias("depth"), none.alias("parent"), F.lit(0).alias("words"), F.lit(1).cast("long").alias("n_seqs"),
                        F.col("copies").alias("n_convs"), F.lit(1).cast("long").alias("at"), F.lit(0).cast("long").alias("level"), F.lit(0).alias("own"), F.when(F.col("len") == 0, F.col("rep")).alias("ended"))


def _ended(assigned: DataFrame, chain: DataFrame) -> DataFrame:
    """(bucket, ended): the sequence that ends where its bucket parts, one at most."""
    at = chain.where("level = at - 1").select("bucket", "at")
    return assigned.join(at, "bucket").where("len = at - 1").select("bucket", F.col("rep").alias("ended"))


def _rolled(rounds: list[tuple[DataFrame, DataFrame | None]], done: list[DataFrame], stretch: int) -> DataFrame:
    """Finished nodes and those of the rounds' chains, whose sums over subtrees come from the tops below them."""
    every = staged(reduce(DataFrame.unionByName, done), "trie-nodes")
    nodes = [every]
    top = lambda rows: rows.where("top").select(F.col("parent_conv_id").alias("bucket"), F.col("depth").cast("long").alias("at"), "n_leaves", "saved_tokens")
    tops = top(every)
    for chain, ended in reversed(rounds):
        if ended is not None:
            chain = chain.join(ended, "bucket", "left")
        below = tops.groupBy("bucket", "at").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("beneath"))
        rows = chain.join(below, ["bucket", "at"], "left").withColumnsRenamed({"depth": "first", "level": "depth"})
        summed = _sums_below(rows, "bucket", (F.col("n_convs") - 1) * F.col("own"), stretch)
        first, last = F.col("depth") == F.col("first"), F.col("depth") == F.col("at") - 1
        made = staged(summed.select(
            first.alias("top"), F.col("bucket").alias("conv_id"), F.col("depth").cast("int").alias("depth"), F.when(first, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("below") + F.coalesce("beneath", F.lit(0))).alias("saved_tokens"), F.when(last, F.col("ended")).alias("ends"),
        ), "trie-rolled")
        nodes.append(made)
        tops = tops.unionByName(top(made))
    return reduce(DataFrame.unionByName, nodes).drop("top")


def prefix_trie(conversations: DataFrame, *, local_turns: int = LOCAL_TURNS, stretch: int = STRETCH) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A node is a distinct sequence of the first ``depth`` turns (role, text) of some conversation; ``conv_id`` is the smallest of
    those that begin with it, which with the depth names it. See ``rebuilt`` for what a conversation takes from the first of
    its group of twenty, ``split`` and ``multikey_nodes`` for how nodes are found. Equal conversations are one sequence
    with a count from the start, so copies cost no more than one; a first turn that very many share parts like any other.

    Null roles and texts are empty; turns without a number come first; turns of one number go by role and text; repeated
    rows are turns of their own. Rows without a conv_id are one conversation, larger than all others, that takes nothing from
    another; its id is null, and ``null`` in a digest. An empty table has no node, not even a root. Extra columns are ignored.
    Texts enter as digests and word counts, so very long ones are no matter.
    """
    ordered = staged(ordered_turns(conversations.select("conv_id", "turn", "role", "text")), "trie-turns")
    turns, convs = rebuilt(ordered)
    turns = staged(turns, "trie-rebuilt")
    found = staged(sequences(turns, convs), "trie-sequences")
    different = staged(found.where("conv = rep").select("rep", "copies", "len"), "trie-different")
    of_each = turns.withColumnRenamed("conv", "rep").join(different.select("rep"), "rep", "left_semi")
    nodes = trie(staged(encoded(of_each), "trie-encoded"), different, local_turns=local_turns, stretch=stretch)
    ending = nodes.where("ends is not null").join(end_digests(found).withColumnRenamed("rep", "ends"), "ends")
    shown = ending.unionByName(nodes.where("ends is null"), allowMissingColumns=True)
    name = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return shown.select(name("conv_id"), F.col("depth").cast("long").alias("depth"), name("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
