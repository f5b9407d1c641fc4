"""Chat formatting: conversations as budgeted, turn-aligned training windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shipped, staged

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Any "<", backslashes, "|" inside a text gets one backslash more; so no control string is left, and taking one away undoes it.
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TARGET = "assistant"
WINDOW_OUT = "conv_id long, segment long, window long, text string, turns int, repeated int, loss array<struct<start:int,end:int>>, tokens long, over_budget boolean"


def escaped(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role stands in a line of its own, so its line breaks are escaped as well."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def formatted(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The text of a window and the spans of its loss mask: the (escaped) assistant texts of the turns that are not repeated."""
    parts, loss, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role == TARGET and k >= repeated:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text."""
    turns, at = [], 0
    while at < len(text):
        head = text.index("\n", at)
        end = text.index(END, head)
        turns.append((unescaped_role(text[at + len(START) : head]), unescaped(text[head + 1 : end])))
        at = end + len(END) + 1
    return turns


def byte_tokens(role: Column, text: Column) -> Column:
    """Tokens of a turn for a byte-level model: its bytes and those of the template around it (an escape adds one now and then)."""
    return (F.octet_length(text) + F.octet_length(role) + len(START) + len(END) + 2).cast("long")


def _turns(conversations: DataFrame, tokens, bucket_turns: int) -> DataFrame:
    """The turns with their size, with ``tie`` (a hash that orders turns of one number and role) and the keys of their bucket.
    A null conv_id is two plain keys, so that joins and windows can use it."""
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.withColumns({
        "tokens": tokens(F.col("role"), F.col("text")), "tie": F.xxhash64("text"), "_conv": F.coalesce("conv_id", F.lit(0)), "_none": F.col("conv_id").isNull(),
        "_bucket": F.coalesce(F.floor(F.col("turn") / bucket_turns), F.lit(-(1 << 60))),
    })


ORDER = ("turn", "role", "tie")


def places(conversations: DataFrame, *, budget: int = 4096, history: int = 1024, segment_windows: int = 64, tokens=byte_tokens, bucket_turns: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Where long conversations are cut into segments: a staged row (_conv, _none, _bucket, entries) for each bucket of turns.

    A conversation is long if it takes ``segment_windows`` budgets or more. Prefix sums of its turns' tokens are made in two
    levels: tokens are summed by bucket, those sums run along the conversation (one row for ``bucket_turns`` turns), and
    turns run within their bucket; so no task needs a whole conversation. A segment is a stretch of ``segment_windows``
    budgets of prefix sums; turns that the next segment may need as history are ``late``. An entry is the first turn of a
    bucket, or one where segment or lateness changes. Only ids and sizes move, no texts.
    """
    keys, stretch = ["_conv", "_none", "_bucket"], budget * segment_windows
    slim = _turns(conversations, tokens, bucket_turns).select(*keys, *ORDER, "tokens")
    long = staged(slim.groupBy("_conv", "_none").agg(F.sum("tokens").alias("all")).where(F.col("all") >= stretch).select("_conv", "_none"), "long-conversations")
    slim = slim.join(F.broadcast(long) if long.count() <= broadcast_rows else long, ["_conv", "_none"], "left_semi")
    sums = slim.groupBy(*keys).agg(F.sum("tokens").alias("sum"))
    earlier = W.partitionBy("_conv", "_none").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    order = W.partitionBy(*keys).orderBy(*ORDER)
    inside = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = slim.withColumn("inside", inside).join(bases, keys).withColumn("before", F.col("base") + F.col("inside"))
    placed = placed.withColumn("segment", F.floor(F.col("before") / stretch)).withColumn("late", F.col("before") >= (F.col("segment") + 1) * stretch - history)
    place = F.struct("segment", "late")
    placed = placed.withColumn("changes", ~place.eqNullSafe(F.lag(place).over(order)))
    entry = F.struct(F.col("turn").isNotNull().alias("known"), *ORDER, "segment", "late")
    return staged(placed.where("changes").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries")), "segments")


def _short(conversations: DataFrame, found: DataFrame, tokens, broadcast_rows: int, bucket_turns: int) -> DataFrame:
    """Turns of conversations of one segment."""
    rows = _turns(conversations, tokens, bucket_turns)
    long = found.select("_conv", "_none").distinct()
    rows = rows.join(F.broadcast(long) if found.count() <= broadcast_rows else long, ["_conv", "_none"], "left_anti")
    return rows.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(0).alias("context"), *ORDER, "text", "tokens")


def _long(conversations: DataFrame, found: DataFrame, tokens, broadcast_rows: int, bucket_turns: int) -> DataFrame:
    """Turns of long conversations in their segments, with the turns before as ``context`` 1 and the system turn as 2."""
    rows = _turns(conversations, tokens, bucket_turns)
    key = lambda of: F.struct(*[of(c) for c in ("known", *ORDER)])
    own = key(lambda c: F.col("turn").isNotNull() if c == "known" else F.col(c))
    few = found.count() <= broadcast_rows
    joined = rows.join(F.broadcast(found) if few else found, ["_conv", "_none", "_bucket"])
    place = F.element_at(F.filter("entries", lambda e: key(lambda c: e[c]) <= own), -1)
    placed = joined.withColumn("place", place)
    copies = F.when(F.col("place.late"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    placed = placed.withColumn("context", F.explode(copies)).withColumn("segment", F.col("place.segment") + F.col("context"))
    long = found.select("_conv", "_none").distinct()
    mine = rows.join(F.broadcast(long) if few else long, ["_conv", "_none"], "left_semi")
    heads = mine.groupBy("_conv", "_none").agg(F.min_by(F.struct("role", "text", "tokens"), own).alias("system")).where(F.col("system.role") == "system")
    later = found.select("_conv", "_none", F.explode("entries.segment").alias("segment")).where("segment > 0").distinct()
    carried = later.join(heads, ["_conv", "_none"]).select(
        F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), "segment", F.lit(2).alias("context"), F.lit(None).cast("long").alias("turn"), F.col("system.role").alias("role"),
        F.lit(None).cast("long").alias("tie"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"),
    )
    return placed.select(carried.columns).unionByName(carried)


def windows(conversations: DataFrame, *, budget: int = 4096, history: int = 1024, segment_windows: int = 64, tokens=byte_tokens, found: DataFrame | None = None, part: str = "all", broadcast_rows: int = 1_000_000, bucket_turns: int = 256) -> DataFrame:
    """One row per training window: conv_id, segment, window, text, turns, repeated, loss, tokens, over_budget.

    Turns in order of ``turn`` (nulls first; ties by role and the text's hash) fill windows of at most ``budget`` tokens at
    turn borders, chosen by prefix sums. A window begins with the conversation's system turn (its first turn, if that is a
    system turn) and with the last whole turns before it that take ``history`` tokens at most; these ``repeated`` turns are
    context without loss. So each turn is new in one window, and each assistant text is under the loss mask once. A new turn
    that is too long for the budget with its context drops the history, and still too long stands alone after the system
    turn, whole and marked ``over_budget``: texts are never cut or dropped. ``loss`` spans are character offsets of ``text``.

    Conversations of ``segment_windows`` budgets and more are packed in segments (see ``places``; ``found`` is what it gave),
    independently, so that a huge one is many tasks' work; a task holds one window at a time. Each text moves once, to its
    segment's task: buckets' places are broadcast while they number ``broadcast_rows`` at most. ``part`` may be ``short``
    or ``long`` for the conversations of one segment or of several alone. Null texts and roles are empty; null conv_ids are
    one conversation; repeated rows are turns; an empty table gives no window. Extra columns are ignored.
    """
    if part not in ("all", "short", "long"):
        raise ValueError("part is all, short or long")
    if found is None:
        found = places(conversations, budget=budget, history=history, segment_windows=segment_windows, tokens=tokens, bucket_turns=bucket_turns, broadcast_rows=broadcast_rows)
    some = (conversations, found, tokens, broadcast_rows, bucket_turns)
    rows = _short(*some) if part == "short" else _long(*some) if part == "long" else _short(*some).unionByName(_long(*some))
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.col("context") < 2, *ORDER, "text", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out, size = None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text", "tokens", "context")]
            for conv, segment, role, text, count, context in zip(*columns, strict=True):
                if packer is None or packer.key != (conv, segment):
                    out += packer.rest() if packer else []
                    packer = Packer(conv, segment, budget, history)
                out += packer.add(role, text, count, context)
            size = sum(len(x[3]) for x in out)
            if size > 4 << 20:
                yield _batch(out)
                out = []
        out += packer.rest() if packer else []
        if out:
            yield _batch(out)

    shipped(conversations.sparkSession)
    return dealt.mapInArrow(run, WINDOW_OUT)


class Packer:
    """Fills one segment's windows, turn by turn. ``sums`` are the prefix sums of the tokens of ``turns``: those from ``begin`` on
    are in the window that is being filled, those from ``fresh`` on are new in it."""

    def __init__(self, conv: int | None, segment: int, budget: int, history: int):
        self.key, self.budget, self.history = (conv, segment), budget, history
        self.system: tuple[str, str] | None = None
        self.system_tokens = 0
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.begin = self.fresh = self.count = 0
        self.leads = False

    def add(self, role: str, text: str, tokens: int, context: int) -> list[tuple]:
        turn, out = (role, text), []
        if context == 2:
            self.system, self.system_tokens = turn, tokens
            return out
        if context == 1:
            if self.key[1] == 1 and not self.turns and turn == self.system:
                return out  # the first turn of all, which comes by itself
        elif len(self.turns) > self.fresh:
            if self.sums[-1] + tokens - self.sums[self.begin] + self.system_tokens > self.budget:
                out = [self._close()]
        else:
            self.leads = role == "system" and not self.turns and self.key[1] == self.count == 0
        if len(self.turns) == self.fresh:  # the window's first new turn, or one of the turns before
            self.begin = self._back(min(self.history, self.budget - tokens - self.system_tokens))
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        if context == 1:
            self.fresh += 1
        return out

    def _back(self, room: int) -> int:
        """The first of the last turns that take ``room`` tokens at most."""
        return bisect_left(self.sums, self.sums[-1] - room) if room >= 0 else len(self.turns)

    def _close(self) -> tuple:
        first = [self.system] if self.system else []
        turns = [*first, *self.turns[self.begin :]]
        repeated = len(first) + self.fresh - self.begin
        text, loss = formatted(turns, repeated)
        used = self.sums[-1] - self.sums[self.begin] + self.system_tokens
        row = (*self.key, self.count, text, len(turns), repeated, [{"start": a, "end": b} for a, b in loss], used, used > self.budget)
        if self.leads:  # from now on the system turn is repeated by itself
            self.system, self.system_tokens, self.leads = self.turns.pop(0), self.sums[1], False
            del self.sums[0]
        gone = self._back(self.history)
        self.turns, self.sums = self.turns[gone:], [x - self.sums[gone] for x in self.sums[gone:]]
        self.fresh = self.begin = len(self.turns)
        self.count += 1
        return row

    def rest(self) -> list[tuple]:
        return [self._close()] if len(self.turns) > self.fresh else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), span, pa.int64(), pa.bool_())
    names = ["conv_id", "segment", "window", "text", "turns", "repeated", "loss", "tokens", "over_budget"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_back(made: DataFrame, in_place: bool = False) -> DataFrame:
    """One row per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars (of all windows) and n_windows.

    A conversation's windows stream through two running SHA-256, so a task holds one window; a digest of a whole
    conversation has to be made in its order, by one task. Only new turns move there, without what windows repeat.
    ``in_place`` leaves out the shuffle: for rows straight from ``windows(part="short")``, which lie together in order.
    """
    own = ["conv_id", "segment", "window", "turns", "loss", "chars"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            turns = [[f"{role}\n{body}\n" for role, body in parsed(t)[n:]] for t, n in zip(texts, batch.column("repeated").to_pylist(), strict=True)]
            targets = [[unescaped(t[x["start"] : x["end"]]) for x in spans] for t, spans in zip(texts, batch.column("loss").to_pylist(), strict=True)]
            columns = [*(batch.column(c) for c in own[:3]), pa.array(turns, PARSED), pa.array(targets, PARSED), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for conv, turns, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "loss", "chars")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(_digests(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for turn in turns:
                    now[1] += 1
                    now[2].update(turn.encode("utf-8", "surrogatepass"))
                for target in loss:
                    now[3] += len(target)
                    now[4].update(target.encode("utf-8", "surrogatepass"))
                now[5] += chars
                now[6] += 1
            if done:
                yield _conversations(done)
        if now is not None:
            yield _conversations([_digests(now)])

    shipped(made.sparkSession)
    slim = made.select("conv_id", "segment", "window", "text", "repeated", "loss")
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    if in_place:
        return slim.mapInArrow(lambda batches: run(parse(batches)), out)
    kept = slim.mapInArrow(parse, "conv_id long, segment long, window long, turns array<string>, loss array<string>, chars long")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window").mapInArrow(run, out)


PARSED = pa.list_(pa.string())


def _digests(now: list) -> tuple:
    return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])


def _conversations(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold the template's own control strings."""
    spark: SparkSession = conversations.sparkSession
    text = f"{END}{START}assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, TARGET, text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
