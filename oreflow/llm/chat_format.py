"""Chat formatting in budgeted windows of whole turns.

Prefix sums of the turns' tokens choose windows of at most ``budget`` tokens,
the repeated turns and all marks included.  A later window begins with the
conversation's system turn (left out only where it and the window's first own
turn don't fit), repeats at most ``history`` tokens of the turns before it, as
far as there is room, and takes the following turns while they fit.  A turn
longer than the budget gets a window of its own, whole, with nothing else in
it.  Repeated turns are outside the loss mask, so each assistant turn is a
target exactly once.

A turn is written ``<|role|>\\n text <|end|>\\n`` with a sign inside any part of a text
that could be read as a mark, and the role percent-encoded, so the turns can be
read back exactly; a window row also holds the loss mask as spans of code points.

The turns are dealt into ranges of (conversation, turn), which count their
tokens, and the sums of the ranges give each turn its place in tokens, so a
conversation with a third of all rows is many tasks.  Spans of ``SPAN`` budgets, each with the turns before it that
it may repeat and the system turn, are then cut into windows one by one.

Null text is the empty text, a null role is an empty one, ties of turn are
ordered by role and text, repeated rows are turns of their own, rows of a null
``conv_id`` are one conversation, and an empty table gives no windows.
Columns beside the four used are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import common, tokens

BUDGET, HISTORY = 2048, 512
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Marks of this and other templates; the sign goes behind the first character of each, and of each already signed.
MARKS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SIGN = "\\"
_SIGNED = re.compile("|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in MARKS))

WINDOW = "conv_id bigint, window bigint, text string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_tokens bigint"


def escape(text: str) -> str:
    """``text`` with one more sign in every mark, signed or not: no control string is left, and nothing is lost."""
    return _SIGNED.sub(lambda m: m[0][0] + SIGN + m[0][1:], text)


def unescape(text: str) -> str:
    return _SIGNED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == SIGN else m[0], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's form, and where its text and closing mark begin and end in it."""
    head = f"{OPEN}{quote(role, safe=' ')}{CLOSE}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(r"<\|([^|<>\n]*)\|>\n([\s\S]*?)<\|end\|>\n")


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text) of each turn of a window."""
    return [(unquote(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


#: Budgets of a span: the turns that are cut into windows together.
SPAN = 16
Turn = tuple[str, str, int, int]  # role, text, tokens of the written form, tokens before it


class Span:
    """Cuts the turns of one span into windows, given the turns before it and the conversation's system turn."""

    def __init__(self, conv: int | None, budget: int, history: int, system: Turn | None, past: list[Turn]):
        self.conv, self.budget, self.history, self.system, self.past = conv, budget, history, system, past
        self.size = 0
        self.repeated: list[Turn] = []
        self.own: list[Turn] = []

    def add(self, turn: Turn) -> tuple | None:
        """Takes a turn; the row of the window that it closes, if any."""
        row = self.close() if self.own and self.size + turn[2] > self.budget else None
        if not self.own:
            self._open(turn)
        if turn[0] == "system" and self.system is None:
            self.system = turn
        self.own.append(turn)
        self.size += turn[2]
        return row

    def _open(self, first: Turn) -> None:
        """Chooses what the window repeats whose first own turn is ``first``."""
        room = self.budget - first[2]
        self.repeated = []
        if self.system and self.system[3] < first[3] and self.system[2] <= room:
            self.repeated, room = [self.system], room - self.system[2]
        recent, left, behind = [], min(self.history, room), first[3]
        for t in reversed(self.past):  # the latest turns that fit, up to one that isn't here
            if t[3] + t[2] != behind or t[2] > left or any(t[3] == x[3] for x in self.repeated):
                break
            recent.insert(0, t)
            left, behind = left - t[2], t[3]
        self.repeated += recent
        self.size = sum(t[2] for t in self.repeated)

    def close(self) -> tuple:
        """The window's row; its last turns are kept as history."""
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _, _) in enumerate(self.repeated + self.own):
            form, a, z = write_turn(role, text)
            if k >= len(self.repeated) and role == "assistant":
                starts.append(at + a)
                ends.append(at + z)
            parts.append(form)
            at += len(form)
        row = (self.conv, self.own[0][3], "".join(parts), starts, ends, len(self.repeated), self.size)
        kept, held = [], 0
        for t in reversed(self.past + self.own):
            if held + t[2] > self.history:
                break
            kept.insert(0, t)
            held += t[2]
        self.past, self.own = kept, []
        return row


_NAMES = ("conv_id", "window", "text", "loss_starts", "loss_ends", "n_repeated", "n_tokens")
_PLACED = "conv_id bigint, role string, text string, n int, start bigint, part int, first boolean, edge array<bigint>"


def _placed(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, role, text, n, start``: the tokens of each turn's written form, and of those before it in the conversation.

    Turns are dealt into ranges, ties in the order of role and text; each
    range counts and adds up its own.  A row for each range (its first and
    last conversation and their sums) tells what the ranges before it hold.
    """
    spark = turns.sparkSession
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def count(enc: tokens.PieceEncoder, b: pa.RecordBatch) -> list[int]:
        # The line's end behind a turn is a token of its own, whatever follows.
        forms = [write_turn(r, x)[0][:-1] for r, x in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
        return [len(x) // 4 + 1 for x in enc.encode(forms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = tokens.encoder(tokenizer)
        part, total, opened, first, conv, of_first = TaskContext.get().partitionId(), 0, False, None, None, 0
        for b in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            starts, firsts, sizes = [], [], count(enc, b)
            for c, n in zip(b.column("conv_id").to_pylist(), sizes, strict=True):
                if not opened:
                    opened, first, conv = True, c, c
                elif c != conv:
                    conv, total = c, 0
                starts.append(total)
                firsts.append(c == first)
                total += n
                if c == first:
                    of_first = total
            size = len(starts)
            own = {name: b.column(name) for name in ("conv_id", "role", "text")}
            yield own | {"n": sizes, "start": starts, "part": [part] * size, "first": firsts, "edge": [None] * size}
        if opened:
            yield {"conv_id": [None], "role": [None], "text": [None], "n": [None], "start": [None], "part": [part], "first": [None], "edge": [[first, of_first, conv, total]]}

    found = common.saved(common.map_rows(dealt, run, _PLACED), "placed-turns")
    # One row for each range, as many as configured.
    offsets, carried, last, seen = [], 0, None, False
    for r in sorted(found.where("edge is not null").select("part", "edge").collect(), key=lambda r: r["part"]):
        first, of_first, conv, total = r["edge"]
        offset = carried if seen and last == first else 0
        offsets.append((r["part"], offset))
        carried, last, seen = (offset + of_first if conv == first else total), conv, True
    before = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    start = F.col("start") + F.when(F.col("first"), F.col("before")).otherwise(0)
    return found.where("edge is null").join(before, "part").select("conv_id", "role", "text", "n", start.alias("start"))


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows of :data:`WINDOW` for all conversations in ``turns`` (conv_id, turn, role, text); ``window`` is the number of tokens before its first own turn."""
    span = SPAN * budget
    placed = _placed(turns, tokenizer).withColumn("span", F.floor(F.col("start") / span))
    columns = ["conv_id", "span", "kind", "role", "text", "n", "start"]
    own = placed.withColumn("kind", F.lit(2)).select(*columns)
    reach = F.floor((F.col("start") + F.col("n") + history) / span)
    # A turn over the history is never repeated, so it stays in its own span.
    past = placed.where((reach > F.col("span")) & (F.col("n") <= history)).withColumn("span", F.explode(F.sequence(F.col("span") + 1, reach))).withColumn("kind", F.lit(1)).select(*columns)
    # The system turn goes to each later span of its conversation.
    key = F.struct("conv_id").alias("conv")
    system = placed.where("role = 'system'").groupBy(key).agg(F.min(F.struct("start", "role", "text", "n")).alias("turn"))
    later = placed.where("span > 0").select(key, "span").distinct()
    # Of one that no window has room for, only its place and size go on.
    text = F.when(F.col("turn")["n"] < budget, F.col("turn")["text"]).otherwise("")
    systems = common.looked_up(later, system, "conv").where("turn is not null").select("conv.conv_id", "span", F.lit(0).alias("kind"), "turn.role", text.alias("text"), "turn.n", "turn.start")

    rows = own.unionByName(past).unionByName(systems).repartition("conv_id", "span")
    dealt = rows.sortWithinPartitions("conv_id", "span", "kind", "start", "role", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # A span's rows come one after another: the system turn, the turns before it, its own.
        key: tuple | None = None
        s: Span | None = None
        turns: dict[int, list[Turn]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found = []
                b = whole.slice(at, 512)
                for conv, number, kind, role, text, n, start in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                    if key != (conv, number):
                        if s is not None:
                            found.append(s.close())
                        key, s, turns = (conv, number), None, {0: [], 1: []}
                    if kind < 2:
                        turns[kind].append((role, text, n, start))
                        continue
                    if s is None:
                        s = Span(conv, budget, history, next(iter(turns[0]), None), turns[1])
                    if (row := s.add((role, text, n, start))) is not None:
                        found.append(row)
                if found:
                    yield dict(zip(_NAMES, map(list, zip(*found, strict=True)), strict=True))
        if s is not None:
            yield dict(zip(_NAMES, map(list, zip(s.close(), strict=True)), strict=True))

    return common.map_rows(dealt, cut, WINDOW)


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, their digest, the loss text's digest and the size."""
    dealt = found.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        s: list | None = None

        def done(s: list) -> tuple:
            conv, n, turns, chars, loss, size, count = s
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if s is None or s[0] != r["conv_id"]:
                    if s is not None:
                        rows.append(done(s))
                    s = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in read_turns(r["text"])[r["n_repeated"] :]:
                    s[1] += 1
                    s[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, z in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    own = unescape(r["text"][a:z])
                    s[3] += len(own)
                    s[4].update(own.encode("utf-8", "surrogatepass"))
                s[5] += len(r["text"])
                s[6] += 1
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
        if s is not None:
            yield dict(zip(names, map(list, zip(done(s), strict=True)), strict=True))

    return common.map_rows(
        dealt, run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = windows(turns, tokens.tokenizer_path("byte_bpe_50k.json"))
    written.write.parquet(path := common.fresh_path(spark, "chat-windows"))
    return read_back(spark.read.schema(WINDOW).parquet(path))
