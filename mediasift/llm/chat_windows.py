"""Chat conversations as training texts: budgeted windows of whole turns with a loss mask.

A turn is written as ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline. In roles and texts a backslash is doubled and
``<|`` gets one in between (in roles a newline becomes backslash n), so no text can look like a mark and everything can
be read back.

A conversation is cut into windows of at most ``budget`` tokens at turns, chosen by prefix sums of turn tokens: the next
window takes as many new turns as fit beside what it repeats, which is the conversation's system turn and the last turns
before the window, up to ``history`` tokens. Repeated turns are not under the loss; every assistant text is a target once.
History gives way to a new turn that would not fit beside it; a turn that does not fit even alone is a window of its own,
marked ``over_budget`` (turns are never cut).

A conversation may hold a third of all rows. Turns are put in order by one range exchange, tokens are summed inside
partitions and the sums of partitions are added to the one conversation that each partition continues. Conversations are
then dealt out in chapters of ``CHAPTER`` budgets, by the prefix sum; a chapter also gets the system turn and the turns
that its first window may repeat. A window ends where its chapter ends, so chapters are worked on apart.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import Scratch, range_sorted
from .shared import text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
TARGET, SYSTEM = "assistant", "system"
CHAPTER = 64
PIECE = 65_536  # characters that are tokenized at once


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def head(role: str) -> str:
    return START + escape(role).replace("\n", "\\n") + "\n"


class TokenCounter:
    """Tokens of a turn as it is written, by a file of the tokenizers library; without one, words and single signs.

    Long texts are counted in pieces of a fixed length, so that memory does not grow with the text.
    """

    def __init__(self, definition: str | None):
        self.library = None
        if definition is not None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(definition)
            self.library.no_padding()
            self.library.no_truncation()
            self.library.encode_special_tokens = True

    def __call__(self, text: str) -> int:
        return max(1, sum(self._count(text[at : at + PIECE]) for at in range(0, len(text), PIECE)))

    def _count(self, text: str) -> int:
        if self.library is None:
            return len(re.findall(r"\w+|[^\w\s]", text))
        return len(self.library.encode(text, add_special_tokens=False).ids)


def _written_turns(sent):
    """Turns as they are written, with their tokens and the tokens before them in this conversation and partition."""

    def run(batches):
        count = TokenCounter(sent.value if sent is not None else None)
        last, total = object(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                before, tokens, heads, written = [], [], [], []
                for conversation, role, text in zip(part.column("conv").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if conversation != last:
                        last, total = conversation, 0
                    start = head(role)
                    turn = start + escape(text) + END
                    n = count(turn)
                    before.append(total)
                    tokens.append(n)
                    heads.append(len(start))
                    written.append(turn)
                    total += n
                yield pa.record_batch(
                    [part.column(c) for c in ("conv", "_part", "_row", "role")] + [pa.array(before, pa.int64()), pa.array(tokens, pa.int64()), pa.array(heads, pa.int32()), pa.array(written, pa.string())],
                    ["conv", "_part", "_row", "role", "before", "tokens", "head", "turn"])

    return run


def cut(sizes: np.ndarray, first_new: int, system: int, budget: int, history: int, system_at: int) -> list[tuple[int, int, int, bool]]:
    """Windows ``(history from, new from, new to, repeats the system turn)`` over turns of these sizes.

    ``first_new``: turns before it belong to the chapter before. ``system``: tokens of the system turn (0: none), which
    stands at ``system_at`` (negative: in an earlier chapter).
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    windows, at = [], first_new
    while at < len(sizes):
        repeat = system > 0 and system_at < at
        fixed = system if repeat else 0
        room = min(history, budget - fixed - int(sizes[at]))  # the next new turn comes first
        back = int(np.searchsorted(sums, sums[at] - max(room, 0), side="left"))
        back = min(back, at)
        if repeat and back <= system_at:
            back = system_at + 1  # the system turn stands at the front already
        used = fixed + int(sums[at] - sums[back])
        to = int(np.searchsorted(sums, sums[at] + budget - used, side="right")) - 1
        to = max(to, at + 1)
        windows.append((back, at, to, repeat))
        at = to
    return windows


def _chapter_windows(budget: int, history: int):
    """Windows of whole chapters; the rows of a chapter come together: system turn (0), history (1), own turns (2)."""

    def windows(conversation, rows):
        system = rows[0] if rows and rows[0]["kind"] == 0 else None
        turns = [r for r in rows if r["kind"] > 0]
        first_new = sum(r["kind"] == 1 for r in turns)
        system_at = -1
        if system is None:  # in this chapter, or nowhere
            for i, r in enumerate(turns):
                if r["is_system"]:
                    system, system_at = r, i
                    break
        else:  # it may also be among the turns of the chapter before
            for i, r in enumerate(turns[:first_new]):
                if r["starts_at"] == system["starts_at"]:
                    system_at = i
        sizes = np.array([r["tokens"] for r in turns], np.int64)
        for back, at, to, repeat in cut(sizes, first_new, system["tokens"] if system else 0, budget, history, system_at):
            shown = ([system] if repeat else []) + turns[back:at]
            length, loss = sum(len(r["turn"]) for r in shown), []
            for r in turns[at:to]:
                if r["target"]:
                    loss.append({"from": length + r["head"], "to": length + len(r["turn"]) - len(END)})
                length += len(r["turn"])
            new = turns[at:to]
            tokens = sum(r["tokens"] for r in shown + new)
            yield {"conv": conversation, "starts_at": new[0]["starts_at"], "formatted": "".join(r["turn"] for r in shown + new), "loss": loss,
                   "n_repeated": len(shown), "n_new": len(new), "tokens": tokens, "over_budget": tokens > budget}

    def run(batches):
        schema = None
        for rows in _groups(batches, ("conv", "chapter")):
            if schema is None:
                schema = pa.schema([("conv", rows[0][0]), ("starts_at", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                                    ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("tokens", pa.int64()), ("over_budget", pa.bool_())])
            made = list(windows(rows[1]["conv"], rows[1:]))
            for at in range(0, len(made), 64):
                yield pa.RecordBatch.from_pylist(made[at : at + 64], schema=schema)

    return run


def _groups(batches, keys):
    """Lists of the rows of a group, which lie together; the first entry is the Arrow type of the first key."""
    rows, key = [], None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in part.to_pylist():
                own = tuple(row[k] for k in keys)
                if rows and own != key:
                    yield rows
                    rows = []
                if not rows:
                    rows, key = [(part.schema.field(keys[0]).type,)], own
                rows.append(row)
    if rows:
        yield rows


def chat_windows(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 budget: int = 2048, history: int = 512, tokenizer: str | None = None) -> DataFrame:
    """One row per window: ``conv, starts_at, formatted, loss, n_repeated, n_new, tokens, over_budget``.

    ``starts_at`` is the count of the conversation's tokens before the first new turn, ``loss`` the spans of code points
    (from, to) under the loss, ``n_repeated`` the number of turns at the front that are repeated. Turns are ordered by
    ``turn`` (nulls first), then role and text; rows that repeat wholly are turns each. Null roles and texts are empty,
    null conversations are one conversation. Other columns are not read. An empty table gives no windows.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    spark = rows.sparkSession
    scratch, sent = Scratch(spark), None
    if tokenizer is not None:
        with open(tokenizer, encoding="utf-8") as file:
            sent = spark.sparkContext.broadcast(file.read())  # a tokenizer file has a fixed size of some MB
    taken = rows.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"), text_or_empty(F.col(text)).alias("text"))
    taken = scratch.write(taken.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("salt", F.monotonically_increasing_id()))
    kind = taken.schema["conv"].dataType.simpleString()
    ordered = range_sorted(taken, ["conv", "turn", "role", "digest", "salt"]).select("conv", "_part", "_row", "role", "text")
    turns = scratch.write(ordered.mapInArrow(_written_turns(sent), f"conv {kind}, _part int, _row long, role string, before long, tokens long, head int, turn string"))
    scratch.drop(taken)
    # Only its first conversation does a partition continue, so there is at most one row per partition that is not 0.
    sums = turns.groupBy("_part", "conv").agg(F.sum("tokens").alias("tokens"))
    earlier = F.sum("tokens").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.withColumn("carried", earlier).where("carried > 0").select(F.col("_part").alias("c_part"), F.col("conv").alias("c_conv"), "carried")
    placed = turns.join(F.broadcast(carried), (F.col("_part") == F.col("c_part")) & F.col("conv").eqNullSafe(F.col("c_conv")), "left")
    chapter = CHAPTER * budget
    placed = placed.select("conv", (F.coalesce("carried", F.lit(0)) + F.col("before")).alias("starts_at"), "tokens", "head", "turn",
                           (F.col("role") == SYSTEM).alias("is_system"), (F.col("role") == TARGET).alias("target"))
    placed = placed.withColumn("chapter", F.floor(F.col("starts_at") / chapter)).withColumn("kind", F.lit(2))
    repeated = placed.where(F.col("starts_at") >= (F.col("chapter") + 1) * chapter - history).withColumn("chapter", F.col("chapter") + 1).withColumn("kind", F.lit(1))
    # The first system turn, for the chapters behind its own.
    systems = placed.where("is_system").groupBy("conv").agg(F.min("starts_at").alias("starts_at"))
    later = placed.where("chapter > 0").select(F.col("conv").alias("l_conv"), F.col("chapter").alias("l_chapter")).distinct()
    columns = placed.columns
    first = placed.where("is_system").alias("p").join(systems.alias("s"), F.col("p.conv").eqNullSafe(F.col("s.conv")) & (F.col("p.starts_at") == F.col("s.starts_at"))).select("p.*")
    sent_on = first.join(later, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("l_chapter") > F.col("chapter")))
    sent_on = sent_on.withColumn("chapter", F.col("l_chapter")).withColumn("kind", F.lit(0)).select(columns)
    own = placed.unionAll(repeated.select(columns)).unionAll(sent_on)
    # History that runs on into a chapter in which no turn starts would be a group without own turns: cut() makes no window of it.
    dealt = own.repartition("conv", "chapter").sortWithinPartitions("conv", "chapter", "kind", "starts_at")
    schema = f"conv {kind}, starts_at long, formatted string, loss array<struct<from:long,to:long>>, n_repeated int, n_new int, tokens long, over_budget boolean"
    return dealt.mapInArrow(_chapter_windows(budget, history), schema)


def _read_back(batches):
    """Digests of what windows say, in their order; only hash states are kept, however long a conversation is."""
    last, state = object(), None

    def row():
        conversation, n, turns, chars, loss, length = state
        return {"conv": conversation, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

    kind = None
    for batch in batches:
        done = []
        kind = batch.schema.field("conv").type
        for at in range(0, batch.num_rows, 64):
            for window in batch.slice(at, 64).to_pylist():
                if state is None or window["conv"] != last:
                    if state is not None:
                        done.append(row())
                    last, state = window["conv"], [window["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = window["formatted"]
                for i, found in enumerate(TURN.finditer(text)):
                    if i >= window["n_repeated"]:
                        state[1] += 1
                        state[2].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                for span in window["loss"]:
                    target = unescape(text[span["from"] : span["to"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_digest_schema(kind))
    if state is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=_digest_schema(kind))


def _digest_schema(kind):
    return pa.schema([("conv", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(windows: DataFrame) -> DataFrame:
    """``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: what the windows of every conversation say.

    Turns and targets are parsed from ``formatted``. A digest follows a conversation from its first to its last character,
    so a conversation's windows pass through one task, as a stream of which a batch is held at a time.
    """
    dealt = windows.select("conv", "starts_at", "formatted", "loss", "n_repeated").repartition("conv").sortWithinPartitions("conv", "starts_at")
    kind = windows.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(_read_back, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
