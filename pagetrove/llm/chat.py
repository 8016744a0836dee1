"""Chat formatting in budgeted windows.

Turns are marked by control strings; the same strings inside roles and texts are escaped reversibly.
Prefix sums of turn tokens cut a conversation into turn-aligned spans: a span ends where the next turn
would take its window over the budget. A window holds the system turn, a limited history repeated from
before, and its own span; only assistant texts of its own span are under the loss mask, so every target
appears once. A conversation is dealt in stretches of turns, each with the system turn and the history
that it starts with, so one that holds most rows is spread over tasks.
"""

import hashlib
import os
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.llm.common import keep_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BUDGET, HISTORY = 2048, 256
STRETCH = 256     # turns dealt together
LAST = 2**22      # number of the last stretch, which takes all turns beyond and those without a number
WINDOWS = 2**40   # more than a stretch can have; window numbers of a stretch start at its multiple
TARGET = "assistant"


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``: no control string is left, and unescape drops it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line, so line ends and backslashes are escaped too."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted window."""
    found = re.findall(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", formatted, re.S)
    return [(unescape_role(r), unescape(t)) for r, t in found]


def measured(turns: DataFrame, tokenizer=TOKENIZER) -> DataFrame:
    """``conv_id, turn, role, text, n`` with the tokens of each formatted turn; nulls count as empty."""
    from tokenizers import Tokenizer
    sent = turns.sparkSession.sparkContext.broadcast(Tokenizer.from_file(tokenizer).to_str())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Tokenizer.from_str(sent.value)
        encoder.encode_special_tokens = True
        for batch in batches:
            formatted = [turn_text(r, t)[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            sizes = [len(encoder.encode(x, add_special_tokens=False).ids) for x in formatted]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "n"])
    return rows.mapInArrow(run, "conv_id BIGINT, turn BIGINT, role STRING, text STRING, n BIGINT")


SYSTEM, BEFORE, OWN = 0, 1, 2  # kinds of rows, in the order a stretch gets them


def dealt_turns(sized: DataFrame, history=HISTORY) -> DataFrame:
    """``conv_id, stretch, kind, turn, role, text, n``: what every stretch of turns needs for its windows.

    A stretch is an even range of turn numbers, turns without a number come last. It gets the system
    turn of its conversation, the turns that close the stretch before (``history`` tokens at most) and
    its own turns.
    """
    names = ["conv_id", "stretch", "kind", "turn", "role", "text", "n"]
    stretch = F.greatest(F.lit(-LAST), F.least(F.floor(F.col("turn") / STRETCH), F.lit(LAST)))
    rows = sized.withColumn("stretch", F.coalesce(stretch, F.lit(LAST)).cast("long"))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    first = rows.groupBy("conv_id").agg(F.min(F.struct("stretch", F.col("turn").isNull(), "turn", "role", "text", "n")).alias("f")).filter(
        "f.role = 'system'").select(F.col("conv_id").alias("c"), F.col("f.stretch").alias("from"), F.col("f.text").alias("text"), F.col("f.n").alias("n"))
    there = rows.select("conv_id", "stretch").distinct()
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    lead = there.join(first, same).select("conv_id", "stretch", F.lit(SYSTEM).alias("kind"), F.when(F.col("stretch") == F.col("from"), 0).cast(
        "long").alias("turn"), F.lit("system").alias("role"), "text", "n")
    following = there.select(F.col("conv_id").alias("c2"), F.col("stretch").alias("s2"),
                             F.lead("stretch").over(Window.partitionBy("conv_id").orderBy("stretch")).alias("next"))
    local = Window.partitionBy("conv_id", "stretch").orderBy(*order)
    # From the end: all turns of the stretch less those before this one.
    whole = F.sum("n").over(Window.partitionBy("conv_id", "stretch"))
    left = whole - F.sum("n").over(local.rowsBetween(Window.unboundedPreceding, -1))
    tails = rows.withColumns({"left": F.coalesce(left, whole), "nth": F.row_number().over(local)}).filter(F.col("left") <= history)
    tails = tails.join(first.select("c", "from"), same, "left").filter(~F.coalesce((F.col("nth") == 1) & (F.col("stretch") == F.col("from")), F.lit(False)))
    tails = tails.join(following.filter("next IS NOT NULL"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("stretch") == F.col("s2")))
    tails = tails.select("conv_id", F.col("next").alias("stretch"), F.lit(BEFORE).alias("kind"), "turn", "role", "text", "n")
    return rows.withColumn("kind", F.lit(OWN)).select(*names).unionByName(tails).unionByName(lead)


class Former:
    """Windows of one stretch, turn by turn; holds one window and the turns that may be repeated."""

    def __init__(self, budget, history, number):
        self.budget, self.history = budget, history
        self.system, self.skip, self.count = None, False, number
        self.past, self.own, self.used = deque(), [], 0

    def take(self, kind, turn, role, text, n):
        """A row of the stretch; gives the window it closes, if it closes one."""
        if kind == SYSTEM:
            self.system, self.skip = (role, text, n), turn is not None  # the stretch starts with the system turn itself
            return None
        if kind == BEFORE:
            self._remember(role, text, n)
            return None
        closed = None
        if self.own and self.used + n > self.budget:
            closed = self.close()
        if not self.own:
            self.lead = [self.system] if self.system and not self.skip else []
            room = self.budget - n - sum(t[2] for t in self.lead)
            before = list(self.past) if not self.skip else []
            while before and sum(t[2] for t in before) > room:
                before.pop(0)
            self.lead += before
            self.used = sum(t[2] for t in self.lead)
        self.own.append((role, text))
        self.used += n
        if self.skip:
            self.skip = False
        else:
            self._remember(role, text, n)
        return closed

    def _remember(self, role, text, n):
        self.past.append((role, text, n))
        while sum(t[2] for t in self.past) > self.history:
            self.past.popleft()

    def close(self):
        """``(number, formatted, loss, repeated)`` of the window that is open."""
        text, loss, size = [], [], 0
        for k, (role, body) in enumerate([t[:2] for t in self.lead] + self.own):
            turn, start, end = turn_text(role, body)
            if role == TARGET and k >= len(self.lead):
                loss.append({"start": size + start, "end": size + end})
            text.append(turn)
            size += len(turn)
        out = (self.count, "".join(text), loss, len(self.lead))
        self.own, self.used, self.count = [], 0, self.count + 1
        return out


def windows(turns: DataFrame, budget=BUDGET, history=HISTORY, tokenizer=TOKENIZER) -> DataFrame:
    """Formatted windows: ``conv_id, window, formatted, loss, repeated``, in order of ``window``.

    ``loss`` lists the places (start, end) of the target texts in code points, ``repeated`` counts the
    leading turns that an earlier window has too. A window keeps the budget wherever its turn and the
    system turn fit together; a longer turn is never cut and has a window of its own. Turns come in order
    of their number (null last), then role and text; null roles and texts count as empty, null ids are
    one conversation, repeated rows are turns of their own. Other columns are ignored; an empty table
    gives no windows.
    """
    dealt = dealt_turns(keep_table(measured(turns, tokenizer), "turns"), history)
    rows = dealt.repartition("conv_id", "stretch").sortWithinPartitions(
        "conv_id", "stretch", "kind", F.col("turn").asc_nulls_last(), "role", "text")
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64())
    names = ["conv_id", "window", "formatted", "loss", "repeated"]

    def run(batches):
        now, former = None, None

        def given(out):
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        for batch in batches:
            out = []
            for conv, stretch, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "stretch", "kind", "turn", "role", "text", "n")], strict=True):
                if former is None or (conv, stretch) != now:
                    if former and former.own:
                        out.append((now[0], *former.close()))
                    now, former = (conv, stretch), Former(budget, history, stretch * WINDOWS)
                closed = former.take(*row)
                if closed:
                    out.append((conv, *closed))
            yield given(out)
        if former and former.own:
            yield given([(now[0], *former.close())])
    return rows.mapInArrow(run, "conv_id BIGINT, window BIGINT, formatted STRING, "
                                "loss ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, repeated BIGINT")


def read_back(formed: DataFrame) -> DataFrame:
    """One row per conversation, from its windows alone: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows``.

    Windows stream by in order, so a long conversation is never held whole.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        now, any_yet = None, False

        def done():
            conv, n, turns, chars, loss, size, count = now
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count)
        for batch in batches:
            out = []
            for conv, text, loss, repeated in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "repeated")], strict=True):
                if not any_yet or conv != now[0]:
                    if any_yet:
                        out.append(done())
                    now, any_yet = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                for role, body in read_turns(text)[repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for place in loss:
                    target = unescape(text[place["start"]:place["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
                now[6] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), types, strict=True)], names)
    dealt = formed.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, "
                                 "loss_sha256 STRING, formatted_chars BIGINT, n_windows BIGINT")
