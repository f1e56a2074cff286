"""Chat formatting in budgeted windows: turn-aligned spans, system turn kept, limited history, repeated targets masked."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gramwise.llm.wordpieces import word_tokenizer
from gramwise.operators.joins import attach
from gramwise.operators.ranks import prefix
from gramwise.session import settle

# fixed values of the template
START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_MARKS = 4
"""Tokens counted for the marks of a turn."""


def escape(text: str) -> str:
    """No control string is left: one more backslash between every ``<`` and ``|`` (and backslashes) that follow it."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _header(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a window; the positions are those of the escaped text."""
    return [(_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


class _Conversation:
    """Turns of one segment in order; gives a finished window whenever the next turn no longer fits."""

    def __init__(self, budget: int, history: int, most_history: int) -> None:
        self.budget, self.history, self.most = budget, history, most_history
        self.system: tuple[str, str, int] | None = None
        self.turns: deque = deque(maxlen=most_history)  # latest turns, with the sum of tokens before each
        self.total, self.used, self.number = 0, 0, 0
        self.prefix: list[tuple[str, str, int]] = []
        self.fresh: list[tuple[str, str, int]] = []

    def context(self, turn: tuple[str, str, int], system: bool) -> None:
        """A turn of an earlier segment, for repetition only."""
        if system:
            self.system = turn
        else:
            self._remember(turn)

    def _remember(self, turn: tuple[str, str, int]) -> None:
        self.turns.append((self.total, turn))
        self.total += turn[2]

    def _open(self, turn: tuple[str, str, int]) -> None:
        """A window for ``turn``: the system turn and the longest run of latest turns within history and budget."""
        self.prefix = [self.system] if self.system else []
        room = min(self.history, self.budget - turn[2] - sum(t[2] for t in self.prefix))
        sums = [before for before, _ in self.turns]
        if room > 0 and sums:
            self.prefix += [t for _, t in list(self.turns)[bisect_left(sums, self.total - room) :] if t is not self.system]
        self.used = sum(t[2] for t in self.prefix)

    def add(self, turn: tuple[str, str, int], first: bool):
        if self.fresh and self.used + turn[2] > self.budget:
            yield self.close()
        if not self.fresh:
            self._open(turn)
        if first and turn[0] == "system":
            self.system = turn
        self.fresh.append(turn)
        self.used += turn[2]
        self._remember(turn)

    def close(self) -> tuple:
        """(window, formatted, repeated turns, turns, tokens, starts and ends of the targets)."""
        parts, at, starts, ends = [], 0, [], []
        for k, (role, text, _) in enumerate([*self.prefix, *self.fresh]):
            head, body = f"{START}{_header(role)}\n", escape(text)
            if role == "assistant" and k >= len(self.prefix):
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        out = (self.number, "".join(parts), len(self.prefix), len(self.prefix) + len(self.fresh), self.used, starts, ends)
        self.number, self.fresh = self.number + 1, []
        return out


_WINDOWS = "conv string, segment long, window long, formatted string, n_repeated int, n_turns int, n_tokens long, loss_start array<long>, loss_end array<long>"


def chat_windows(
    turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 256, most_history: int = 8, segment_turns: int = 512,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, segment, window, formatted, n_repeated, n_turns, n_tokens, loss_start, loss_end) for training.

    Turns are ordered by (turn, role, text); a null turn comes first, null texts and roles are empty, null conversation
    ids form one conversation. A window holds whole turns of at most ``budget`` tokens together (a single longer turn
    stays whole, in a window of its own); later windows repeat the conversation's system turn, if it starts with one, and
    of the latest ``most_history`` turns those within ``history`` tokens. The loss spans (code points of ``formatted``)
    cover each assistant text where it is new, never where it is repeated, and no marks.

    A conversation is cut into segments of ``segment_turns`` turns by rank, whatever the turn numbers are (epoch times,
    negative, sparse), so that a very long one is dealt to many tasks; rows of one turn number stay together. Windows
    never cross segments; the few turns to repeat and the system turn are copied to the next segment. Tasks stream over
    sorted turns and hold one window.
    """
    rows = turns.select(
        F.col(conv).cast("long").cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # rows before each turn number: running sums over range partitions of the numbers alone
    numbers = rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix(numbers, ["turn"], "n", ["conv"]).select("conv", "turn", F.floor(F.col("before") / segment_turns).cast("long").alias("segment"), "through", "total")
    ranked = settle(ranked)
    # most conversations have one segment; the others need to know which one comes next
    long = ranked.where(F.col("total") > segment_turns)
    order = Window.partitionBy("conv").orderBy("segment")
    segments = settle(long.groupBy("conv", "segment").agg(F.max("through").alias("end")).withColumn("next", F.lead("segment").over(order)))
    own = attach(rows, long.select("conv", "turn", "segment", "through"), ["conv", "turn"], "left")
    own = own.select("conv", "turn", "role", "text", F.coalesce("segment", F.lit(0).cast("long")).alias("segment"), "through")
    last = attach(own.where("through is not null"), segments.where("next is not null"), ["conv", "segment"])
    recent = last.where(F.col("through") > F.col("end") - most_history).select("conv", "turn", "role", "text", F.col("next").alias("segment"), F.lit(1).alias("kind"))
    starts = own.where("through is not null and segment = 0").groupBy("conv").agg(F.min(F.struct("turn", "role", "text")).alias("start"))
    later = segments.where("segment > 0").select("conv", "segment")
    system = attach(later, starts.where("start.role = 'system'"), ["conv"]).select("conv", "start.turn", "start.role", "start.text", "segment", F.lit(0).alias("kind"))
    whole = own.select("conv", "turn", "role", "text", "segment", F.lit(2).alias("kind")).unionByName(recent).unionByName(system)

    def stream(batches):
        encoder, key, held, first, out = word_tokenizer(tokenizer), None, None, True, []
        for batch in batches:
            for name, segment, kind, who, what in batch[["conv", "segment", "kind", "role", "text"]].itertuples(index=False):
                if held is None or (name, segment) != key:
                    if held is not None and held.fresh:
                        out.append((*key, *held.close()))
                    key, held, first = (name, segment), _Conversation(budget, history, most_history), True
                one = (who, what, _MARKS + len(encoder.ids(what)) + len(encoder.ids(who)))
                if kind < 2:
                    held.context(one, kind == 0)
                else:
                    out += [(*key, *window) for window in held.add(one, first and segment == 0)]
                first = False
            yield _frame(out)
            out = []
        if held is not None and held.fresh:
            out.append((*key, *held.close()))
        yield _frame(out)

    dealt = whole.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInPandas(stream, _WINDOWS).withColumn("conv", F.col("conv").cast("long")).withColumnRenamed("conv", conv)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "segment", "window", "formatted", "n_repeated", "n_turns", "n_tokens", "loss_start", "loss_end"])


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of each conversation as read from its windows alone, in order; a task streams over sorted windows."""

    def stream(batches):
        key, state, out = None, None, []

        def ended():
            turns, n, loss, chars, formatted = state
            return (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        for batch in batches:
            for name, text, repeated, starts, ends in batch[["conv", "formatted", "n_repeated", "loss_start", "loss_end"]].itertuples(index=False):
                if key is None or key[0] != name:
                    if key is not None:
                        out.append(ended())
                    key, state = (name,), [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for who, what, _, _ in parse(text)[repeated:]:
                    state[0].update(f"{who}\n{what}\n".encode())
                    state[1] += 1
                for a, b in zip(starts, ends, strict=True):
                    target = unescape(text[a:b])
                    state[2].update(target.encode())
                    state[3] += len(target)
                state[4] += len(text)
            yield _digests(out)
            out = []
        if key is not None:
            out.append(ended())
        yield _digests(out)

    rows = windows.select(F.col(conv).cast("string").alias("conv"), "segment", "window", "formatted", "n_repeated", "loss_start", "loss_end")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "segment", "window")
    found = rows.mapInPandas(stream, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumn("conv", F.col("conv").cast("long")).withColumnRenamed("conv", conv)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
