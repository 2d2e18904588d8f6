"""Operator 9, chat formatting with a grammar round trip.

Grammar of a formatted conversation, read by `Parser` alone:
    conversation := "<s>" turn* ;  turn := "[INST role]" text "[/INST]"  |  "[OUT role]" text "</s>"
A turn of the role `assistant` is an OUT turn, whose text is under the loss mask. Inside a text or a
role a backslash makes the next character ordinary; the strings of CONTROL never occur there bare.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

BEGIN = "<s>"
OPEN = {True: "[OUT ", False: "[INST "}
CLOSE = {True: "</s>", False: "[/INST]"}
CONTROL = re.compile(r"<s>|</s>|\[/?INST|\[OUT |\\")
ROLE_CONTROL = re.compile(r"[\\\]]")
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn's string and where its text starts and ends in it."""
    out = role == "assistant"
    if escaped:
        role, text = ROLE_CONTROL.sub(lambda m: "\\" + m[0], role), CONTROL.sub(lambda m: "\\" + m[0], text)
    head = f"{OPEN[out]}{role}]"
    return head + text + CLOSE[out], len(head), len(head) + len(text)


class Malformed(ValueError):
    pass


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


BARE_ROLE = re.compile(r"(?:[^\\\]]|\\.)*", re.S)
BARE_TEXT = re.compile(r"(?:[^\\<\[]|\\.|<(?!/?s>)|\[(?!/?INST|OUT ))*+", re.S)


def parse_turn(s: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, end) of the turn at `at`; anything else than the grammar allows is Malformed."""
    out = s.startswith(OPEN[True], at)
    if not out and not s.startswith(OPEN[False], at):
        raise Malformed(f"no turn at {at}")
    m = BARE_ROLE.match(s, at + len(OPEN[out]))
    if s[m.end() : m.end() + 1] != "]":
        raise Malformed(f"no end of the role at {m.end()}")
    role = unescape(m[0])
    t = BARE_TEXT.match(s, m.end() + 1)
    if not s.startswith(CLOSE[out], t.end()) or out != (role == "assistant"):
        raise Malformed(f"no end of the text at {t.end()}")
    return role, unescape(t[0]), t.end() + len(CLOSE[out])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """render() whose result parses back to (role, text): bare if that is enough, escaped otherwise."""
    for escaped in (False, True):
        s, a, b = render(role, text, escaped)
        try:
            if (escaped or "\\" not in role + text) and parse_turn(s) == (role, text, len(s)):
                return s, a, b
        except Malformed:
            pass
    raise Malformed("a turn does not survive its round trip")


def format_turns(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with segment, the turn's part of the formatted conversation,
    and loss_from and loss_to, where its text under the loss mask lies in it (null if none does).

    A conversation is BEGIN and its segments by turn. Every segment was parsed and compared with its
    source, escaped where they differed. Row by row, so a conversation of any length is spread out.
    Null roles and texts are empty; extra columns stay away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            loss = [(a, e) if r == "assistant" else (None, None) for r, (_, a, e) in zip(roles, made, strict=True)]
            cols = [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([m[0] for m in made], pa.string()), pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "text", "segment", "loss_from", "loss_to"])

    cols = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "conv_id long, turn long, role string, text string, segment string, loss_from long, loss_to long")


def read_back(segments: DataFrame) -> DataFrame:
    """A row per conversation, from the formatted strings alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a conversation come sorted (turn, then segment; null turns first) and are parsed one
    after another with a running digest, so a task holds one turn and never a conversation; a null
    conv_id is a conversation too. A digest follows one sequence, so one conversation stays in one
    task, which streams it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, False
        n = chars = loss_chars = 0
        turns = loss = hashlib.sha256()
        done: list[tuple] = []

        def end() -> None:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, s, lo, hi in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not have or conv != now:
                    if have:
                        end()
                    now, have, n, chars, loss_chars = conv, True, 0, len(BEGIN), 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text, last = parse_turn(s)
                if last != len(s):
                    raise Malformed(f"text after the turn in {conv}")
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    under = unescape(s[lo:hi])
                    loss.update(under.encode("utf-8", "surrogatepass"))
                    loss_chars += len(under)
                n, chars = n + 1, chars + len(s)
            if len(done) > 5000:
                yield out()
        if have:
            end()
        yield out()

    cols = segments.select("conv_id", "turn", "segment", "loss_from", "loss_to")
    dealt = cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(extra)))
