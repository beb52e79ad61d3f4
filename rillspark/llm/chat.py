"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template emits text segments with loss flags."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import arrow_schema, map_arrow, picked


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles are learnt, and which role may follow which.

    A turn is `before`, with {role} for its role, its text, and `after`. The first characters of before and after and the
    escape character never stand in a text unescaped: each gets the escape character in front, which reading back takes
    off. So a text can hold any control string, and no text can end or begin a turn. moves maps a state to the next by
    role; a role without a move makes the turn an error, and the machine goes on from `resume` of that role.
    """

    before: str = "### {role}: "
    after: str = " </turn>\n"
    escape: str = "\\"
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *self.moves, *(s for m in self.moves.values() for s in m.values())})

    def control(self) -> str:
        """The characters that are escaped in texts and roles: the escape, and each with which a control string can begin or end a field."""
        return "".join(sorted({self.escape, self.before[0], self.before.partition("{role}")[2][0], self.after.strip()[0]}))

    def quoted(self, text: str) -> str:
        return text.translate({ord(c): self.escape + c for c in self.control()})

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's text segments, each with its loss flag."""
        return [(self.before.replace("{role}", self.quoted(role)), False), (self.quoted(text), role in self.learnt), (self.after, False)]

    def turn(self) -> re.Pattern:
        """What a formatted turn looks like, its role and text, still escaped, as groups."""
        a, _, b = self.before.partition("{role}")
        e = re.escape(self.escape)
        # a field runs to the first unescaped control string; what it holds of their first characters is escaped
        role, text = (f"([^{e}{re.escape(c)}]*(?:{e}.[^{e}{re.escape(c)}]*)*)" for c in (b[0], self.after.strip()[0]))
        return re.compile(f"{re.escape(a)}{role}{re.escape(b)}{text}{re.escape(self.after)}", re.DOTALL)

    def plain(self, field: str) -> str:
        """A field without its escapes."""
        return re.sub(f"{re.escape(self.escape)}(.)", r"\1", field, flags=re.DOTALL)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of each turn of a formatted conversation."""
        reader = Reader(self)
        out = list(reader.feed(formatted, []))
        reader.end()
        return [t[:2] for t in out]


class Reader:
    """Reads a formatted conversation back: its text comes in pieces, cut anywhere, and only the template says where turns end."""

    def __init__(self, template: Template):
        self.template, self.one = template, template.turn()
        self.held: list[str] = []
        self.marks: list[tuple[int, int]] = []  # of the held text, what the loss mask covers
        self.size, self.tail = 0, ""

    def feed(self, text: str, marked: list[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
        """The (role, text, text under the mask) of the turns that end within this piece; marked: the ranges of it under the mask."""
        self.marks += [(a + self.size, z + self.size) for a, z in marked]
        self.held.append(text)
        self.size += len(text)
        seam, self.tail = self.tail + text, (self.tail + text)[1 - len(self.template.after) :] if len(self.template.after) > 1 else ""
        if self.template.after not in seam:
            return  # a turn goes on
        whole, at = "".join(self.held), 0
        while m := self.one.match(whole, at):
            z = m.end()
            own: list[list[int]] = []
            for a, b in ((max(a, at), min(b, z)) for a, b in self.marks if a < z and b > at):
                if own and own[-1][1] == a:
                    own[-1][1] = b  # an escape may stand across the pieces
                else:
                    own.append([a, b])
            yield (*map(self.template.plain, m.groups()), "".join(self.template.plain(whole[a:b]) for a, b in own))
            at = z
        self.held, self.marks = [whole[at:]], [(max(a - at, 0), b - at) for a, b in self.marks if b > at]
        self.size = len(whole) - at

    def end(self) -> None:
        if self.size:
            raise ValueError("the conversation ends within a turn: " + "".join(self.held)[:200])


def format_turns(rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_id, part, at, role, segments array<struct<text, loss>>, run_end, exits array<int>, bad array<int>.

    Turns are dealt by range of (conversation, turn), so one huge conversation is formatted by many tasks; (part, at) is
    their order. The machine runs in each task from every state at once: on the last turn of a conversation in a task
    (run_end), `exits` holds the state that each state leads to and `bad` the turns in error on the way; conversations()
    composes these. Null roles and texts are empty; null ids are one conversation; equal turns go by role, then text.
    """
    template = template or Template()
    states = template.states
    n = {s: i for i, s in enumerate(states)}
    own = picked(rows, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    own = own.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("role", "text"))
    kind = own.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, part int, at bigint, role string, segments array<struct<text:string,loss:boolean>>, run_end boolean, exits array<int>, bad array<int>"
    schema = arrow_schema(ddl)
    # where a role leads from each state, and whether the turn is in error there
    resume = {r: s for m in template.moves.values() for r, s in m.items()}

    def step(role: str, exits: list[int], bad: list[int]) -> None:
        for i, s in enumerate(exits):
            to = template.moves.get(states[s], {}).get(role)
            bad[i] += to is None
            exits[i] = n[to if to is not None else resume.get(role, states[s])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        last, exits, bad = None, [], []
        held: list[tuple] = []

        def out(ready: list[tuple]) -> Iterator[pa.RecordBatch]:
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

        for b in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if last is None or last[0] != conv:
                    if held:
                        held[-1] = (*held[-1][:5], True, exits, bad)
                    exits, bad = list(range(len(states))), [0] * len(states)
                    last = (conv,)
                step(role, exits, bad)
                held.append((conv, part, at, role, [{"text": t, "loss": f} for t, f in template.segments(role, text)], False, None, None))
                at += 1
            yield from out(held[:-1])
            held = held[-1:]
        if held:
            held[-1] = (*held[-1][:5], True, exits, bad)
        yield from out(held)

    dealt = own.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_arrow(dealt, run, ddl)


def conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turns_in_error, end_state, valid) of format_turns()'s rows: one small row a task and conversation is composed.

    Rows of a null id are one conversation; equal turns are turns each; no rows give no conversations.

    valid: no turn is in error and the last state is one of the template's ends. Needs turns to be stored: it is a second
    read of the same rows.
    """
    template = template or Template()
    states = template.states
    runs = turns.where("run_end").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "exits", "bad"))).alias("runs"))
    start = F.struct(F.lit(states.index(template.start)).alias("s"), F.lit(0).alias("b"))
    done = F.aggregate("runs", start, lambda a, r: F.struct(r["exits"][a["s"]].alias("s"), (a["b"] + r["bad"][a["s"]]).alias("b")))
    end = F.array(*map(F.lit, states))[F.col("done.s")]
    found = runs.withColumn("done", done).select("conv_id", F.col("done.b").cast("bigint").alias("turns_in_error"), end.alias("end_state"))
    return found.withColumn("valid", (F.col("turns_in_error") == 0) & F.col("end_state").isin(*template.ends))


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Read stored conversations back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each.

    The pieces of a conversation go in order through a Reader, which finds its turns by the template alone, and through its
    hashes, one sequential pass by nature that holds one batch and one turn.
    """
    template = template or Template()
    kind = turns.schema["conv_id"].dataType.simpleString()
    final = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema = arrow_schema(final)

    class Digest:
        def __init__(self, conv):
            self.conv, self.reader = conv, Reader(template)
            self.n = self.learnt = self.chars = 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, segments: list[dict]) -> None:
            text, marked = "".join(s["text"] for s in segments), []
            at = 0
            for s in segments:
                if s["loss"]:
                    marked.append((at, at + len(s["text"])))
                at += len(s["text"])
            self.chars += at
            for role, said, learnt in self.reader.feed(text, marked):
                self.n += 1
                self.turns.update(f"{role}\n{said}\n".encode())
                self.learnt += len(learnt)
                self.loss.update(learnt.encode())

        def row(self) -> tuple:
            self.reader.end()
            return self.conv, self.n, self.turns.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in itertools.chain(batches, [None]):
            ready = []
            for conv, segments in zip(*(c.to_pylist() for c in b.columns)) if b is not None else ():
                if now is None or now.conv != conv:
                    if now is not None:
                        ready.append(now.row())
                    now = Digest(conv)
                now.add(segments)
            if b is None and now is not None:
                ready.append(now.row())
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "segments")
    return map_arrow(ordered, fold, final)


def sql() -> str:
    """The query over conversations in DuckDB's SQL, by the template's own rules."""
    escaped = " + ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in ("\\", "#", ":", "<"))
    in_role = escaped.replace("(text", "(role")
    return rf"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows),
walked AS (
  SELECT *, coalesce(last_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS before,
    coalesce(last_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos), 'start') AS after
  FROM placed),
checked AS (
  SELECT *, NOT ((before = 'start' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant')) AS bad FROM walked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + {in_role} + {escaped} + 15)::BIGINT AS formatted_chars,
  sum(bad::INT)::BIGINT AS turns_in_error, arg_max(after, pos) AS end_state, (sum(bad::INT) = 0 AND arg_max(after, pos) = 'assistant') AS valid
FROM checked GROUP BY conv_id
"""
