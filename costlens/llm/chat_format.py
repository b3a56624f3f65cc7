"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_chat`` turns rows of turns into text segments with a loss flag;
``read_back`` parses segments into turns again. Control strings inside texts
are escaped by a backslash before them (and before backslashes), so parsing
the output gives exactly the input's roles and texts.

A conversation's turns are streamed in order through one task, a record batch
at a time: only the machine's state is kept, never the conversation, so one
that holds most rows needs time but no memory. Conversations with turns out of
order are formatted too and named by ``violation``. Null text and role are
empty; a null conversation id is a conversation; turns that tie are ordered
by role and text; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open`` + role name + ``mid`` + text + ``close`` for each turn. ``moves``
    maps a state to the roles it allows and the state each leads to."""
    open: str = "### "
    mid: str = ": "
    close: str = " </turn>\n"
    names: dict = field(default_factory=lambda: {"user": "User", "assistant": "Assistant", "system": "System"})
    loss: frozenset = frozenset({"assistant"})
    start: str = "begin"
    accept: frozenset = frozenset({"answered"})
    moves: dict = field(default_factory=lambda: {
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })

    def controls(self, head: bool) -> list[str]:
        """What is escaped inside a role's name (``head``) or a text."""
        return [self.mid] if head else [self.open, self.close.strip(), self.close]

    def __post_init__(self):
        marks = [self.open, self.mid, self.close]
        if any("\\" in m or not m.strip() for m in marks):
            raise ValueError("control strings need a visible character and no backslash")
        for name in self.names.values():
            if any(m in name for m in marks):
                raise ValueError("a role's name holds a control string")
        if len(set(self.names.values())) < len(self.names):
            raise ValueError("two roles share a name")

    # Every position where a control string starts, or could start together
    # with what follows the text, gets a backslash.
    def escape(self, text: str, follows: str, head: bool = False) -> str:
        whole = text + follows
        marks = "|".join(map(re.escape, self.controls(head)))
        at = [m.start() for m in re.finditer(rf"(?=\\|{marks})", whole) if m.start() < len(text)]
        if not at:
            return text
        cuts = [0, *at, len(text)]
        return "\\".join(text[a:b] for a, b in zip(cuts, cuts[1:]))

    def role_name(self, role: str) -> str:
        """Unknown roles keep their own string behind a ``=``."""
        return self.names.get(role) or "=" + role

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        head = self.open + self.escape(self.role_name(role), self.mid, True) + self.mid
        return [(head, False), (self.escape(text, self.close), role in self.loss), (self.close, False)]

    def parse(self, chunk: str) -> list[tuple[str, str]]:
        """The turns of a formatted string."""
        back = {v: k for k, v in self.names.items()}
        out, i = [], 0

        def until(mark: str, i: int) -> tuple[str, int]:
            got = []
            while True:
                m = re.compile(rf"\\|{re.escape(mark)}").search(chunk, i)
                if m is None:
                    raise ValueError("unfinished turn")
                got.append(chunk[i:m.start()])
                if m[0] == mark:
                    return "".join(got), m.end()
                got.append(chunk[m.end()])
                i = m.end() + 1

        while i < len(chunk):
            if not chunk.startswith(self.open, i):
                raise ValueError("a turn does not begin where one ends")
            name, i = until(self.mid, i + len(self.open))
            text, i = until(self.close, i)
            out.append((back.get(name, name[1:] if name[:1] == "=" else name), text))
        return out


SEGMENT = "conv_id long, turn_no long, part int, text string, loss boolean, state string, violation string"


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (three a turn: head, text, close) in order within a partition;
    a conversation lies in one partition. ``state`` is the machine's after the
    turn, ``violation`` the first illegal move so far."""
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        now, n, state, wrong = object(), 0, None, None
        for b in batches:
            cols = b.select(["conv_id", "role", "text"]).to_pydict()
            rows = []
            size = 0
            for conv, role, text in zip(cols["conv_id"], cols["role"], cols["text"]):
                if conv != now:
                    now, n, state, wrong = conv, 0, template.start, None
                to = template.moves.get(state, {}).get(role)
                if to is None and wrong is None:
                    wrong = f"turn {n}: {role} after {state}"
                state = to or state
                for k, (t, loss) in enumerate(template.segments(role, text)):
                    rows.append((conv, n, k, t, loss, state, wrong))
                    size += len(t)
                n += 1
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return (slim.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
            .mapInArrow(run, SEGMENT))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, valid boolean, violation string")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, parsed from its segments alone. The
    segments must come in order, a conversation in one partition, as
    ``format_chat`` leaves them."""

    def run(batches):
        import pyarrow as pa
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

        def result(s):
            state, wrong = s["state"], s["wrong"]
            if wrong is None and state not in template.accept:
                wrong = f"ends {state}"
            return (s["conv"], s["n"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"],
                    wrong is None, wrong)

        s, head, done = None, [], []
        for b in batches:
            c = b.to_pydict()
            for conv, part, text, loss, state, wrong in zip(c["conv_id"], c["part"], c["text"], c["loss"],
                                                            c["state"], c["violation"]):
                if s is None or conv != s["conv"]:
                    if s is not None:
                        done.append(result(s))
                    s = {"conv": conv, "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                s["state"], s["wrong"] = state, wrong
                s["size"] += len(text)
                head.append((text, loss))
                if part < 2:
                    continue
                flagged = any(f for _, f in head)
                for role, said in template.parse("".join(t for t, _ in head)):
                    s["n"] += 1
                    s["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if flagged:
                        s["loss"].update(said.encode("utf-8", "surrogatepass"))
                        s["chars"] += len(said)
                head = []
            if len(done) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)
                done = []
        if s is not None:
            done.append(result(s))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)

    return segments.mapInArrow(run, DIGEST)
