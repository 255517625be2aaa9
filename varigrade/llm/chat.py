"""Conversations rendered by a compiled template, with the spans a model is to learn, and read back again.

Turns of a conversation come to one task in order and are streamed through the template; what is written leaves the task in
parts of about ``PART`` characters, so a very long conversation is never held whole. An ordinary one is a single part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrade.llm.template import Output, compile_template

PART = 1 << 20
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: One bracketed role and one body per turn; the answers are what is learned.
TEMPLATE = ("{% for m in messages %}<s>[INST]{{ m.role|escape }}[/INST]"
            "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
            "{% else %}{{ m.text|escape }}{% endif %}</s>{% endfor %}")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + r"|\\")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_PARTS = "conv_id long, part long, formatted string, begins array<long>, ends array<long>"
_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
         "formatted_chars long")


def escape(text: str) -> str:
    """Break every control string with a backslash after its first character, and double backslashes."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, begins, ends): the rendered conversations and the learned spans of each part.

    Turns go by ``turn``, equal ones by role and text; a null role or text is empty, repeated rows are repeated turns, and
    rows without conv_id form one conversation without id. Spans count code points from the part's start; a span cut by a
    part's end goes on in the next part.
    """
    compile_template(template, {"escape": escape})  # a broken template fails here, not in a task
    ordered = (turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"),
                            F.col("turn").cast("long"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                            ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        ready: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if ready:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
                ready.clear()

        size = 0
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            text: list[str] = []
            held = [0, 0, 0]  # code points in ``text``, parts so far, where this part began
            out = Output(emit=lambda s: (text.append(s), held.__setitem__(0, held[0] + len(s))))

            def cut(last: bool = False) -> Iterator[pa.RecordBatch]:
                # only between turns, when no span is open
                nonlocal size
                if text or last and not held[1]:
                    base = held[2]
                    ready.append((conv, held[1], "".join(text), [b - base for b, _ in out.spans],
                                  [e - base for _, e in out.spans]))
                    size += held[0]
                    text.clear()
                    out.spans.clear()
                    held[:] = [0, held[1] + 1, out.at]
                if size >= PART or len(ready) >= 4096:
                    size = 0
                    yield from flush()

            messages = ({"role": role or "", "text": body or ""} for _, role, body, _ in rows)
            for _ in render({"messages": messages}, out):
                if held[0] >= PART:
                    yield from cut()
            yield from cut(last=True)
        yield from flush()

    return ordered.mapInArrow(run, _PARTS)


class _Back:
    """Figures of one conversation read from its formatted parts."""

    def __init__(self) -> None:
        self.turns = self.learned = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, begins: list[int], ends: list[int]) -> None:
        at = 0
        for turn in _TURN.finditer(text):
            if turn.start() != at:
                raise ValueError("text outside turns")
            at = turn.end()
            role, body = unescape(turn[1]), unescape(turn[2])
            self.all.update(f"{role}\n{body}\n".encode())
            self.turns += 1
        if at != len(text):
            raise ValueError("text outside turns")
        for begin, end in zip(begins, ends):
            body = unescape(text[begin:end])
            self.loss.update(body.encode())
            self.learned += len(body)
        self.chars += len(text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learned text recovered from what ``format_conversations`` made with the default template."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").select(
        "conv_id", "formatted", "begins", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        rows = []
        for conv, parts in groupby(_rows(batches), lambda r: r[0]):
            back = _Back()
            for _, text, begins, ends in parts:
                back.add(text, begins, ends)
            rows.append((conv, back.turns, back.all.hexdigest(), back.learned, back.loss.hexdigest(), back.chars))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                                 schema=schema)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return ordered.mapInArrow(run, _READ)
