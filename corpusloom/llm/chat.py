"""Chat formatting with any template as a black box, located turn by turn.

A template is an object whose ``render(turns)`` gives one string for a list of (role, text). Successive prefixes of
a conversation are rendered and consecutive outputs compared: what is new is the turn's span, and an output that
does not start with the one before shows a template that rewrites history. Within a span the text is located by two
probe texts of one character: where their outputs differ, the text begins, and what follows it has the same length
for every text. Comparing starts where the output before ended, so only new text is looked at. A conversation of n
turns costs renderings of 1 to n turns, so it stays in one task; different conversations are independent.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PROBES = ("\ue000", "\ue001")


class InstructTemplate:
    """``<s>`` once, then ``[SYS]…[/SYS]``, ``[INST]…[/INST]``, ``…</s>`` for system, user and assistant turns.

    Any other role gives ``[ROLE]name[SAYS]…[/ROLE]``. Control strings inside texts and names get a backslash in
    front, backslashes are doubled, so :meth:`read` restores every turn.
    """

    CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]")
    HELD = 1 << 24

    def __init__(self):
        marks = "|".join(re.escape(c) for c in self.CONTROLS)
        self._special = re.compile(rf"\\|{marks}")
        self._escaped = re.compile(r"\\(.)", re.DOTALL)
        self._token = re.compile(rf"\\.|{marks}", re.DOTALL)
        self._turns, self._held = {}, 0

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def _turn(self, role: str, text: str) -> str:
        body = self.escape(text)
        if role == "system":
            return f"[SYS]{body}[/SYS]"
        if role == "user":
            return f"[INST]{body}[/INST]"
        if role == "assistant":
            return f"{body}</s>"
        return f"[ROLE]{self.escape(role)}[SAYS]{body}[/ROLE]"

    def render(self, turns: list[tuple[str, str]]) -> str:
        """Turns are rendered once and kept for the next prefix; the store starts anew beyond ``HELD`` characters."""
        parts = []
        for turn in turns:
            part = self._turns.get(turn)
            if part is None:
                if self._held > self.HELD:
                    self._turns, self._held = {}, 0
                part = self._turns[turn] = self._turn(*turn)
                self._held += len(part)
            parts.append(part)
        return "<s>" + "".join(parts)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        ends = {"[/SYS]": "system", "[/INST]": "user", "</s>": "assistant"}
        turns, begin, name = [], 3, ""
        for m in self._token.finditer(formatted, 3):
            if m[0] in ("[SYS]", "[INST]", "[ROLE]"):
                begin = m.end()
            elif m[0] == "[SAYS]":
                name, begin = self.unescape(formatted[begin : m.start()]), m.end()
            elif m[0] in ends or m[0] == "[/ROLE]":
                turns.append((ends.get(m[0], name), self.unescape(formatted[begin : m.start()])))
                begin = m.end()
        return turns


def _parting(a: str, b: str, start: int) -> int:
    """First place from ``start`` on where the strings differ, or the end of the shorter one."""
    end = min(len(a), len(b))
    return next((j for j in range(start, end) if a[j] != b[j]), end)


def locate(template, turns: list[tuple[str, str]]) -> tuple[str, list[tuple], bool]:
    """The whole rendering, per turn (role, start, end, text_start, text_end), and whether history was rewritten.

    Of a turn whose span is lost, because a later turn rewrote it, start and end are where it stood when it was new.
    """
    before, spans, rewritten = template.render([]), [], False
    for i, (role, text) in enumerate(turns):
        now = template.render(turns[: i + 1])
        start = len(before)
        if not now.startswith(before):
            rewritten = True
            start = _parting(now, before, 0)
        a, b = (template.render([*turns[:i], (role, p)]) for p in PROBES)
        at = _parting(a, b, len(before) if a.startswith(before) and b.startswith(before) else 0)
        tail = max(0, len(a) - at - 1)
        spans.append((role, start, len(now), at, max(at, len(now) - tail)))
        before = now
    return before, spans, rewritten


_SPANS = "array<struct<role: string, start: long, end: long, text_start: long, text_end: long>>"


def format_chats(
    turns: DataFrame, template=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, formatted, spans, rewrites_history)``, one row per conversation.

    Turns are in order of ``turn`` (null first), ties by role and text. Null roles and texts are empty strings. A
    null conversation id is a conversation of its own; repeated rows are repeated turns. Extra columns are not read.
    An empty table gives an empty one.
    """
    template = template or InstructTemplate()

    @F.arrow_udf(f"formatted string, spans {_SPANS}, rewrites_history boolean")
    def render(column: pa.Array) -> pa.Array:
        out = []
        for rows in column.to_pylist():
            text, spans, rewritten = locate(template, [(t["role"], t["text"]) for t in rows])
            fields = ("role", "start", "end", "text_start", "text_end")
            out.append({"formatted": text, "spans": [dict(zip(fields, s)) for s in spans], "rewrites_history": rewritten})
        span = pa.struct([("role", pa.string()), *((f, pa.int64()) for f in ("start", "end", "text_start", "text_end"))])
        return pa.array(out, pa.struct([("formatted", pa.string()), ("spans", pa.list_(span)), ("rewrites_history", pa.bool_())]))

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    whole = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return whole.withColumn("chat", render("turns")).select("conv_id", "chat.*")


def read_back(formatted: Column, spans: Column, template=None) -> Column:
    """Struct of n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted string.

    Turns are read from the string alone; the loss mask is the text spans of assistant turns.
    """
    template = template or InstructTemplate()

    @F.arrow_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(formatted: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(formatted.to_pylist(), spans.to_pylist()):
            turns = template.read(text)
            said = "".join(f"{role}\n{words}\n" for role, words in turns)
            loss = "".join(template.unescape(text[p["text_start"] : p["text_end"]]) for p in places if p["role"] == "assistant")
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            out.append((len(turns), sha(said), len(loss), sha(loss), len(text)))
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names)

    return digest(formatted, spans)
