"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, any
other part becomes a placeholder, its reference and its expanded token count are recorded. Turns are set between marks,
and an escape keeps marks and placeholders that occur inside texts apart from real ones; it can be undone exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import release

OPEN, CLOSE, HOLD = "### ", " </turn>\n", "<|"
#: Control string and its escape, in the order of escaping; undone in reverse order.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("<|", "\\p")]
#: Tokens that a placeholder stands for, unless the part says so itself.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"
FORMATTED = "formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<slot:int,type:string,ref:string,tokens:int,at:int>>, n_turns int"


def escape(text: str, line: bool = False) -> str:
    """``line``: also new lines, as in a turn's head."""
    for plain, code in ESCAPES + [("\n", "\\n")] * line:
        text = text.replace(plain, code)
    return text


def unescape(text: str) -> str:
    for plain, code in [("\n", "\\n"), *reversed(ESCAPES)]:
        text = text.replace(code, plain)
    return text


@dataclass
class Flattener:
    """Visits parts in order; holds what has been written and the attachments met."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            self.write(escape(part.get("text") or ""))
        else:
            self.attach(kind, part)

    def attach(self, kind: str, part: dict) -> None:
        tokens = part.get("tokens") if part.get("tokens") is not None else EXPANDED.get(kind, 0)
        slot = len(self.attachments)
        self.attachments.append({"slot": slot, "type": kind, "ref": part.get("ref"), "tokens": tokens, "at": self.size})
        self.write(f"{HOLD}{escape(kind, line=True)}:{slot}|>")


def format_turns(turns: list[dict], trained: str = "assistant") -> dict:
    """One conversation; turns have role and parts. loss: spans (code points) of the trained role's contents."""
    to, loss = Flattener(), []
    for turn in turns:
        to.write(f"{OPEN}{escape(turn['role'] or '', line=True)}\n")
        start = to.size
        for is_text, parts in groupby(turn["parts"] or [], lambda p: (p.get("type") or "text") == "text"):
            if is_text:  # neighbours are joined first, so that no control string forms where they meet
                to.visit({"type": "text", "text": "".join(p.get("text") or "" for p in parts)})
            else:
                for part in parts:
                    to.visit(part)
        if turn["role"] == trained:
            loss.append({"start": start, "end": to.size})
        to.write(CLOSE)
    return {"formatted": "".join(to.out), "loss": loss, "attachments": to.attachments, "n_turns": len(turns)}


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a formatted conversation, unescaped; placeholders stay as they are."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, content = turn.removeprefix(OPEN).partition("\n")
        out.append((unescape(role), unescape(content)))
    return out


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss, attachments and n_turns: one row for each conversation, turns in ascending order.

    Content comes from ``parts`` (array of typed parts) or, where that is not given, from ``text`` as one text part; null
    is empty. A null role is an empty role; null turns come first; equal turns are ordered by role and content and all
    kept, as are repeated rows. A part of any other type is an attachment too, of no tokens unless it says so. An empty
    table gives an empty table. A null conv_id is a conversation of its own. Other columns are left out. A conversation is one document and so one row;
    its turns are gathered with partial aggregation.
    """
    content = F.col(parts) if parts else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), content.cast(PARTS).alias("parts")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))

    def run(batches):
        for batch in batches:
            for key, turns in zip(batch.column(0), batch.column(1), strict=True):
                turns = sorted(turns.as_py(), key=lambda t: (t["turn"] is not None, t["turn"] or 0, t["role"] or "", str(t["parts"])))
                made = format_turns(turns, trained)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), *(pa.array([made[n]], kind) for n, kind in _KINDS)], names=["conv_id", *(n for n, _ in _KINDS)])
        release()

    return gathered.mapInArrow(run, f"conv_id {df.schema[conv_id].dataType.simpleString()}, {FORMATTED}")


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_REF = pa.struct([("slot", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32()), ("at", pa.int32())])
_KINDS = [("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_REF)), ("n_turns", pa.int32())]


def read_conversations(df: DataFrame) -> DataFrame:
    """Reads formatted conversations back: digests of the turns and of what the loss mask covers, from ``formatted`` and ``loss`` alone.

    One row for each row; a null ``formatted`` has no turns, a null ``loss`` covers nothing. Other columns are left out.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, formatted, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss")), strict=True):
                formatted = formatted or ""
                turns = read_turns(formatted)
                learnt = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss or ())
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((key, len(turns), digest(told), len(learnt), digest(learnt), len(formatted)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    kind = df.schema["conv_id"].dataType.simpleString()
    return df.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
