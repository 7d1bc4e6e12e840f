"""Chat formatting of turns made of typed content parts.

A visitor goes through the parts of a turn in order.  Text is escaped and copied; an image, an audio
clip or a document becomes one placeholder, and its reference, place and expanded token count are
recorded as an attachment.  A turn is written as

    <|im_start|>ROLE
    CONTENT<|im_end|>

Every control string inside a text (of this template or another common one) gets a backslash after
its first character, and such strings that already have backslashes get one more, so the text comes
back exactly and holds no control string.  The loss mask covers the text of assistant turns, as
spans of the formatted turn.

Turns are formatted row by row.  ``read_back`` streams the formatted turns of a conversation in
order through digests; a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates, by first character and rest.
_CONTROL = r"(\|[A-Za-z_0-9]+\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|TOOL_CALLS\]|AVAILABLE_TOOLS\])"
_FOUND = re.compile(r"([<\[])(\\*)" + _CONTROL)
_MARKED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\Z", re.S)
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_HOLDER = re.compile("|".join(re.escape(p) for p in PLACEHOLDER.values()))
MEDIA = (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = ("formatted string, loss array<struct<start:long,stop:long>>, "
        "attachments array<struct<place:int,type:string,ref:string,at:long,tokens:long>>, part_tokens long")


def escape(text: str) -> str:
    return _FOUND.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class Visitor:
    """Flattens the parts of one turn."""

    role: str
    image_patch: int = 28        # pixels of a side that one token covers
    audio_rate: float = 25.0     # tokens for each second
    page_tokens: int = 512       # tokens for each page of a document
    out: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def _write(self, s: str) -> None:
        self.out.append(s)
        self.length += len(s)

    def visit(self, part: dict) -> None:
        """Parts of an unknown or null type are text."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        start = self.length
        self._write(escape(part.get("text") or ""))
        if self.role == "assistant" and self.length > start:
            self.loss.append({"start": start, "stop": self.length})

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil(max(n or 0, 1) / self.image_patch)
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._write(PLACEHOLDER[kind])

    def turn(self, parts: list[dict]) -> dict:
        self._write(f"<|im_start|>{escape_role(self.role)}\n")
        # escaping looks across neighbouring text parts, so that no control string forms where they meet
        for part in _joined(parts):
            self.visit(part)
        self._write("<|im_end|>\n")
        return {"formatted": "".join(self.out), "loss": self.loss, "attachments": self.attachments, "part_tokens": sum(a["tokens"] for a in self.attachments)}


def _joined(parts: list[dict]) -> list[dict]:
    out: list[dict] = []
    for p in parts:
        if p is None:
            continue
        if out and p.get("type") not in PLACEHOLDER and out[-1].get("type") not in PLACEHOLDER:
            out[-1] = out[-1] | {"text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(dict(p))
    return out


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders are left out of the text."""
    m = _TURN.match(formatted)
    return unescape_role(m[1]), "".join(unescape(t) for t in _HOLDER.split(m[2]))


def text_parts(text_col: str):
    """One text part of a column (null: empty)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                            *[F.lit(None).cast(kind).alias(name) for name, kind in MEDIA]))


def formatted_turns(turns: DataFrame, parts_col: str = "parts", role_col: str = "role") -> DataFrame:
    """``turns`` without the parts, with formatted, loss, attachments and part_tokens.

    A null list of parts is an empty turn, a null part nothing, a null role an empty one.  Columns
    with the names of the results are replaced.
    """
    keep = [c for c in turns.columns if c not in (parts_col, "formatted", "loss", "attachments", "part_tokens")]

    def fn(batches):
        for batch in batches:
            rows = [Visitor(role or "").turn(parts or []) for role, parts in zip(batch.column("_role").to_pylist(), batch.column("_parts").to_pylist())]
            turn = pa.array(rows, pa.struct([
                ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ("attachments", pa.list_(pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
                ("part_tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), turn], ["_doc", "_turn"])

    rows = turns.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), F.col(role_col).alias("_role"), F.col(parts_col).alias("_parts"))
    kind = rows.schema["_doc"].dataType.simpleString()
    return rows.mapInArrow(fn, f"_doc {kind}, _turn struct<{TURN.replace(' ', ':').replace(',:', ',')}>").select("_doc.*", "_turn.*")


class _Reader:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, formatted: str, loss: list[dict]) -> None:
        role, text = parse_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            learnt = unescape(formatted[span["start"]:span["stop"]])
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learnt)
        self.n_turns += 1
        self.chars += len(formatted)

    def row(self):
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn",)) -> DataFrame:
    """Digests of each conversation, read from its formatted turns in order (ties by the formatted text)."""
    def fn(batches):
        now = None
        for batch in batches:
            done = []
            for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("_conv", "formatted", "loss"))):
                if now is None or now.conv != conv:
                    done += [now.row()] if now is not None else []
                    now = _Reader(conv)
                now.feed(formatted, loss)
            yield rows(done)
        yield rows([now.row()] if now is not None else [])

    def rows(done):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)],
                                          [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = (turns.select(F.col(conv_col).cast("long").alias("_conv"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], "formatted", "loss")
               .repartition("_conv").sortWithinPartitions("_conv", *[f"_o{k}" for k in range(len(order))], "formatted"))
    return ordered.mapInArrow(fn, f"{conv_col} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
