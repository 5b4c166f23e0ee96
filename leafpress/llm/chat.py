"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). ``Flatten`` visits them in order: text
is escaped, an attachment becomes a numbered placeholder of its kind, with its reference and the number of
tokens it expands to recorded; a part of any other type is recorded too, without tokens. The template marks
turns with control strings, which begin with ``<|``; inside texts every backslash is doubled and ``<|`` becomes
``<\\|``, also where one part ends with ``<`` and the next begins with ``|``. So control strings can't occur
there, the text can be read back exactly, and it doesn't matter into how many parts it is cut.

Turns are formatted row by row, without a shuffle. Digests of conversations stream over rows sorted by
conversation and turn, so a conversation of any length takes constant memory.

Cases: null text and null role are empty; null parts are no parts; turns with equal numbers go by role and
then text, repeated rows stay; null conv_id is a conversation, null turn comes first; a very long text is one
string of its row, and a conversation of very many turns is streamed; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafpress.llm.shared import by_key, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACE = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PROBE = r"\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Flatten:
    """Visits the parts of one turn; ``out`` is the body, ``refs`` the attachments (number, kind, ref, tokens)."""

    def __init__(self, *, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.out: list[str] = []
        self.refs: list[tuple[int, str, str | None, int]] = []
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit(self, part: dict[str, Any] | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part or {})

    def visit_text(self, part):
        if text := escape(part.get("text") or ""):
            # "<" and "|" may come from two parts
            self.out.append(f"\\{text}" if text[0] == "|" and self.out and self.out[-1][-1] == "<" else text)

    def visit_image(self, part):
        grid = [max(1, math.ceil((part.get(k) or self.patch) / self.patch)) for k in ("width", "height")]
        self.attach("image", part, grid[0] * grid[1])

    def visit_audio(self, part):
        self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.audio_rate)))

    def visit_document(self, part):
        self.attach("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def visit_other(self, part):
        """A type without a method: its place and reference are recorded, it expands to no token."""
        self.attach("other", part, 0, part["type"])

    def attach(self, place, part, tokens, kind=None):
        self.out.append(f"<|{place}:{len(self.refs)}|>")
        self.refs.append((len(self.refs), kind or place, part.get("ref"), tokens))


def format_turn(role: str, parts: list[dict] | None, trained: str = "assistant") -> tuple[str, tuple[int, int] | None, list]:
    """The formatted turn, the span in it under the loss mask, and its attachments."""
    visitor = Flatten()
    for part in parts or []:
        visitor.visit(part)
    head, body = f"{TURN}{escape(role)}{TEXT}", "".join(visitor.out)
    return f"{head}{body}{END}", (len(head), len(head) + len(body)) if role == trained else None, visitor.refs


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text, read back; placeholders are left out of the text."""
    if not formatted.startswith(TURN) or not formatted.endswith(END):
        raise ValueError("not a turn")
    role, _, body = formatted[len(TURN) : -len(END)].partition(TEXT)
    return unescape(role), unescape(PLACE.sub("", body))


def text_part(text: Column) -> Column:
    """A text column as a list of one part."""
    return F.array(part_of(F.coalesce(text, F.lit(""))))


def text_parts(text: Column) -> Column:
    """A text column as a list of text parts, cut behind each line end and each ``<``."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[\n<])"), part_of)


def part_of(text: Column) -> Column:
    fields = [F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref")]
    more = (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
    return F.struct(*fields, *[F.lit(None).cast(t).alias(n) for n, t in more])


def format_conversations(rows: DataFrame, *, parts: str | None = None, trained: str = "assistant") -> DataFrame:
    """Per row: conv_id, turn, ``formatted``, ``loss_start`` and ``loss_end`` (code points in it, null: no loss), ``attachments``.

    ``parts`` names a column of typed parts (``PART``); without it, ``text`` is the only part.
    """
    body = F.col(parts) if parts else text_part(F.col("text"))

    def run(batches):
        for b in batches:
            role, content = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("role", "parts"))
            made = [format_turn(r or "", c, trained) for r, c in zip(role, content, strict=True)]
            keys = [b.column(0), b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *keys,
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] and m[1][0] for m in made], pa.int64()),
                    pa.array([m[1] and m[1][1] for m in made], pa.int64()),
                    pa.array([[dict(zip(("n", "type", "ref", "tokens"), x, strict=True)) for x in m[2]] for m in made], pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                ],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"],
            )

    kinds = [rows.schema[n].dataType.simpleString() for n in ("conv_id", "turn")]
    out = f"conv_id {kinds[0]}, turn {kinds[1]}, formatted string, loss_start long, loss_end long, attachments array<struct<n:int,type:string,ref:string,tokens:long>>"
    return rows.select("conv_id", "turn", "role", body.alias("parts")).mapInArrow(run, out)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachment_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    dealt = by_key(formatted, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]

    def run(batches):
        now, state = object(), None
        for b in batches:
            done = []
            got = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end", "tokens")]
            for conv, text, lo, hi, tokens in zip(*got, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(close(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, plain = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{plain}\n".encode())
                if lo is not None:
                    loss = unescape(PLACE.sub("", text[lo:hi]))
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
                state[5] += tokens
            yield from rows(done)
        if state is not None:
            yield from rows([close(now, state)])

    def close(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

    def rows(done):
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=schema)

    schema = pa.schema(
        list(
            zip(
                names,
                [
                    to_arrow_type(formatted.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                    pa.int64()
                ],
                strict=True
            )
        )
    )
    tokens = F.aggregate(F.col("attachments"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end", tokens).mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"
    )


def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(probe).withColumn("content", text_parts(F.col("text"))), parts="content"))
