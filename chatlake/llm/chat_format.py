"""Chat formatting by grammar round trip.

A turn is rendered as

    <|im_start|>role LF text <|im_end|> LF

and the rendered text is parsed again by the grammar below. A turn whose parse
differs from its source is escaped and parsed once more: a backslash goes into
every '<|' (also one that has backslashes inside already), so no control string
is left, and the parser takes one backslash out. Escaping is undone exactly, and
a turn's text that parses to itself is left as it is.

    conversation = { turn }
    turn         = START role LF text END LF
    role         = characters but LF and control strings; '\\n' in it means LF
    text         = characters but control strings

Turns are rendered and checked where they are read, in parallel. They are then
dealt by ranges of (conversation, turn), so a conversation of any length is cut
over tasks, and each task joins its turns to segments of bounded size, which it
parses once more as a whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import written
from chatlake.session import ship_package

# The control strings.
START, END = "<|im_start|>", "<|im_end|>"

SEGMENT = 1 << 20       # characters of a segment, about
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(re.escape(START) + "|" + re.escape(END))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, start and end the place of the text
    as rendered; None if the grammar does not take the whole string."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        head = at + len(START)
        line = rendered.find("\n", head)
        stop = _CONTROL.search(rendered, line + 1) if line >= 0 else None
        if stop is None or stop[0] != END or _CONTROL.search(rendered, head, line) or rendered[stop.end():stop.end() + 1] != "\n":
            return None
        turns.append((_unescape_role(rendered[head:line]), unescape(rendered[line + 1:stop.start()]), line + 1, stop.start()))
        at = stop.end() + 1
    return turns


def render(role: str, text: str) -> str:
    """The first of four forms, from plain to fully escaped, that parses back."""
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), text), (_escape_role(role), escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        got = parse(out)
        if got is not None and [g[:2] for g in got] == [(role, text)]:
            return out
    raise ValueError(f"no form of this turn parses back: {role!r}")


def _render_rows(batches):
    import pyarrow as pa

    for b in batches:
        out = [render(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "rendered"])


def _segments(loss_roles: frozenset):
    """Rows in (conversation, turn) order to segments: whole turns of one
    conversation, parsed again as a whole."""
    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        key, turns, size, out = None, [], 0, []

        def cut():
            nonlocal number, turns, size
            text = "".join(t[2] for t in turns)
            got = parse(text)
            if got is None or [g[:2] for g in got] != [t[:2] for t in turns]:
                raise ValueError("a segment does not parse back to its turns")
            mask = [{"start": a, "end": z} for role, _, a, z in got if role in loss_roles]
            out.append((key, part, number, len(turns), text, mask))
            number, turns, size = number + 1, [], 0

        def frame():
            f = pd.DataFrame(out, columns=["conv_id", "part", "number", "n_turns", "formatted", "loss"])
            out.clear()
            return f.astype({"conv_id": "Int64"})

        for b in batches:
            for c, role, text, rendered in zip(b["conv_id"], b["role"], b["text"], b["rendered"]):
                c = None if pd.isna(c) else int(c)
                if turns and (c != key or size >= SEGMENT):
                    cut()
                key = c
                turns.append((role, text, rendered))
                size += len(rendered)
            yield frame()
        if turns:
            cut()
            yield frame()
    return run


def format_conversations(rows: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) rows to segments, as a written table: conv_id,
    part and number (their order in a conversation), n_turns, formatted and loss,
    the character spans of ``formatted`` under the loss mask, texts of
    ``loss_roles``.

    A conversation's turns go by turn (NULL first), then role and text. NULL
    texts and roles are empty; NULL conv_ids are one conversation; repeated rows
    are turns of their own. Other columns are not used.
    """
    ship_package(rows.sparkSession)
    tidy = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rendered = tidy.mapInArrow(_render_rows, "conv_id long, turn long, role string, text string, rendered string")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    cut = rendered.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _segments(frozenset(loss_roles)),
        "conv_id long, part int, number int, n_turns long, formatted string, loss array<struct<start:long,end:long>>")
    return written(cut, "chat")


def _digest(batches):
    """Segments in order to a row for each conversation, one pass, nothing of a
    conversation kept but its running digests."""
    import pandas as pd

    key, state, out = None, None, []

    def done():
        n, turns, loss_n, loss, chars = state
        out.append((key, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

    def frame():
        f = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.clear()
        return f.astype({"conv_id": "Int64"})

    for b in batches:
        for c, formatted, mask in zip(b["conv_id"], b["formatted"], b["loss"]):
            c = None if pd.isna(c) else int(c)
            if state is not None and c != key:
                done()
                state = None
            if state is None:
                key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in mask:
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        yield frame()
    if state is not None:
        done()
        yield frame()


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted segments say: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Digests run over a conversation in
    order, so its segments meet in one task, which streams them."""
    ship_package(segments.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), "part", "number"]
    return (segments.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "loss")
            .mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long"))
