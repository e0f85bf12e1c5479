"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts a control
string gets a backslash behind its first character, and one more if it has some
already, so the reader takes one away and gets the text back.

Rows arrive sorted by conversation and turn.  For a run of rows the lengths of all
segments give their offsets in one buffer, which is allocated once; headers and
contents are scattered into it, and the buffer becomes an Arrow string column with
one value a conversation.  The loss mask is the list of byte ranges of the trained
texts in it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bindscape.llm.words import ragged, text_bytes

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
RUN_BYTES = 1 << 22  # rows of about so many bytes are assembled at a time
RUN_ROWS = 1 << 15


def escape(column) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=_CONTROL, replacement=r"\1\\\2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n+1 row offsets, n text starts) of the formatted rows."""
    role, role_at = text_bytes(escape(roles))
    text, text_at = text_bytes(escape(texts))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    size = len(OPEN) + role_n + len(MIDDLE) + text_n + len(CLOSE)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    role_to = at[:-1] + len(OPEN)
    middle_to = role_to + role_n
    text_to = middle_to + len(MIDDLE)
    for mark, to in ((OPEN, at[:-1]), (MIDDLE, middle_to), (CLOSE, text_to + text_n)):
        out[to[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    out[np.repeat(role_to, role_n) + ragged(role_n)] = role
    out[np.repeat(text_to, text_n) + ragged(text_n)] = text
    return out, at, text_to


def _conversations(table: pa.Table, trained: str) -> pa.RecordBatch:
    """Formatted conversations of sorted rows (conv_id, role, text)."""
    ids = table.column(0).combine_chunks()
    data, at, text_to = assemble(table.column(1).combine_chunks(), table.column(2).combine_chunks())
    n = len(ids)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy()
    cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])])
    offsets = np.r_[at[cut], at[n]]
    formatted = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    mine = pc.fill_null(pc.equal(table.column(1).combine_chunks(), trained), False).to_numpy(zero_copy_only=False)
    conv = np.searchsorted(cut, np.arange(n), side="right") - 1
    lo = text_to - at[cut][conv]
    hi = at[1:] - len(CLOSE) - at[cut][conv]
    counts = np.zeros(len(cut) + 1, np.int32)
    np.cumsum(np.bincount(conv[mine], minlength=len(cut)), out=counts[1:])
    span = pa.StructArray.from_arrays([pa.array(lo[mine]), pa.array(hi[mine])], ["start", "end"])
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(cut)), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(counts), span)],
        ["conv_id", "formatted", "loss"])


def format_conversations(
    rows: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text", trained: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, loss) of every conversation.

    Turns are in the order of ``turn`` (nulls first; ties by role, then text).
    Null roles and texts count as empty.  Rows without an id make one conversation
    with a null id; repeated rows are turns of their own.  ``loss`` lists the byte
    ranges of the ``trained`` role's texts.  Other columns are not read; an empty
    table gives no rows.
    """
    rows = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                held.append(part)
                size += part.num_rows * (RUN_BYTES // RUN_ROWS) + sum(len(x) for x in (text_bytes(part.column(2))[0],))
                if size < RUN_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                ids = table.column(0)
                last = ids[-1]
                other = np.flatnonzero(~pc.fill_null(pc.equal(ids, last), not last.is_valid).to_numpy()) if last.is_valid else np.flatnonzero(ids.is_valid().to_numpy())
                if len(other):  # all but the last conversation are complete
                    end = int(other[-1]) + 1
                    yield _conversations(table.slice(0, end), trained)
                    table = table.slice(end)
                    held, size = table.to_batches(), 0
                else:
                    size = RUN_BYTES // 2
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield _conversations(table, trained)

    return rows.select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, formatted string, loss array<struct<start:long,end:long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read
    back from the formatted text and its loss mask."""

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                raw = text.encode()
                under = "".join(unescape(raw[x["start"]: x["end"]].decode()) for x in loss)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((len(turns), digest(said), len(under), digest(under), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.string() if "sha" in x else pa.int64()) for x, c in zip(names, columns)],
                ["conv_id", *names])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
