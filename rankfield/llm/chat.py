"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings begin with ``<|``; inside a
text every ``<``, backslashes, ``|`` gets one more backslash after the ``<``, so ``<|`` never occurs
in a text, and taking one backslash away restores it. Roles are percent-coded where they hold ``%``,
``<`` or a line break. For a batch of turns the segment lengths, their cumulative offsets and the
scatter indices are computed with numpy and all bytes are copied into one preallocated buffer that
becomes the Arrow column. The loss mask is a list of code point spans, one per assistant text.

Turns are shuffled by conversation and sorted inside partitions; a task streams over them and
holds one open conversation, which is one training example and one output row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed control strings of the template.
START, END, LEARNED = "<|im_start|>", "<|im_end|>\n", "assistant"

FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,end:int>>"
#: Turns assembled in one buffer, by their bytes.
BUFFER_BYTES = 8 << 20


def _coded_roles(roles: pa.Array) -> pa.Array:
    for raw, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        roles = pc.replace_substring(roles, raw, coded)
    return roles


def escape(texts: pa.Array) -> pa.Array:
    """``texts`` without any ``<|``."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    """The text that was escaped."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _text_column(formatted: pa.Array) -> pa.Array:
    """As strings; one conversation of 2 GB or more does not fit an Arrow string or a row."""
    if len(formatted) == 1 and formatted.nbytes >= 1 << 31:
        raise ValueError("a formatted conversation of 2 GB or more")
    return formatted.cast(pa.string())


def assemble(turns: pa.Table) -> pa.RecordBatch:
    """Formatted conversations from turns (conv_id, role, text) in order; nulls in role and text are empty."""
    roles = pc.fill_null(turns["role"].combine_chunks().cast(pa.large_string()), "")
    texts = pc.fill_null(turns["text"].combine_chunks().cast(pa.large_string()), "")
    ids = turns["conv_id"].combine_chunks()
    segments = [START.encode(), _bytes(_coded_roles(roles)), b"\n", _bytes(escape(texts)), END.encode()]
    n = len(roles)
    lengths = np.stack([np.full(n, len(s)) if isinstance(s, bytes) else s[1] for s in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    places = ends - lengths
    out = np.empty(int(ends[-1, -1]), dtype=np.uint8)
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            out[places[:, k, None] + np.arange(len(segment))] = np.frombuffer(segment, dtype=np.uint8)
        else:
            data, size = segment
            out[np.repeat(places[:, k] - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
    key, known = np.nan_to_num(ids.fill_null(0).to_numpy()), ids.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (known[1:] != known[:-1])]))
    bounds = np.append(places[first, 0], len(out))
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])

    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, learned, side="right") - 1
    base = points[bounds[owner]]
    span = [pa.array((points[x[learned, 3]] - base).astype(np.int32)) for x in (places, ends)]
    counts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(first)))).astype(np.int32)
    loss = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(span, names=["start", "end"]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), _text_column(formatted), loss], names=["conv_id", "formatted", "loss"])


def _assemble_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of sorted turns, about BUFFER_BYTES at a time; an open conversation waits, untouched, until another one follows it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"]
        key, known = np.nan_to_num(ids.fill_null(0).to_numpy()), ids.is_valid().to_numpy(zero_copy_only=False)
        changes = np.flatnonzero((key[1:] != key[:-1]) | (known[1:] != known[:-1])) + 1
        if held and held[-1]["conv_id"][-1].as_py() != ids[0].as_py():
            changes = np.append(0, changes)
        if len(changes) and size + batch.nbytes >= BUFFER_BYTES:
            at = int(changes[-1])
            yield assemble(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held, size = [], 0
            batch = batch.slice(at)
        held.append(batch)
        size += batch.nbytes
    if held:
        yield assemble(pa.Table.from_batches(held))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for every conversation of (conv_id, turn, role, text).

    Turns go by turn, then role and text, nulls first; repeated rows are turns of their own; null
    roles and texts are empty; rows without conv_id form one conversation with a null id; an empty
    table gives no rows; further columns are ignored.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_assemble_batches, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        for raw, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
            role = role.replace(coded, raw)
        turns.append((role, unescape(text[: -len(END)])))
    return turns


def read_loss(formatted: str, loss: list[dict]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[span["start"] : span["end"]]) for span in loss)
