"""Exact tokenizer ids for many texts, encoding each distinct word of a batch once.

The libraries' pre-tokenizers never join characters across some boundaries: before white space
that stands alone between word characters, and between a letter and an ASCII punctuation mark
other than the apostrophe. Texts are cut there, equal cuts are encoded once by the library, and
results are gathered back with numpy. Positions that are not certain are left uncut, so the ids
are those of the whole text; texts with the strings of special tokens are not cut at all.
"""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core

import tokenizers  # noqa: E402

#: Bytes of text worked on at a time.
SLICE_BYTES = 2 << 20
#: Cuts remembered in each of two generations; the older one goes when the younger is full.
MEMO_CUTS = 120_000
#: Longer cuts are encoded but not remembered.
MEMO_BYTES = 48

LETTER, DIGIT, MARK, SPACE, LINE, LEAD = 1, 2, 3, 4, 5, 8


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    for byte in range(33, 127):
        kinds[byte] = LETTER if chr(byte).isalpha() else DIGIT if chr(byte).isdigit() else MARK
    kinds[ord("'")] = 0  # contractions join it with letters
    kinds[ord(" ")], kinds[ord("\n")] = SPACE, LINE
    kinds[0xC3:0xCA] = LEAD  # U+00C0 to U+027F, letters but for two signs and U+0130
    return kinds


_CLASSES = _byte_classes()


def _kinds(data: np.ndarray) -> np.ndarray:
    kinds = _CLASSES[data]
    lead = np.flatnonzero(kinds[:-1] == LEAD)
    sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
    dotted = (data[lead] == 0xC4) & (data[lead + 1] == 0xB0)  # its lower case ends in a combining dot, which joins marks
    kinds[lead] = kinds[lead + 1] = np.where(sign | dotted, 0, LETTER)
    kinds[kinds == LEAD] = 0
    return kinds


class MemoTokenizer:
    """A tokenizer file of the ``tokenizers`` library with a memory of short cuts.

    ``spaces_matter`` is false for vocabularies that drop white space and lower-case the text:
    cuts then lose their leading space and their ASCII case, as the library would lose them.
    """

    def __init__(self, path: str, *, spaces_matter: bool):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.spaces_matter = spaces_matter
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of each cut as the bytes of unsigned 32-bit integers."""
        young, old = self.young, self.old
        found = [young.get(cut) or old.get(cut) for cut in cuts]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for i, one in zip(some, self.library.encode_batch_fast([cuts[i].decode() for i in some], add_special_tokens=False), strict=True):
                found[i] = np.array(one.ids, dtype=np.uint32).tobytes()
        for cut, ids in zip(cuts, found, strict=True):
            if len(cut) <= MEMO_BYTES and ids:
                young[cut] = ids
        if len(young) > MEMO_CUTS:
            self.old, self.young = young, {}
        return found

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all ids of the texts in order, and each text's end among them."""
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token, ignore_case=not self.spaces_matter).to_numpy(zero_copy_only=False)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = offsets[0]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first : offsets[-1]]
        bounds = offsets - first
        cut = np.zeros(len(data) + 1, dtype=bool)
        gap = np.zeros(len(data), dtype=bool)
        if len(data) > 2:
            kinds = _kinds(data)
            word = (kinds >= LETTER) & (kinds <= MARK)
            left, here, right = kinds[:-2], kinds[1:-1], kinds[2:]
            gap[1:-1] = ((here == SPACE) | (here == LINE)) & word[:-2] & word[2:]
            cut[1:-2] = gap[1:-1] | ((left == LETTER) & (here == MARK)) | ((left == MARK) & (here == LETTER))
            if self.spaces_matter:
                cut[1:-1] |= gap[:-1] & (kinds[:-1] == LINE)
            for i in np.flatnonzero(whole):
                cut[bounds[i] : bounds[i + 1]] = gap[bounds[i] : bounds[i + 1]] = False
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        if not self.spaces_matter:
            upper = (data >= ord("A")) & (data <= ord("Z"))
            for i in np.flatnonzero(whole):
                upper[bounds[i] : bounds[i + 1]] = False
            kept = np.concatenate([[0], np.cumsum(~gap)])
            data, starts, bounds = (data | (upper.view(np.uint8) << 5))[~gap], kept[starts], kept[bounds]
        edges = starts.astype(np.int64)
        cuts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cuts.dictionary_encode()
        ids = self._encode(coded.dictionary.to_pylist())
        lengths = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        flat, begins = np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(lengths) - lengths
        order = coded.indices.to_numpy()
        each = lengths[order]
        ends = np.cumsum(each)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[order] - (ends - each), each)
        return flat[places], np.append(0, ends)[np.searchsorted(edges, bounds[1:], side="left")]

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, ends) for runs of rows that hold about SLICE_BYTES of text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
            ids, ends = self._slice(texts.slice(at, upto - at))
            yield at, ids, ends
            at = upto
        pa.default_memory_pool().release_unused()


_OPEN: dict[tuple[str, bool], MemoTokenizer] = {}


def opened(path: str, *, spaces_matter: bool) -> MemoTokenizer:
    """The worker's own tokenizer; one worker process keeps it over its tasks."""
    key = (path, spaces_matter)
    if key not in _OPEN:
        _OPEN[key] = MemoTokenizer(path, spaces_matter=spaces_matter)
    return _OPEN[key]


def version_digest(path: str) -> str:
    """SHA-256 over the tokenizer file and the library's version: what a count depends on besides the text."""
    return hashlib.sha256(Path(path).read_bytes() + f"\ntokenizers {tokenizers.__version__}".encode()).hexdigest()
