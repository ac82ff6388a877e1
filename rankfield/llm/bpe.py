"""BPE encoding and decoding, sharing the work of words that begin alike.

A byte-pair encoding of a word splits at its last token into that token and the encoding of what
precedes it, and two tokens may stand next to each other exactly if merging their bytes never
joins across their border. So one number tells all about a prefix: its last token. Distinct words
are put into a trie of bytes in sorted order; each new node, on the way down, takes the longest
vocabulary token that ends there and may follow the last token of the node above its first byte.
A prefix that many words share is encoded once, and a word's ids are read off from its node up.

The trie of a worker process is kept over batches and begun anew at ``TRIE_NODES`` nodes; long
words get one of their own.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import ChainMap
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfield.llm.memo import MemoTokenizer

#: Nodes of a trie that is still kept for the next slice of text, with its words about 200 bytes each.
TRIE_NODES = 250_000
#: Longer words are not kept.
WORD_BYTES = 64
#: Remembered answers about neighbours.
PAIRS_KEPT = 200_000

NO_RANK = 1 << 60


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


_SYMBOLS = _byte_symbols()
_TO_BYTES = {ord(c): b for c, b in _SYMBOLS.items()}


def _bytes_of(symbols: str) -> bytes:
    return symbols.translate(_TO_BYTES).encode("latin-1")


class Merges:
    """Which tokens of a merge list a text can have, and which can be neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.parts = {}
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.ranks = {}
        for rank, (left, right) in enumerate(merges):
            left, right, whole = vocab[left], vocab[right], vocab[left + right]
            self.parts[whole], self.rank[whole], self.ranks[left, right] = (left, right), rank, rank
        self.known: dict[tuple[int, int], bool] = {}
        self.inner: dict[bytes, int] = {}  # tokens within a word and, without the suffix, at its end
        self.final: dict[bytes, int] = {}
        for said, token in vocab.items():
            if token not in self.parts or self._apart(*self.parts[token], self.rank[token]):
                ends = bool(suffix) and said.endswith(suffix)
                (self.final if ends else self.inner)[_bytes_of(said.removesuffix(suffix) if ends else said)] = token
        if not suffix:
            self.final = self.inner
        self.longest = max(map(len, (*self.inner, *self.final)))
        self.width = {token: len(said) for table in (self.inner, self.final) for said, token in table.items()}

    def _apart(self, left: int, right: int, before: int = NO_RANK) -> bool:
        """No merge of a rank below ``before`` joins the two, whatever has been merged inside each by then.

        Going back in time, the later made of the two tokens at the border gives way to its part
        there; a merge across the border happens if it comes before the merge that used either up.
        Of equal merges the one further left comes first.
        """
        used_left = used_right = before
        while True:
            across = self.ranks.get((left, right), NO_RANK)
            if across < used_left and across <= used_right and across < before:
                return False
            if self.rank[left] > self.rank[right]:
                used_left, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                used_right, right = self.rank[right], self.parts[right][0]
            else:
                return True

    def neighbours(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= PAIRS_KEPT:
                self.known.clear()
            found = self.known[left, right] = self._apart(left, right)
        return found


class Trie:
    """Words as paths of bytes; each node holds the last token of its prefix and, once asked for, of its word."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.step: dict[int, int] = {}  # 256 * node + byte -> node
        self.inner = [-1]
        self.final = [-1]
        self.known: dict[bytes, bytes] = {}  # the ids of the kept words

    def _last(self, word: bytes, depth: int, path: list[int], tokens: dict[bytes, int]) -> int:
        """The last token of the prefix of ``depth`` bytes, by the last tokens of shorter ones.

        Just one token can stand there. The one that makes the last token of the prefix above
        longer and the byte alone are tried before the others, as they are mostly right.
        """
        inner, neighbours = self.inner, self.merges.neighbours
        above = depth - 1 - self.merges.width.get(inner[path[depth - 1]], 0)
        for begin in (above, depth - 1, *range(max(0, depth - self.merges.longest), depth)):
            token = tokens.get(word[begin:depth])
            if token is not None and (begin == 0 or neighbours(inner[path[begin]], token)):
                return token
        raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")

    def insert(self, word: bytes) -> list[int]:
        """The ids of a word: walks the known prefix, and goes on down with new nodes."""
        node, path = 0, [0]
        for depth, byte in enumerate(word[:-1], 1):
            key = node << 8 | byte
            node = self.step.get(key, -1)
            if node < 0:
                node = self._grow(key)
            if self.inner[node] < 0:
                self.inner[node] = self._last(word, depth, path, self.merges.inner)
            path.append(node)
        key = node << 8 | word[-1]
        node = self.step.get(key, -1)
        if node < 0:
            node = self._grow(key)
        path.append(node)
        if self.final[node] < 0:
            self.final[node] = self._last(word, len(word), path, self.merges.final)
        ids, depth, token = [], len(word), self.final[node]
        while True:
            ids.append(token)
            depth -= self.merges.width[token]
            if not depth:
                return ids[::-1]
            token = self.inner[path[depth]]

    def _grow(self, key: int) -> int:
        self.step[key] = node = len(self.inner)
        self.inner.append(-1)
        self.final.append(-1)
        return node


#: Splitting lower-case ASCII text into words, as the vocabulary's own pattern does.
_ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class TrieTokenizer(MemoTokenizer):
    """A vocabulary file with merges, whose words are encoded by a trie.

    It takes files of lower-case byte-level vocabularies without white space and without a decoder.
    Characters are normalised and split into words by the library itself wherever they are not ASCII.
    """

    def __init__(self, path: str):
        super().__init__(path, spaces_matter=False)
        model = json.loads(Path(path).read_text())["model"]
        if model["type"] != "BPE" or self.library.decoder is not None:
            raise ValueError(f"{path} is no byte-level vocabulary whose tokens are joined by spaces")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.added = {token.content: number for number, token in self.library.get_added_tokens_decoder().items()}
        self.parting = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.trie = Trie(self.merges)

    def _words(self, cut: bytes) -> Iterator[bytes | int]:
        """The words of a cut, and the ids of added tokens among them."""
        if cut.isascii() and b"<|" not in cut:
            yield from _ASCII_WORDS.findall(cut.lower())
            return
        for part in self.parting.split(cut.decode()) if self.added else [cut.decode()]:
            if part in self.added:
                yield self.added[part]
            elif part:
                for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield _bytes_of(symbols)

    def _encode(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of each cut as the bytes of unsigned 32-bit integers; distinct words enter the trie in sorted order."""
        split = [[cut] if cut.isalpha() and cut.islower() else list(self._words(cut)) for cut in cuts]
        if len(self.trie.inner) > TRIE_NODES:
            self.trie = Trie(self.merges)
        ids, known = {}, self.trie.known
        for word in sorted({word for words in split for word in words if isinstance(word, bytes)} - known.keys()):
            trie, kept = (self.trie, known) if len(word) <= WORD_BYTES else (Trie(self.merges), ids)
            kept[word] = array("I", trie.insert(word)).tobytes()
        found = ChainMap(ids, known) if ids else known
        return [
            found[words[0]] if len(words) == 1 and isinstance(words[0], bytes) else b"".join(found[w] if isinstance(w, bytes) else np.uint32(w).tobytes() for w in words)
            for words in split
        ]


class Decoder:
    """The strings of all tokens in one buffer, gathered by id."""

    def __init__(self, path: str):
        library = MemoTokenizer(path, spaces_matter=False).library
        said = [(library.id_to_token(i) or "").encode() for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.known = np.array([library.id_to_token(i) is not None for i in range(len(said))])
        self.lengths = np.array([len(s) + 1 for s in said])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(s + b" " for s in said), dtype=np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The tokens of each run of ids, joined by spaces; ids without a token are left out."""
        known = ids < len(self.known)
        known[known] = self.known[ids[known]]
        ends = np.append(0, np.cumsum(known))[ends]
        ids = ids[known]
        lengths = self.lengths[ids].copy()
        filled = np.diff(ends, prepend=0) > 0
        lengths[ends[filled] - 1] -= 1  # no space behind the last token
        stops = np.cumsum(lengths)
        places = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.begins[ids] - (stops - lengths), lengths)
        offsets = np.append(0, np.append(0, stops)[ends])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[places]))]
        return pa.Array.from_buffers(pa.large_string(), len(ends), buffers).cast(pa.string())


_OPEN: dict[tuple[str, type], object] = {}


def _opened(path: str, kind: type):
    """The worker's own tables of a vocabulary; one worker process keeps them over its tasks."""
    if (path, kind) not in _OPEN:
        _OPEN[path, kind] = kind(path)
    return _OPEN[path, kind]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``: the ids of its whole text as unsigned 32-bit integers, little-endian, without begin and end tokens.

    Null and empty texts have no ids; the strings of added tokens are these tokens, as in the
    library; repeated rows and rows without doc_id keep a row each; an empty table gives no rows;
    further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(tokenizer_path, TrieTokenizer)
        for batch in batches:
            for at, ids, ends in trie.encode(batch.column(1)):
                packed = _binaries(ids.astype("<u4"), 4 * np.append(0, ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), packed], names=["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).cast(pa.binary())


#: Bytes of ids decoded at a time.
SLICE_IDS = 1 << 21


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens of each row's ids, special ones too, joined by spaces as the library joins them.

    Null and empty ids give the empty text; ids without a token are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _opened(tokenizer_path, Decoder)
        for batch in batches:
            packed = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(packed), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
            at = 0
            while at < len(packed):
                base = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, base + SLICE_IDS)))
                some = packed.slice(at, upto - at)
                ids = np.frombuffer(b"".join(x.as_buffer() for x in some if x.is_valid), "<u4").astype(np.int64)
                texts = decoder.texts(ids, (ends[at:upto] - base) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), some, texts], names=["doc_id", "ids", "decoded"])
                at = upto

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
