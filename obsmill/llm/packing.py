"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best-fit: each task holds at most ``open_bins`` sequences open, in a bitset
keyed by free space. A piece goes to the open sequence that it fills best; when none fits and all
places are taken, the fullest closes first. Pieces reach the packer a window at a time, the longest
of the window first; a window is about as many pieces as sequences are open, so that those it opens
stay open for the next one's short pieces. Nothing is shuffled: a piece's sequence and offset are known once it is placed,
and a sequence is the work of one task, whatever the number of tasks.

Ids come from the ``tokenizers`` library. Text is cut into units after each word, before the white
space that follows it, and between an ASCII letter or digit and an ASCII character of another kind;
no match of the byte-level pattern crosses such a place, so equal units have equal ids and each
task asks the library once for each distinct unit. Texts with white space outside ASCII go to the
library whole. A task holds the ids of some texts and of the next window, not of a whole batch.

A null or empty text is the closing id alone. Bytes that aren't UTF-8 count as U+FFFD. Repeated rows
are packed each on its own, equal lengths in the order of the rows; other columns aren't looked
at; an empty table gives an empty result. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from obsmill.llm.common import hash_spans, raw, slices, texts, tidy

#: Pieces that are put in order at a time.
WINDOW = 2048
#: Units whose ids a task remembers; then it begins anew.
MEMORY = 1_500_000
#: Bytes of text that are cut into units at a time, and units that the library gets at a time.
SLICE, LEARN = 500_000, 4096
#: Bytes by kind: 0 ASCII white space, 1 letter, 2 digit, 3 other ASCII, 4 part of another character.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
#: A unit ends between a byte of the first kind and one of the second.
_ENDS = np.zeros((5, 5), bool)
_ENDS[1:, 0] = _ENDS[1, 2:4] = _ENDS[2, [1, 3]] = True
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_HINTS = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]


def _odd(text: bytes) -> bool:
    return any(x in text for x in _HINTS) and bool(_ODD.search(text))


@cache
def tokenizer(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    return t


class Units:
    """Ids of texts, by way of their units."""

    def __init__(self, file: str, memory: int = MEMORY):
        self.tok, self.memory = tokenizer(file), memory
        self.clear()

    def clear(self) -> None:
        # of each known unit, by rising hash, where its ids are in the pool, and how many
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def whole(self, some: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.int32) for x in self.tok.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, some: list[str]) -> None:
        """keys: rising, of units that aren't known."""
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for i in range(0, len(some), LEARN):
            part = some[i : i + LEARN]
            found = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, n = np.asarray(found.ids, np.int32), np.bincount(np.asarray(found.word_ids, np.int64), minlength=len(part))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.resize(self.pool, 2 * len(self.pool))
            self.pool[self.used : self.used + len(ids)] = ids
            start[i : i + LEARN], size[i : i + LEARN] = self.used + np.cumsum(n) - n, n
            self.used += len(ids)
        at = np.searchsorted(self.known, keys)
        self.known, self.start, self.size = np.insert(self.known, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids, in order, made some texts at a time."""
        data, at = raw(column)
        for i, j in slices(at, SLICE):
            if _odd(data[at[i] : at[j]].tobytes()):
                for k in range(i, j):
                    odd = _odd(data[at[k] : at[k + 1]].tobytes())
                    yield from self.whole(texts(column.slice(k, 1))) if odd else self._slice(data, at, k, k + 1)
            else:
                yield from self._slice(data, at, i, j)

    def _slice(self, data: np.ndarray, at: np.ndarray, i: int, j: int) -> list[np.ndarray]:
        low = np.zeros(at[j] - at[i] + 16, np.uint8)
        low[:-16] = data[at[i] : at[j]]
        cut = at[i : j + 1] - at[i]
        kind = _KIND[low[:-16]]
        ends = np.zeros(len(kind), bool)
        ends[:-1] = _ENDS[kind[:-1], kind[1:]]
        ends[cut[1:][np.diff(cut) > 0] - 1] = True
        stop = np.flatnonzero(ends) + 1
        begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        of = np.searchsorted(stop, cut, side="right")
        keys, which = np.unique(hash_spans(low, begin, stop - begin), return_inverse=True)
        if len(self.known) > self.memory:
            self.clear()
        at_known = np.searchsorted(self.known, keys)
        fresh = np.flatnonzero(self.known.take(at_known, mode="clip") != keys) if len(self.known) else np.arange(len(keys))
        if len(fresh):
            at_unit = np.empty(len(keys), np.int64)
            at_unit[which] = np.arange(len(which))
            self.learn(keys[fresh], [low[begin[u] : stop[u]].tobytes().decode("utf-8", "replace") for u in at_unit[fresh]])
            at_known = np.searchsorted(self.known, keys)
        number = at_known[which]
        size = self.size[number]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(to[-1]) - np.repeat(to[:-1] - self.start[number], size)]
        return [ids[a:b] for a, b in zip(to[of[:-1]], to[of[1:]], strict=True)]


class Packer:
    """Open sequences by free space."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """The sequence's number and the place in it."""
        if fitting := self.bits >> size:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free, self.made = self.made, self.length, self.made + 1
        if left := free - size:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """Start and size of each piece of n ids; only the first may be shorter than ``length``."""
    first = n % length or min(n, length)
    return [(0, first), *((a, length) for a in range(first, n, length))]


def _windows(texts: Iterable[np.ndarray], length: int, end_id: int) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
    """WINDOW pieces at a time, in order of placing: the text's number, the piece's, its start and ids."""
    todo: list[tuple[int, int, int, np.ndarray]] = []
    for row, x in enumerate(texts):
        x = np.append(x, np.int32(end_id))
        for k, (start, size) in enumerate(pieces(len(x), length)):
            todo.append((row, k, start, x[start : start + size]))
            if len(todo) == WINDOW:
                yield sorted(todo, key=lambda x: (-len(x[3]), x[0], x[1]))
                todo = []
    if todo:
        yield sorted(todo, key=lambda x: (-len(x[3]), x[0], x[1]))


def pack_documents(docs: DataFrame, tokenizer_file: str, *, length: int = 2048, open_bins: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long" + ", ids array<int>" * with_ids

    def run(batches):
        units, packer = Units(tokenizer_file), Packer(length, open_bins)
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            for some in _windows(units.encode(b.column(1)), length, end_id):
                cuts = [x[3] for x in some]
                places = [packer.place(len(x)) for x in cuts]
                columns = [
                    b.column(0).take(pa.array([x[0] for x in some], pa.int64())), pa.array([x[1] for x in some], pa.int32()), pa.array([x[2] for x in some], pa.int64()), pa.array([len(x) for x in cuts], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64()), pa.array([base + x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cuts)]), pa.int32()), pa.array(np.concatenate(cuts))))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
