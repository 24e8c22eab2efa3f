"""Packing of token sequences into windows by best-fit decreasing.

Documents are encoded and packed within their input partition, so no row is shuffled: an
overlong document is first cut into full windows, and the rests of a block of documents are
placed, longest first, into the open window they fill best, which a segment tree over the
remaining capacities finds. Windows that stay rather empty are emptied again, and their
pieces are laid end to end into full windows and a few windows of power-of-two length, which
need no padding.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import text_bytes, word_blocks

CAPACITY, END_ID = 2048, 1
#: Tokens of document rests that are packed together; bounds a task's memory.
BLOCK_TOKENS = 4_000_000
#: Most padding that a window may have before its pieces are laid out anew.
SLACK = 32
#: Words, and runs of letters, whose ids a task remembers: some 150 MB at most, freed at its end.
REMEMBER = 600_000
#: ASCII symbols; behind letters they are a piece of their own.
SYMBOLS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Letters up to this one are composed and have one lower-case letter each.
LAST_LETTER = "\u012f"
#: Stands between words that are encoded together; words that hold it are encoded alone.
BETWEEN = "~"
TOGETHER = 256
FLUSH_ROWS = 10_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, row long, ids binary"
)
NAMES = [column.split()[0] for column in PIECES.split(", ")]
TYPES = [pa.int64()] * 8 + [pa.binary()]


def plain_letters(tokenizer) -> bool:
    """True if the tokenizer lower-cases, keeps runs of letters and runs of symbols apart, and ends each with a mark."""
    made = json.loads(tokenizer.to_str())
    normal = [step["type"] for step in (made["normalizer"] or {}).get("normalizers", [])]
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [step["type"] for step in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not cuts[1]["add_prefix_space"]
        and bool(made["model"].get("end_of_word_suffix"))
    )


class WordEncoder:
    """Ids of texts by a tokenizer that never merges over white space, word by word.

    Only words that are not remembered are encoded by the library; the ids of a text are
    those of its words in a row. Most new words are letters with symbols behind them: these
    parts are remembered on their own, as many words differ in their symbols or case alone.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        self.tokenizer, self.symbols = library(path), {}
        self.remember = remember
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.ends = word_ends(path)

    def _tail(self, tail: str) -> bytes:
        ids = self.symbols.get(tail)
        if ids is None:
            if len(self.symbols) >= TOGETHER:
                self.symbols.clear()
            ids = self.symbols[tail] = self._ids(tail).tobytes()
        return ids

    def _learn_letters(self, heads: list[str]) -> None:
        """Runs of letters are encoded together; each ends in a token marked as a word's end."""
        for start in range(0, len(heads), TOGETHER):
            part = heads[start : start + TOGETHER]
            ids = self._ids(" ".join(part))
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            self.letters.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)], strict=True))

    def _learn(self, words: set[bytes]) -> None:
        plain, mixed, alone, known, letters = [], [], [], self.known, self.letters
        for word in words:
            text = word.decode()
            if self.ends is not None:
                low = text.lower()
                head = low.rstrip(SYMBOLS)
                if head.isalpha() and (head.isascii() or max(head) <= LAST_LETTER):
                    plain.append((word, head, low[len(head) :]))
                    continue
            (alone if self.between is None or BETWEEN in text else mixed).append((word, text))
        self._learn_letters([head for head in {head for _, head, _ in plain} if head not in letters])
        tail = self._tail
        known.update([(word, letters[head] + tail(rest) if rest else letters[head]) for word, head, rest in plain])
        for start in range(0, len(mixed), TOGETHER):
            part = mixed[start : start + TOGETHER]
            ids = self._ids(f" {BETWEEN} ".join([text for _, text in part]))
            stops = np.flatnonzero(ids == self.between)
            self._cut(part, ids, [0, *(stops + 1).tolist()], [*stops.tolist(), len(ids)])
        found = self.tokenizer.encode_batch_fast([text for _, text in alone], add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for (w, _), e in zip(alone, found, strict=True))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, part: list[tuple[bytes, str]], ids: np.ndarray, starts: list[int], stops: list[int]) -> None:
        data = ids.tobytes()
        self.known.update((w, data[4 * a : 4 * b]) for (w, _), a, b in zip(part, starts, stops, strict=True))

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; the half that came last is forgotten when words are too many."""
        for text in texts:
            parts = []
            for words in word_blocks(text):
                if len(self.known) > self.remember:
                    self.known = dict(islice(self.known.items(), self.remember // 2))
                if len(self.letters) > self.remember:
                    self.letters = dict(islice(self.letters.items(), self.remember // 2))
                known = self.known
                found = list(map(known.get, words))
                gaps = [i for i, ids in enumerate(found) if ids is None]
                if gaps:
                    self._learn({words[i] for i in gaps})
                    for i in gaps:
                        found[i] = known[words[i]]
                parts.append(b"".join(found))
            yield b"".join(parts)


@lru_cache(maxsize=1)
def library(path: str):
    """The tokenizer itself, once per worker; words it has encoded are remembered by a task alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def word_ends(path: str) -> np.ndarray | None:
    """True for ids that end a run of letters or symbols, if the tokenizer keeps such runs apart."""
    tokenizer = library(path)
    if not plain_letters(tokenizer):
        return None
    vocabulary, suffix = tokenizer.get_vocab(), tokenizer.model.end_of_word_suffix
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``size``: (room, window)."""
        node, count = size + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the sizes in each window; equal sizes in their order."""
    open_, windows = OpenWindows(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_.tightest(sizes[i])
        room, window = found or (capacity, len(windows))
        if found is None:
            windows.append([])
        windows[window].append(i)
        open_.put(room - sizes[i], window)
    return windows


def lengths_without_padding(total: int, capacity: int) -> list[int]:
    """Full windows, and powers of two for the rest."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


@dataclass
class Packer:
    """Packs the documents of one partition block by block."""

    part: int
    capacity: int = CAPACITY
    slack: int = SLACK
    with_ids: bool = False
    windows: int = 0
    rows: int = 0
    held: int = 0
    rests: list[tuple] = field(default_factory=list)
    out: list[tuple] = field(default_factory=list)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start, row = len(ids) // 4, 0, (self.part << 33) + self.rows
        self.rows += 1
        while total - start >= self.capacity:
            self._write([(doc_id, start, total, ids[4 * start : 4 * (start + self.capacity)], row)])
            start += self.capacity
        if start < total:
            self.rests.append((doc_id, start, total, ids[4 * start :], row))
            self.held += total - start
        if self.held >= BLOCK_TOKENS:
            self.pack()

    def _write(self, pieces: list[tuple]) -> None:
        sequence, offset = (self.part << 33) + self.windows, 0
        self.windows += 1
        for doc_id, start, total, ids, row in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, crc32(ids), total, sequence, offset, row, ids if self.with_ids else None))
            offset += n

    def pack(self) -> None:
        """Place all rests held."""
        loose = []
        for window in best_fit([len(r[3]) // 4 for r in self.rests], self.capacity):
            pieces = [self.rests[i] for i in window]
            fill = sum(len(p[3]) // 4 for p in pieces)
            if self.capacity - fill > self.slack and fill & (fill - 1):
                loose.extend(pieces)
            else:
                self._write(pieces)
        left = loose[::-1]
        for length in lengths_without_padding(sum(len(p[3]) // 4 for p in loose), self.capacity):
            pieces, room = [], 4 * length
            while room:
                doc_id, start, total, ids, row = left.pop()
                if len(ids) > room:
                    left.append((doc_id, start + room // 4, total, ids[room:], row))
                    ids = ids[:room]
                pieces.append((doc_id, start, total, ids, row))
                room -= len(ids)
            self._write(pieces)
        self.rests, self.held = [], 0

    def flushed(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True)
        arrays = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
        self.out = []
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = SLACK,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row.

    A document is its text's ids (null: none; no added special tokens) and ``end_id``, so an
    empty text is one token. Every id is in exactly one piece; pieces of a window follow each
    other without gaps. A window is padded to ``capacity`` by at most ``slack`` tokens, or its
    length is a power of two. Rows that repeat an id, or have none, are documents of their
    own, told apart by ``row``, a number of the input row. With ``with_ids`` the ids (little-endian, 32 bits) come along. ``path`` is a
    tokenizer file that splits at white space, at the same place on every worker. Further
    columns are ignored. The numbers of windows are unique, not without gaps.

    Everything follows from the order of rows within the input's partitions, so a task that
    is run again gives the same windows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # remembered words are no cycles, and looking for some takes a seventh of the time
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, end = WordEncoder(path).encode, None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            packer = packer or Packer(batch.column("part")[0].as_py(), capacity, slack, with_ids)
            texts = text_bytes(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                packer.add(doc_id, ids + end)
                if len(packer.out) >= FLUSH_ROWS:
                    yield packer.flushed()
        if packer:
            packer.pack()
            if packer.out:
                yield packer.flushed()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.spark_partition_id().alias("part"),
    )
    pieces = rows.mapInArrow(apply, PIECES)
    return pieces if with_ids else pieces.drop("ids")
