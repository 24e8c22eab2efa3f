"""Removal of passages that repeat an earlier document, over a de Bruijn graph of word k-mers.

A window of 13 words is an edge between two 12-word nodes. Edges are only made where they can
repeat: every window is filed under its least five-word hash (its minimiser, which depends on
the window's words alone), and only windows whose minimiser occurs in two documents become
edges. The first source of each edge is found by one shuffle on the edge. Edges whose own and
source coordinates advance together form a nonbranching path; paths are compacted to spans,
each span is verified by joining its source document and comparing digests of the words
themselves, and the words of verified spans are removed.

No key can grow hot: within a block of documents equal windows are resolved at once and those
of one document leave the block, so a key is met at most once per block of a million words
(and once per repeat within its first document). What leaves a block is dealt by ranges of
the hash and travels as arrays, one row per block and range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import shuffle_parts, text_bytes, word_blocks
from seqloom.session import materialise

WINDOW, ANCHOR = 13, 5
#: Words of documents that are looked at together.
BLOCK_WORDS = 1_000_000
#: Words whose hash a worker remembers.
REMEMBER = 300_000
#: Order of documents without an id: after all others, and never anyone's source.
LAST = 2**63 - 1

MULTIPLY, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)

#: Buckets of keys for each shuffle partition; a task holds one at a time.
BUCKETS = 4

# Rows of one block and bucket, as arrays: keys, the place of each key's document in the
# document arrays, and what else belongs to a key. Blocks list documents and places in order.
ANCHORS = "bucket int, mh array<long>, doc array<int>, state array<int>, ord array<long>, th array<long>"
EDGES = "bucket int, key array<long>, doc array<int>, pos array<int>, ord array<long>, th array<long>"
PATHS = "ord long, th long, pos int, len int, src_ord long, src_th long, src_pos int"
RUNS = f"runs array<struct<{PATHS.replace(' ', ':').replace(',:', ', ')}>>"
#: States of an anchor: of one document of its block; of several, so it repeats; its mark.
ONE, REPEATS, MARK = 1, 2, 3


class WordHashes:
    """64-bit hashes of words, one array per text."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def of(self, text: bytes) -> np.ndarray:
        parts = []
        for words in word_blocks(text):
            if len(self.known) > REMEMBER:
                self.known.clear()
            known = self.known
            for word in set(words).difference(known):
                known[word] = xxhash.xxh3_64_digest(word)
            parts.append(b"".join([known[w] for w in words]))
        return np.frombuffer(b"".join(parts), "<u8")


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= MULTIPLY
        out += hashes[j : j + size]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The least anchor hash within each window."""
    low = rolled(hashes, ANCHOR)
    width, size = WINDOW - ANCHOR + 1, max(0, len(hashes) - WINDOW + 1)
    covered = 1
    while 2 * covered <= width:
        low = np.minimum(low[: len(low) - covered], low[covered:])
        covered *= 2
    return np.minimum(low[:size], low[width - covered : width - covered + size])


def in_blocks(rows: Iterator[tuple], words: WordHashes) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Rows (text, ...) in blocks with all their word hashes and the row of each word."""
    held, arrays, size = [], [], 0
    for text, *more in rows:
        hashes = words.of(text)
        if len(hashes) < WINDOW:
            continue
        held.append(tuple(more))
        arrays.append(hashes)
        size += len(hashes)
        if size >= BLOCK_WORDS:
            yield held, np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
            held, arrays, size = [], [], 0
    if held:
        yield held, np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def _windows(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Starts of the windows that lie in one row."""
    return np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where any of the (sorted) columns differs from the place before."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return change


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Even ranges of the keys, which are mixed first: minimisers crowd at the low end."""
    mixed = keys * MULTIPLY
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def bucketed(
    bucket: np.ndarray, doc: np.ndarray, columns: list[np.ndarray], ords: np.ndarray, ths: np.ndarray
) -> list[pa.Array]:
    """One row of arrays per bucket: the columns, and the documents they belong to."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc = bucket[order], doc[order]
    heads = np.flatnonzero(_heads(bucket))
    sizes = np.diff(np.append(heads, len(bucket)))
    fresh = _heads(bucket, doc)
    place = np.cumsum(fresh) - 1
    inside = (place - np.repeat(place[heads], sizes)).astype(np.int32)
    docs = np.add.reduceat(fresh.astype(np.int64), heads)
    first, *others = (_lists(sizes, c[order]) for c in columns)
    return [
        pa.array(bucket[heads]),
        first,
        _lists(sizes, inside),
        *others,
        _lists(docs, ords[doc[fresh]]),
        _lists(docs, ths[doc[fresh]]),
    ]


def by_bucket(batches: Iterator[pa.RecordBatch], key: str, other: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, document, other, ord, th) of all rows of a bucket; rows come sorted by bucket."""
    held: list[list[np.ndarray]] = []
    now, docs = None, 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(parts) for parts in zip(*held, strict=True))

    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now:
                if held:
                    yield joined()
                held, now, docs = [], bucket, 0
            part = [batch.column(c)[i].values.to_numpy() for c in (key, "doc", other, "ord", "th")]
            part[0], part[1] = part[0].view(np.uint64), part[1].astype(np.int64) + docs
            docs += len(part[3])
            held.append(part)
    if held:
        yield joined()


def anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Minimisers of each document, by bucket.

    Of a minimiser that several documents of the block share only a mark goes to the bucket
    of its hash; the documents themselves, which need not meet the others any more, go to
    buckets of their own.
    """
    rows = (
        row
        for batch in batches
        for row in zip(text_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("ord", "th")), strict=True)
    )
    for docs, hashes, row in in_blocks(rows, WordHashes()):
        starts = _windows(hashes, row)
        low, doc = minimisers(hashes)[starts], row[starts]
        first = _heads(low, doc)
        low, doc = low[first], doc[first]
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        first = _heads(low, doc)
        low, doc = low[first], doc[first]
        group = np.flatnonzero(_heads(low))
        sizes = np.diff(np.append(group, len(low)))
        known = np.repeat(sizes > 1, sizes)
        marks = group[sizes > 1]
        ords, ths = np.array(docs, np.int64).reshape(-1, 2).T
        bucket = np.where(known, bucket_of(ths.view(np.uint64), buckets)[doc], bucket_of(low, buckets))
        bucket = np.concatenate([bucket, bucket_of(low[marks], buckets)])
        state = np.concatenate([np.where(known, REPEATS, ONE), np.full(len(marks), MARK)]).astype(np.int32)
        low, doc = np.concatenate([low, low[marks]]), np.concatenate([doc, doc[marks]])
        order = np.lexsort((low, doc))
        columns = [low[order].view(np.int64), state[order]]
        arrays = bucketed(bucket[order].astype(np.int32), doc[order], columns, ords, ths)
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "mh", "doc", "state", "ord", "th"])


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, th, marks): the minimisers of a document that another one has as well."""
    for low, doc, state, ords, ths in by_bucket(batches, "mh", "state"):
        order = np.argsort(low, kind="stable")
        heads = _heads(low[order])
        number = np.cumsum(heads) - 1
        met = np.where(state == REPEATS, 0, np.where(state == MARK, 2, 1))[order]
        total = np.add.reduceat(met, np.flatnonzero(heads))[number]
        repeats = np.empty(len(low), bool)
        repeats[order] = total > 1
        kept = np.flatnonzero((state == REPEATS) | ((state == ONE) & repeats))
        if len(kept):
            kept = kept[np.argsort(doc[kept], kind="stable")]
            fresh = np.flatnonzero(_heads(doc[kept]))
            sizes = np.diff(np.append(fresh, len(kept)))
            own = doc[kept[fresh]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ords[own]), pa.array(ths[own]), _lists(sizes, low[kept].view(np.int64))],
                names=["ord", "th", "marks"],
            )


def sources(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """For each window the index of the first equal one, by order of documents."""
    order = np.lexsort((pos, doc, ords[doc], key))
    heads = _heads(key[order])
    found = np.empty(len(order), np.int64)
    found[order] = order[np.flatnonzero(heads)][np.cumsum(heads) - 1]
    return found


def paths(doc: np.ndarray, pos: np.ndarray, source: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the windows ``later`` whose own and source places advance together.

    Gives the index of the first window and the number of windows of each.
    """
    a, b = later[1:], later[:-1]
    joined = np.zeros(len(later), bool)
    joined[1:] = (
        (doc[a] == doc[b])
        & (pos[a] == pos[b] + 1)
        & (doc[source[a]] == doc[source[b]])
        & (pos[source[a]] == pos[source[b]] + 1)
    )
    heads = np.flatnonzero(~joined)
    return later[heads], np.diff(np.append(heads, len(later)))


def _paths(doc, pos, source, ords, ths, later) -> list[pa.Array]:
    head, length = paths(doc, pos, source, later)
    from_ = source[head]
    return [
        pa.array(ords[doc[head]]),
        pa.array(ths[doc[head]]),
        pa.array(pos[head].astype(np.int32)),
        pa.array(length.astype(np.int32)),
        pa.array(ords[doc[from_]]),
        pa.array(ths[doc[from_]]),
        pa.array(pos[from_].astype(np.int32)),
    ]


PATH_NAMES = [c.split()[0] for c in PATHS.split(", ")]


def edges(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows that may repeat, by the bucket of their minimiser, and paths with a source here.

    Of equal windows of a block only those of the first document go on.
    """

    def rows() -> Iterator[tuple]:
        seen: set[tuple] = set()  # rows that repeat id and text have the same coordinates
        for batch in batches:
            ords, ths = batch.column("ord").to_pylist(), batch.column("th").to_pylist()
            marks = batch.column("marks")
            for i, text in enumerate(unpacked(batch.column("packed"))):
                if (ords[i], ths[i]) not in seen:
                    seen.add((ords[i], ths[i]))
                    yield text, ords[i], ths[i], np.concatenate([m.values.to_numpy() for m in marks[i]])

    for docs, hashes, row in in_blocks(rows(), WordHashes()):
        starts = _windows(hashes, row)
        low, doc = minimisers(hashes)[starts], row[starts]
        begin = np.searchsorted(row, np.arange(len(docs)))
        # a document's own marks only: the document is mixed into both sides
        tag = lambda values, docs: values ^ ((docs.astype(np.uint64) + np.uint64(1)) * MIX)
        marks = [m.view(np.uint64) for _, _, m in docs]
        wanted = tag(np.concatenate(marks), np.repeat(np.arange(len(docs)), [len(m) for m in marks]))
        first = _heads(low, doc)
        hit = np.isin(tag(low[first], doc[first]), wanted)[np.cumsum(first) - 1]
        starts, doc, low = starts[hit], doc[hit], low[hit]
        if not len(starts):
            continue
        key, pos = rolled(hashes, WINDOW)[starts], starts - begin[doc]
        ords, ths = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
        source = sources(key, doc, pos, ords)
        known = ords[doc[source]] < ords[doc]
        runs = pa.StructArray.from_arrays(_paths(doc, pos, source, ords, ths, np.flatnonzero(known)), names=PATH_NAMES)
        key, doc, pos, low = key[~known], doc[~known], pos[~known], low[~known]
        arrays = bucketed(bucket_of(low, buckets), doc, [key.view(np.int64), pos.astype(np.int32)], ords, ths)
        n = len(arrays[0])
        offsets = np.zeros(n + 1, np.int32)
        offsets[1 + int(ths[0]) % n :] = len(runs)  # all paths of the block go with one of its rows
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.ListArray.from_arrays(pa.array(offsets), runs)],
            names=["bucket", "key", "doc", "pos", "ord", "th", "runs"],
        )


def later_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of windows that start in a document before, of each bucket, and those known."""

    def passed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs.append(batch.column("runs").flatten())
            yield batch

    runs: list[pa.Array] = []
    for key, doc, pos, ords, ths in by_bucket(passed(), "key", "pos"):
        source = sources(key, doc, pos, ords)
        later = np.flatnonzero(ords[doc[source]] < ords[doc])
        while runs:
            yield pa.RecordBatch.from_arrays(runs.pop().flatten(), names=PATH_NAMES)
        if len(later):
            yield pa.RecordBatch.from_arrays(_paths(doc, pos, source, ords, ths, later), names=PATH_NAMES)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled whole."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array((squeeze(t) for t in text_bytes(batch.column("text"))), pa.binary())
        others = ["doc_id", "ord", "th"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), texts], names=[*others, "packed"])


def unpacked(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    for value in column:
        yield expand(value.as_py())


def _words(text: bytes) -> list[bytes]:
    return list(chain.from_iterable(word_blocks(text)))


def _digest(words: list[bytes], pos: int, length: int) -> bytes:
    return hashlib.sha256(b" ".join(words[pos : pos + length + WINDOW - 1])).digest()[:16]


def source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words of each wanted span of a source document."""
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("ord", "th", "wanted"))
        rows = zip(unpacked(batch.column("packed")), *columns, strict=True)
        for text, order, th, wanted in rows:
            words = _words(text)
            out.extend((order, th, w["pos"], w["len"], _digest(words, w["pos"], w["len"])) for w in wanted)
        if out:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["src_ord", "src_th", "src_pos", "len", "digest"])


RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string()]


def removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents without the words of their verified spans."""
    for batch in batches:
        counts, gone, sums, texts = [], [], [], []
        for text, spans in zip(unpacked(batch.column("packed")), batch.column("spans").to_pylist(), strict=True):
            words = _words(text)
            keep = np.ones(len(words), bool)
            for span in spans or ():
                if _digest(words, span["pos"], span["len"]) == span["digest"]:
                    keep[span["pos"] : span["pos"] + span["len"] + WINDOW - 1] = False
            kept = b" ".join(compress(words, keep.tolist()) if spans else words)
            counts.append(len(words))
            gone.append(int(len(words) - keep.sum()))
            sums.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text else None)
        made = [pa.array(c, t) for c, t in zip((counts, gone, sums, texts), RESULT_TYPES, strict=True)]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(ord, th, pos, len, src_ord, src_th, src_pos): paths of windows with an earlier source.

    pos and len count windows: the path covers len + 12 words.
    """
    parts = shuffle_parts(docs)
    buckets = BUCKETS * parts
    place = F.floor(F.col("bucket") / BUCKETS).cast("int")
    deal = lambda rows: rows.repartitionById(parts, place).sortWithinPartitions("bucket")
    filed = docs.select("text", "ord", "th").mapInArrow(lambda batches: anchors(batches, buckets), ANCHORS)
    marked = (
        deal(filed)
        .mapInArrow(repeated_anchors, "ord long, th long, marks array<long>")
        .groupBy("ord", "th")
        .agg(F.collect_list("marks").alias("marks"))
    )
    made = (
        texts.join(marked, ["ord", "th"])
        .select("packed", "ord", "th", "marks")
        .mapInArrow(lambda batches: edges(batches, buckets), f"{EDGES}, {RUNS}")
    )
    found = deal(made).mapInArrow(later_paths, PATHS).withColumn("shift", F.col("pos") - F.col("src_pos"))
    # compact the paths: windows with one source at one shift that touch or overlap
    path = ["ord", "th", "src_ord", "src_th", "shift"]
    along = Window.partitionBy(*path).orderBy("pos", "len")
    before = F.max(F.col("pos") + F.col("len")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        found.repartition("ord", "th")
        .withColumn("fresh", F.coalesce(F.col("pos") > before, F.lit(True)).cast("int"))
        .withColumn("number", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*path, "number")
        .agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("len")).alias("stop"))
        .withColumns({"len": F.col("stop") - F.col("pos"), "src_pos": F.col("pos") - F.col("shift")})
        .select(*PATH_NAMES)
    )


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are what stands between ASCII white space; null texts have none. A word goes if it
    is in a window of 13 words that also starts in a document with a smaller doc_id; windows
    are judged on the input. Rows that share an id do not make each other smaller, and a row
    without an id has a larger one than all others. kept_text is null unless ``with_text``.
    Further columns are ignored; an empty table gives an empty result.

    Windows are matched by 64-bit hashes; a chance collision can hide a source, never remove
    a word, as spans are verified by SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("th"), "text")
    texts = rows.mapInArrow(packed, "doc_id long, ord long, th long, packed binary")
    spans = materialise(repeated_spans(rows, texts), "spans")
    wanted = (
        spans.select(F.col("src_ord").alias("ord"), F.col("src_th").alias("th"), F.col("src_pos").alias("pos"), "len")
        .distinct()
        .groupBy("ord", "th")
        .agg(F.collect_list(F.struct("pos", "len")).alias("wanted"))
    )
    digests = materialise(
        texts.join(wanted, ["ord", "th"])
        .select("packed", "ord", "th", "wanted")
        .mapInArrow(source_digests, "src_ord long, src_th long, src_pos int, len int, digest binary")
        .distinct(),
        "digests",
    )
    own = (
        spans.join(digests, ["src_ord", "src_th", "src_pos", "len"])
        .groupBy("ord", "th")
        .agg(F.collect_list(F.struct("pos", "len", "digest")).alias("spans"))
    )
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return (
        texts.join(own, ["ord", "th"], "left")
        .select("doc_id", "packed", "spans")
        .mapInArrow(lambda batches: removed(batches, with_text), result)
    )
