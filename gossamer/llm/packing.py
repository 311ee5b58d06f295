"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into pieces of at most `piece` tokens.  A block of pieces
with T tokens is split among n = ceil(T / capacity) windows: every piece is a
partial partition (its size and n - 1 zeros); the two partial partitions with
the largest spread are merged again and again, the largest load of the one
with the smallest of the other, until one is left, whose n loads are nearly
equal.  If any exceeds the capacity, n rises; where it does, the block's pieces are also tried in smaller parts of varied
lengths, and the way with the fewest windows is taken.  Only loads that are not zero are
held, so a block takes memory in proportion to its pieces, not to pieces times
windows.

Blocks are runs of pieces inside each input partition (a long document's pieces
may lie in many blocks), bounded by tokens and by their number, so nothing is
shuffled and no task holds more than two blocks besides the texts that it
encodes.  A sequence's id is the partition's number and a count.

Edges: a null or empty text is one piece, the end id alone; null doc_ids are
kept; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import prepare
from gossamer.llm.tokens import tokenizer

#: Parts of a piece that are tried, one after the other, where windows would be added.
WAYS = (2, 4, 8)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


def differencing(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each size, load of each part) of a split into n parts with nearly equal loads."""
    m = len(sizes)
    if n == 1:
        return np.zeros(m, np.int64), np.array([sizes.sum()], np.int64)
    # A partial partition: its loads above its smallest, descending (the other parts hold the smallest: 0), and for each a
    # piece that stands for the part's pieces.  All pieces of a part are joined to trees; a part that holds nothing has -1.
    tree = np.arange(m)
    heap = [(-int(sizes[k]), k, sizes[k : k + 1].astype(np.int64), np.array([k])) for k in range(m)]
    heapq.heapify(heap)
    count = m
    while len(heap) > 1:
        _, _, a, a_held = heapq.heappop(heap)
        _, _, b, b_held = heapq.heappop(heap)
        if max(len(a), len(a_held)) + max(len(b), len(b_held)) <= n:  # the largest loads of each meet parts of the other that hold nothing
            loads, held = np.concatenate((a, b)), np.concatenate((a_held, b_held))
        else:
            loads, held = np.zeros(n, np.int64), np.full(n, -1, np.int64)
            loads[: len(a)], held[: len(a_held)] = a, a_held
            loads[n - len(b) :] += b[::-1]
            other = np.full(n, -1, np.int64)
            other[n - len(b_held) :] = b_held[::-1]
            both = (held >= 0) & (other >= 0)
            tree[other[both]] = held[both]
            held = np.where(held < 0, other, held)
        order = np.argsort(-loads, kind="stable")
        loads, held = loads[order], held[order]
        if len(loads) == n:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), count, loads, held))
        count += 1
    held = heap[0][3]
    while not np.array_equal(further := tree[tree], tree):  # pointer jumping
        tree = further
    of = np.full(m, -1, np.int64)
    of[tree[held[held >= 0]]] = np.flatnonzero(held >= 0)
    part = of[tree]
    return part, np.bincount(part, weights=sizes, minlength=n).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each piece and load of each window, none above the capacity."""
    total = int(sizes.sum())
    n = max(1, -(-total // capacity))
    while True:
        part, loads = differencing(sizes, n)
        over = int(loads.max()) - capacity
        if over <= 0:
            return part, loads
        n = max(n + 1, -(-total // max(1, capacity - (int(loads.max()) - total // n))) if n > 1 else 2)


def cut(sizes: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of pieces of nearly equal length, at most `piece`, of each document."""
    count = np.maximum(1, -(-sizes // piece))
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    whole, n = sizes[doc], count[doc]
    start = whole * k // n
    return doc, start, whole * (k + 1) // n - start


def recut(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, length) of the parts of pieces, each cut `ways` times at most in shares that differ from piece to piece."""
    k = np.arange(len(sizes))[:, None]
    shares = np.cumsum(1 + (k * 37 + np.arange(ways) ** 2 * 53 + k * np.arange(ways) * 11) % 97, axis=1)
    ends = sizes[:, None] * shares // shares[:, -1:]
    lengths = np.diff(ends, axis=1, prepend=0).ravel()
    return np.repeat(k.ravel(), ways)[lengths > 0], lengths[lengths > 0]


def fitted(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, length, window, load of each window) of pieces that are cut further only where that saves windows.

    Pieces of equal lengths may miss a window's capacity by a few tokens each time, whatever their order.
    """
    piece, lengths = np.arange(len(sizes)), sizes
    part, loads = windows(sizes, capacity)
    least = max(1, -(-int(sizes.sum()) // capacity))
    for ways in WAYS:
        if len(loads) - least <= least // 100:  # up to one in a hundred is not worth another try
            break
        finer, short = recut(sizes, ways)
        again, less = windows(short, capacity)
        if len(less) < len(loads):
            piece, lengths, part, loads = finer, short, again, less
    return piece, lengths, part, loads


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = 4096, piece: int = 1024, block: int = 128, block_pieces: int = 65_536) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded_length, ids (little-endian unsigned 32-bit).

    capacity: tokens of a sequence; piece: the longest uncut stretch of a document; block: windows that are balanced together, of
    at most block_pieces pieces.  A sequence is padded to the capacity, but not if its length is a power of two.
    """
    if piece > capacity:
        raise ValueError("a piece must fit a sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, encode, made = TaskContext.get().partitionId(), tokenizer(vocabulary).encode, 0
        held: list[list[np.ndarray]] = [[] for _ in range(6)]  # doc_id, whether it is null, start, length, doc_tokens; and the ids
        tokens = pieces = 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, tokens, pieces
            doc_id, null, start, length, whole, ids = map(np.concatenate, held)
            ends, at = np.cumsum(length), 0
            while at < len(length):
                begin = int(ends[at - 1]) if at else 0
                to = min(at + block_pieces, int(np.searchsorted(ends, begin + block * capacity, "right")))
                if tokens - begin < 2 * block * capacity and len(length) - at < 2 * block_pieces:
                    if not last:
                        break
                    to = len(length)
                piece, size, part, loads = fitted(length[at:to], capacity)
                stop = np.cumsum(size)
                within = stop - size - (np.cumsum(length[at:to]) - length[at:to])[piece]  # where a piece's part begins in it
                order = np.lexsort((np.arange(len(size)), part))
                part, some, size, within, stop = part[order], at + piece[order], size[order], within[order], stop[order] + begin
                ahead = np.cumsum(size) - size
                first = np.concatenate(([True], part[1:] != part[:-1]))
                flat = ids[np.repeat(stop - size - ahead, size) + np.arange(int(size.sum()))].astype("<i4", copy=False)
                bounds = np.concatenate(([0], np.cumsum(size) * 4)).astype(np.int32)
                number, filled = np.cumsum(first) - 1, loads[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_id[some], mask=null[some]),
                        pa.array(start[some] + within),
                        pa.array(size),
                        pa.array(whole[some]),
                        pa.array((partition << 33) + made + number),
                        pa.array(ahead - np.maximum.accumulate(np.where(first, ahead, 0))),
                        pa.array(np.where(filled & (filled - 1) == 0, filled, capacity)),
                        pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"],
                )
                made += int(number[-1]) + 1
                at = to
            rest = int(ends[at - 1]) if at else 0
            held[:] = [[c[at:]] for c in (doc_id, null, start, length, whole)] + [[ids[rest:].copy()]]
            tokens, pieces = tokens - rest, pieces - at

        for batch in batches:
            who, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            known, null = who.fill_null(0).to_numpy(zero_copy_only=False), who.is_null().to_numpy(zero_copy_only=False)
            for k in range(0, len(texts), 200):
                ids, each = encode(texts[k : k + 200], end)
                doc, start, length = cut(each, piece)
                for column, new in zip(held, (known[k + doc], null[k + doc], start, length, each[doc], ids)):
                    column.append(new)
                tokens, pieces = tokens + len(ids), pieces + len(doc)
                if tokens >= 3 * block * capacity or pieces >= 3 * block_pieces:
                    yield from emit(False)
        if pieces:
            yield from emit(True)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
