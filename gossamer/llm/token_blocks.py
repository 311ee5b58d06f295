"""Token-ID output: patched frame-of-reference blocks.

A shard file holds the ids of its documents one after another in blocks of
128.  From each block its minimum is subtracted, the differences are packed
at the width that a chosen percentile of them needs, and the block's outliers
go whole into an exception list.  The index gives each block's start, so a
reader can begin anywhere.

Shard file: b"PFORBLK1", frames, index, documents, footer.  A frame holds the
packed words of up to 8192 blocks (2 x width little-endian uint64 for each;
value k's bits begin at bit k x width), then their exceptions (position
uint8, value uint32).  The index has, for each block, INDEX; documents have
DOCUMENT; the footer is FOOTER.

Edges: a null or empty text is a document of the end id alone; a null doc_id
comes first and is kept as null; repeated rows are kept, each as a document;
equal doc_ids are ordered by text; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import create, prepare, scratch, source
from gossamer.llm.tokens import tokenizer

MAGIC = b"PFORBLK1"
BLOCK = 128
FRAME = 8192
INDEX = np.dtype([("words", "<u8"), ("exceptions", "<u8"), ("minimum", "<u4"), ("width", "u1"), ("n_exceptions", "u1")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_tokens", "<u8")])
FOOTER = np.dtype([("n_ids", "<u8"), ("index", "<u8"), ("n_blocks", "<u8"), ("documents", "<u8"), ("n_documents", "<u8")])
EXCEPTION = np.dtype([("at", "u1"), ("value", "<u4")])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index with starts counted from 0, packed words, exceptions) of a multiple of 128 ids."""
    rows = ids.reshape(-1, BLOCK).astype(np.uint32)
    index = np.zeros(len(rows), INDEX)
    index["minimum"] = rows.min(axis=1)
    apart = rows - index["minimum"][:, None]
    kth = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    index["width"] = width = _bits(np.partition(apart, kth, axis=1)[:, kth])
    outlying = apart >> width[:, None].astype(np.uint32) != 0
    index["n_exceptions"] = count = outlying.sum(axis=1)
    block, at = np.nonzero(outlying)
    exceptions = np.zeros(len(block), EXCEPTION)
    exceptions["at"], exceptions["value"] = at, rows[block, at]
    apart[block, at] = 0
    index["exceptions"] = np.cumsum(count.astype(np.int64)) - count
    size = 2 * width.astype(np.int64)
    index["words"] = start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        columns, packed = np.ascontiguousarray(apart[which].T).astype(np.uint64), np.zeros((2 * w, len(which)), np.uint64)
        for k in range(BLOCK):
            word, shift = divmod(k * w, 64)
            packed[word] |= columns[k] << np.uint64(shift)
            if shift + w > 64:
                packed[word + 1] |= columns[k] >> np.uint64(64 - shift)
        words[(start[which, None] + np.arange(2 * w)).ravel()] = packed.T.ravel()
    return index, words, exceptions


def unpack(index: np.ndarray, words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The ids that `pack` was given; the index's starts count from 0."""
    rows, width = np.zeros((len(index), BLOCK), np.uint32), index["width"]
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        packed = words[index["words"][which].astype(np.int64)[:, None] + np.arange(2 * w)].T
        columns, mask = np.empty((BLOCK, len(which)), np.uint32), np.uint64((1 << w) - 1)
        for k in range(BLOCK):
            word, shift = divmod(k * w, 64)
            value = packed[word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | packed[word + 1] << np.uint64(64 - shift)
            columns[k] = value & mask
        rows[which] = columns.T
    rows += index["minimum"][:, None]
    rows[np.repeat(np.arange(len(index)), index["n_exceptions"]), exceptions["at"]] = exceptions["value"]
    return rows.ravel()


class ShardWriter:
    """Writes one shard; holds at most a frame's ids."""

    def __init__(self, out, percentile: float):
        self.out, self.percentile, self.place = out, percentile, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.indexes: list[np.ndarray] = []
        self.documents: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        rows = np.zeros(len(doc_ids), DOCUMENT)
        rows["doc_id"], rows["known"], rows["n_tokens"] = [x or 0 for x in doc_ids], [x is not None for x in doc_ids], sizes
        self.documents.append(rows)
        self.held.append(ids)
        self.n_held, self.n_ids = self.n_held + len(ids), self.n_ids + len(ids)
        if self.n_held >= FRAME * BLOCK:
            self._frames(False)

    def _frames(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.int32)
        whole = len(ids) if last else len(ids) // (FRAME * BLOCK) * FRAME * BLOCK
        for k in range(0, whole, FRAME * BLOCK):
            part = ids[k : min(whole, k + FRAME * BLOCK)]
            if short := -len(part) % BLOCK:
                part = np.concatenate((part, np.full(short, part[-1])))
            index, words, exceptions = pack(part, self.percentile)
            index["words"] = index["words"] * 8 + self.place
            index["exceptions"] = index["exceptions"] * EXCEPTION.itemsize + self.place + words.nbytes
            self.indexes.append(index)
            self.out.write(words.astype("<u8").tobytes())
            self.out.write(exceptions.tobytes())
            self.place += words.nbytes + exceptions.nbytes
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._frames(True)
        index = np.concatenate(self.indexes) if self.indexes else np.zeros(0, INDEX)
        documents = np.concatenate(self.documents) if self.documents else np.zeros(0, DOCUMENT)
        foot = np.zeros(1, FOOTER)
        foot[0] = (self.n_ids, self.place, len(index), self.place + index.nbytes, len(documents))
        for part in (index, documents, foot):
            self.out.write(part.tobytes())


class ShardReader:
    """Reads a shard's documents, or any stretch of its ids, through the index."""

    def __init__(self, file):
        self.file, size = file, file.size()
        if file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a shard of token blocks")
        self.foot = np.frombuffer(file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        self.n_ids = int(self.foot["n_ids"])
        self.index = np.frombuffer(file.read_at(int(self.foot["n_blocks"]) * INDEX.itemsize, int(self.foot["index"])), INDEX)
        self.documents = np.frombuffer(file.read_at(int(self.foot["n_documents"]) * DOCUMENT.itemsize, int(self.foot["documents"])), DOCUMENT)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        parts = []
        for k in range(first // FRAME, last // FRAME + 1):
            index = self.index[max(first, k * FRAME) : min(last + 1, (k + 1) * FRAME)].copy()
            begin, end = int(index["words"][0]), int(index["words"][-1]) + 16 * int(index["width"][-1])
            words = np.frombuffer(self.file.read_at(end - begin, begin), "<u8")
            apart, n_apart = int(index["exceptions"][0]), int(index["n_exceptions"].astype(np.int64).sum())
            exceptions = np.frombuffer(self.file.read_at(n_apart * EXCEPTION.itemsize, apart), EXCEPTION)
            index["words"] = (index["words"] - np.uint64(begin)) // np.uint64(8)
            parts.append(unpack(index, words, exceptions))
        return np.concatenate(parts)[start - first * BLOCK :][:n]


def write_shards(docs: DataFrame, vocabulary: str, end: int = 0, percentile: float = 0.97) -> DataFrame:
    """Encodes every text and writes shards in ascending doc_id order; one row for each shard: shard, uri, start, n_ids, n_documents.

    Shards are ranges of doc_id (then of the text's hash, which splits a repeated id), so their order is the order of documents and no task gathers more than its range.
    """
    spark = prepare(docs.sparkSession)
    uri = scratch(spark, "token-blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, none = TaskContext.get().partitionId(), tokenizer(vocabulary).encode, True
        name = f"{uri}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.pfor"
        with create(name) as out:
            writer = ShardWriter(out, percentile)
            for batch in batches:
                ids_of = batch.column("doc_id").to_pylist()
                texts = batch.column("text").to_pylist()
                for k in range(0, len(texts), 200):
                    writer.add(ids_of[k : k + 200], *encode(texts[k : k + 200], end))
                    none = False
            writer.close()
        if not none:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [name], "n_ids": [writer.n_ids], "n_documents": [sum(map(len, writer.documents))]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    shards = sorted(ranged.mapInArrow(write, "shard long, uri string, n_ids long, n_documents long").collect())  # a row for each shard
    starts, total = [], 0
    for s in shards:
        starts.append((s.shard, s.uri, total, s.n_ids, s.n_documents))
        total += s.n_ids
    return spark.createDataFrame(starts, "shard long, uri string, start long, n_ids long, n_documents long")


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents from shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), shard."""
    from zlib import crc32

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            with source(row["uri"]) as file:
                reader = ShardReader(file)
                ends = np.cumsum(reader.documents["n_tokens"].astype(np.int64))
                at = 0
                while at < len(ends):  # about a frame's ids at a time
                    begin = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, begin + FRAME * BLOCK, "right")))
                    ids = memoryview(reader.ids(begin, int(ends[to - 1]) - begin).astype("<u4", copy=False))
                    docs, bounds = reader.documents[at:to], [begin, *ends[at:to].tolist()]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs["doc_id"].astype(np.int64), mask=docs["known"] == 0),
                            "start": pa.array([row["start"] + b for b in bounds[:-1]], pa.int64()),
                            "n_tokens": pa.array(docs["n_tokens"].astype(np.int64)),
                            "ids_crc32": pa.array([crc32(ids[a - begin : b - begin]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                            "shard": pa.array([row["shard"]] * len(docs), pa.int64()),
                        }
                    )
                    at = to

    n = max(1, shards.count())
    return shards.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
