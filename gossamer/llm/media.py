"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, followed by zero bytes up to a positive multiple of 64,
are the samples of an 8-bit greyscale PNG image 64 pixels wide.  Each
distinct payload is stored once, under its SHA-256, as a member of a tar
shard; a row carries digest, shard, offset and length.  Metadata columns
(width, height, depth, colour) are filled by range reads of the 33 bytes of
PNG signature and header; pixel features by reading the member back.

Copies meet by digest: of the rows of a digest the first (by row number) is
elected in a partial aggregation, and the task that meets the elected row
stores its payload.  Only row numbers and digests are shuffled, never a
payload, and none is stored twice; what a lost attempt wrote is deleted.

Edges: a null or empty text is 64 zero bytes; null doc_ids and repeated rows
are kept; texts that differ only in trailing NULs share a payload and keep
their own n_bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gossamer.llm.shared import Notes, create, filesystem, materialize, notes, prepare, replayable, row_number, scratch, source

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: bytes) -> bytes:
    """Zero bytes are appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit greyscale image whose pixels are the payload."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(pixels), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = pixels
    head = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, depth, colour type) from a member's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """The payload of an image that `encode_png` made."""
    width, height, depth, colour = read_header(data)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an 8-bit greyscale image 64 pixels wide")
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("lines are filtered")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes, header: tuple[int, int, int, int]) -> str:
    """Size of the image and a 64-bit average hash: it is cut in 64 strips of bytes, and a bit is 1 if its strip's mean exceeds the whole mean."""
    pixels = np.frombuffer(payload, np.uint8)
    strips = pixels.reshape(64, -1).sum(axis=1, dtype=np.int64) * 64 > int(pixels.sum(dtype=np.int64))
    width, height, depth, _ = header
    return f"{width}x{height}x{depth}:{np.packbits(strips).tobytes().hex()}:{int(pixels.sum(dtype=np.int64)) // len(pixels)}"


def payload_column() -> Column:
    """The payload of column text, in the JVM."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), pad))


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, digest (SHA-256 of the payload) of each row of a replayable table; stays in the JVM."""
    n = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), n.cast("long").alias("n_bytes"), F.sha2(payload_column(), 256).alias("digest"))


def store(docs: DataFrame, keyed: DataFrame, level: int = 6) -> DataFrame:
    """Writes the payloads of docs (replayable) into tar shards; one row for each distinct one: digest, shard (its URI), offset, length.

    keyed: the digests of docs.  Each input task writes a shard of its own with the payloads whose elected rows it meets.
    """
    spark = prepare(docs.sparkSession)
    uri, noted = scratch(spark, "media"), notes(keyed.groupBy("digest").agg(F.min("row").alias("row")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The attempt is part of the name: the index of the attempt that counts refers to the file that it wrote.
        task = TaskContext.get().partitionId()
        shard, said, place = f"{uri}/shard-{task:06d}-{TaskContext.get().taskAttemptId()}.tar", Notes(noted, task), 0
        with create(shard) as out:
            for batch in batches:
                at, about = said.upto(batch.num_rows)
                if not len(at):
                    continue
                texts, rows = batch.column("text").take(pa.array(at)).cast(pa.binary()).to_pylist(), []
                for text, expected in zip(texts, about["digest"].to_pylist()):
                    payload = payload_of(text or b"")
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != expected:
                        raise ValueError("the table changed between two jobs")
                    data, info = encode_png(payload, level), tarfile.TarInfo(f"{digest}.png")
                    info.size = len(data)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
                    rows.append((digest, shard, place + len(head), len(data)))
                    place += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
            out.write(bytes(2 * tarfile.BLOCKSIZE))

    stored = materialize(docs.select(F.col("text").cast("string")).mapInArrow(write, "digest string, shard string, offset long, length long"), "media-index")
    drop_orphans(uri, stored)
    # Read shard by shard, in order.
    return stored.repartition("shard").sortWithinPartitions("shard", "offset")


def drop_orphans(uri: str, stored: DataFrame) -> None:
    """Deletes shards that the index does not name: those of lost attempts, and those without a payload."""
    named = {r.shard.rsplit("/", 1)[1] for r in stored.select("shard").distinct().toLocalIterator()}  # a name for each task
    files, path = filesystem(uri)
    for f in files.get_file_info(FileSelector(path)):
        if f.base_name.endswith(".tar") and f.base_name not in named:
            files.delete_file(f.path)


def header_columns(index: DataFrame) -> DataFrame:
    """index with width, height, depth and colour; only the first 33 bytes of each member are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            with source(shard) as file:
                heads = [read_header(file.read_at(HEAD, r["offset"])) for r in rows]
            columns = {k: [r[k] for r in rows] for k in ("digest", "shard", "offset", "length")}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array([h[i] for h in heads], pa.int32()) for i, k in enumerate(("width", "height", "depth", "colour"))})

    return index.mapInArrow(read, "digest string, shard string, offset long, length long, width int, height int, depth int, colour int")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    for batch in batches:
        rows: dict[str, list[dict]] = {}
        for r in batch.to_pylist():
            rows.setdefault(r["shard"], []).append(r)
        yield from rows.items()


def features(index: DataFrame) -> DataFrame:
    """index with what each member, read back whole, holds: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kept = index.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            found = []
            with source(shard) as file:
                for r in rows:
                    media = file.read_at(r["length"], r["offset"])
                    payload = decode_png(media)
                    found.append((*(r[c] for c in kept), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, (r["width"], r["height"], r["depth"], 0))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    schema = StructType(index.schema.fields + _parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields)
    names, kinds = schema.names, [f.type for f in to_arrow_schema(schema)]
    return index.mapInArrow(read, schema)


def media_columns(docs: DataFrame, level: int = 6) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, digest, shard, offset, length, header columns and features.

    The join by digest leaves hot digests to adaptive execution, which splits the rows' side.
    """
    docs = replayable(docs.select("doc_id", "text"))
    keyed = materialize(digests(docs), "digests")
    return keyed.drop("row").join(features(header_columns(store(docs, keyed, level))), "digest", "left")


def member(shard: str, offset: int, length: int) -> bytes:
    """A stored member's bytes."""
    with source(shard) as file:
        return file.read_at(length, offset)


def members(shard: str) -> list[str]:
    """Names in a tar shard, read as any tar file."""
    with source(shard) as file, tarfile.open(fileobj=BytesIO(file.read())) as tar:
        return tar.getnames()
