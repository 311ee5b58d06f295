"""WARC archives and the monolithic gzip normaliser.

`write_archives` writes one WARC/1.1 record for each row into archives that
are each one gzip member, as careless crawlers leave them.  `normalise`
inflates such a stream once, from front to back, rewrites every record as its
own gzip member and writes a sidecar index of offsets (JSON lines), so that
`read_records` can fetch any record by a range read.

Deduplication: records with equal payloads of at least `least` bytes are one
response (the largest page_id) and revisits of it.  Only row numbers, ids and
digests are joined; what they say is noted for the task that meets the row
again, so no payload is shuffled.  Digests meet in a partial aggregation; the
join leaves hot digests to adaptive execution, which splits the rows' side.

Edges: null and empty html is an empty payload; a null page_id counts as the
smallest; repeated rows with the largest page_id are all responses; a null
url is an empty target; line ends in urls are escaped; an archive that ends
before its last gzip member or record does is an error; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import Notes, create, materialize, notes, prepare, replayable, row_number, scratch, source

_STAMP = "2000-01-01T00:00:00Z"  # archives are a function of their rows
_PIECE = 1 << 20


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html of each row; null html is empty."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def revisits(rows: DataFrame, least: int = 1000) -> DataFrame:
    """(row, digest, refers_to) of the rows (page_id, html, of a replayable table) that are revisits."""
    keyed = rows.select(row_number().alias("row"), "page_id", F.octet_length("html").alias("n_bytes"), F.sha1(F.encode("html", "utf-8")).alias("digest")).where(F.col("n_bytes") >= least)
    keyed = materialize(keyed, "digests")
    copies = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1")
    return keyed.join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("row", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block is empty and names the record that it refers to."""
    block = payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Date": _STAMP,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", "X-Refers-To-Page": "" if refers_to is None else str(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, block, whole record) of each record of an inflated stream, which is read once and never held whole."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(stream, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end, seen = -1, 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header is cut off")
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if not fill(stop + 4):
            raise ValueError("a record's block is cut off")
        yield head, bytes(held[start:stop]), bytes(held[: stop + 4])
        del held[: stop + 4]


def _inflated(file: pa.NativeFile) -> Iterator[bytes]:
    """A gzip file's content in bounded pieces, over one or many members; the last must have ended, check sum and all."""
    unpack, inside = zlib.decompressobj(31), False
    while data := file.read(_PIECE):
        while data:
            inside = True
            out = unpack.decompress(data, _PIECE)
            if out:
                yield out
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, inside = unpack.unused_data, zlib.decompressobj(31), False
    while inside and (out := unpack.decompress(b"", _PIECE)):
        yield out
    if inside and not unpack.eof:
        raise ValueError("the archive is cut off")


def _gzip(level: int):
    return zlib.compressobj(level, zlib.DEFLATED, 31)


def write_archives(pages: DataFrame, least: int = 1000, level: int = 3) -> DataFrame:
    """Writes the rows of pages into whole-file gzip archives, one for each partition; a row for each: archive."""
    rows = replayable(payloads(pages))
    uri, noted = scratch(prepare(rows.sparkSession), "warc"), notes(revisits(rows, least))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name, pack, none, said = f"{uri}/archive-{task:06d}-{TaskContext.get().taskAttemptId()}.warc.gz", _gzip(level), True, Notes(noted, task)
        with create(name) as out:
            for batch in batches:
                ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
                at, about = said.upto(len(ids))
                refers = dict(zip(at.tolist(), zip(about["digest"].to_pylist(), about["refers_to"].to_pylist()))) if len(at) else {}
                for k, html in enumerate(batch.column("html").cast(pa.binary()).to_pylist()):
                    digest, none = hashlib.sha1(html).hexdigest(), False
                    kind, to = ("revisit", refers[k][1]) if k in refers else ("response", None)
                    if k in refers and refers[k][0] != digest:
                        raise ValueError("the table changed between two jobs")
                    out.write(pack.compress(record(ids[k], urls[k], html, digest, kind, to)))
            out.write(pack.flush())
        if not none:
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    return materialize(rows.mapInArrow(write, "archive string"), "archives")


def normalise(archives: DataFrame, level: int = 3, drop: bool = True) -> DataFrame:
    """Rewrites each archive with one gzip member for each record and a sidecar index; a row for each: archive, index, n_records.

    drop: the monolithic archive goes once its successor is whole (a second attempt that finds it gone and the successor there is done).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gossamer.llm.shared import fetch, filesystem

        for name in (n for b in batches for n in b.column("archive").to_pylist()):
            out_name = name.removesuffix(".warc.gz") + "-members.warc.gz"
            index_name, entries, place = out_name + ".idx", [], 0
            files, path = filesystem(name)
            if files.get_file_info(path).type.name == "NotFound":
                entries = fetch(index_name).decode().splitlines()
            else:
                with source(name) as file, create(out_name) as out:
                    for head, _, whole in records(_inflated(file)):
                        pack = _gzip(level)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        entries.append(json.dumps({"page": head["X-Page-ID"], "offset": place, "length": len(member)}))
                        place += len(member)
                with create(index_name) as out:
                    out.write("".join(e + "\n" for e in entries).encode())
                if drop:
                    files.delete_file(path)
            yield pa.RecordBatch.from_pydict({"archive": [out_name], "index": [index_name], "n_records": [len(entries)]})

    return materialize(archives.repartition(max(1, archives.count())).mapInArrow(run, "archive string, index string, n_records long"), "warc-index")


def read_records(archives: DataFrame) -> DataFrame:
    """Reads the members that the sidecar indexes list: page_id, payload_bytes, payload_digest, record_type, refers_to, url, block.

    A response's digest and length come from its block, and must agree with its header.
    """
    from gossamer.llm.shared import fetch

    def number(text: str) -> int | None:
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "block"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for row in (r for b in batches for r in b.to_pylist()):
            with source(row["archive"]) as file:
                found, held = [], 0
                for line in fetch(row["index"]).decode().splitlines():
                    entry = json.loads(line)
                    whole = zlib.decompress(file.read_at(entry["length"], entry["offset"]), 31)
                    head, block, _ = next(records(iter([whole])))
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
                        raise ValueError("a record's payload does not match its digest")
                    found.append((number(head["X-Page-ID"]), size, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page", "")), head["WARC-Target-URI"], block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                        found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return archives.repartition(max(1, archives.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, block binary")
