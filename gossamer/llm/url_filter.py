"""URL filters over a sorted digest array.

Rules (host suffix and path prefix, with a verdict) are kept as sorted arrays
of 64-bit XXH64 keys (seed 42) of `host NUL path`, with the full strings beside
them; each file is a range of keys, built by one task, so a list of any length
passes through no single process.  A worker maps the files into memory; a
batch of urls gives all its candidate strings (each of a host's suffixes of at
most as many labels as any rule's host, with each prefix length that any rule's
path has), which are probed by vectorised binary search, and every hit is confirmed against the stored string, so
collisions do no harm.  The longest rule wins.  A url that no rule fits gets
the `default` verdict.

File: b"URLDGST3", number of rules, number of path lengths, most labels of a
host (int64 each), path lengths, keys (uint64, sorted), string bounds (int64, one more), verdicts
(uint8, 1 blocks), strings.

Edges: a url that is null or has no "://" has an empty host and path, and no
rule fits; an empty host fits no rule; ports and user names are part of the
host; a rule's path that begins without "/" fits nothing unless it is empty; equal rules with different verdicts block; rules with a null or empty
host are left out; repeated rows and null page_ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.shared import create, fetch, filesystem, prepare, scratch

MAGIC = b"URLDGST3"
#: Between host and path in a stored string, so that neither can run into the other.
BETWEEN = b"\0"
SEED = 42
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    end = min((p for p in (rest.find("?", host), rest.find("#", host)) if p >= 0), default=len(rest))
    return rest[:host].translate(_LOWER), rest[host:end]


def write_digests(rules: Iterator[tuple[str, str, str]], uri: str) -> None:
    """Writes one file of (host, path, verdict) rules."""
    verdicts: dict[bytes, int] = {}
    paths: set[int] = set()
    labels = 0
    for host, path, verdict in rules:
        host = host.translate(_LOWER)
        key = host.encode() + BETWEEN + path.encode()
        labels = max(labels, host.count(".") + 1)
        verdicts[key] = max(verdicts.get(key, 0), int(verdict == "block"))
        paths.add(len(path))
    rows = sorted((xxhash.xxh64_intdigest(k, SEED), k) for k in verdicts)
    lengths = np.array(sorted(paths), "<i8")
    bounds = np.concatenate(([0], np.cumsum([len(k) for _, k in rows], dtype=np.int64))).astype("<i8")
    with create(uri) as out:
        out.write(MAGIC + np.array([len(rows), len(lengths), labels], "<i8").tobytes() + lengths.tobytes())
        out.write(np.array([h for h, _ in rows], "<u8").tobytes() + bounds.tobytes())
        out.write(bytes(verdicts[k] for _, k in rows) + b"".join(k for _, k in rows))


class DigestArray:
    """One mapped file."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        if type(files).__name__ != "LocalFileSystem":  # a worker's own copy, deleted with the worker
            self.copy = tempfile.NamedTemporaryFile()
            self.copy.write(fetch(uri))
            self.copy.flush()
            path = self.copy.name
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not an array of url digests")
        n, m, self.labels = raw[8:32].view("<i8").tolist()
        parts, at = [], 32
        for kind, count in (("<i8", m), ("<u8", n), ("<i8", n + 1), ("u1", n)):
            size = np.dtype(kind).itemsize * count
            parts.append(raw[at : at + size].view(kind))
            at += size
        self.lengths, self.keys, self.bounds, self.verdicts = parts
        self.strings = raw[at:]

    def probe(self, wanted: np.ndarray, some: np.ndarray, candidates: list[bytes], found: list[tuple[bytes, int] | None]) -> None:
        """Puts (string, verdict) of the rule that each candidate is; wanted are the candidates' keys, `some` those to be looked up here."""
        own = wanted[some]
        at = np.searchsorted(self.keys, own)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == own)
        for k, place in zip(some[hits].tolist(), at[hits].tolist()):
            while place < len(self.keys) and self.keys[place] == wanted[k]:  # equal keys: the string decides
                if (string := self.strings[self.bounds[place] : self.bounds[place + 1]].tobytes()) == candidates[k]:
                    found[k] = string, int(self.verdicts[place])
                    break
                place += 1


class DigestArrays:
    """All files of a folder, in the order of their keys; a candidate is probed in the one whose range its key meets."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        names = sorted(f.base_name for f in files.get_file_info(FileSelector(path)) if f.base_name.endswith(".digests"))
        self.arrays = sorted((a for a in (DigestArray(f"{uri}/{n}") for n in names) if len(a.keys)), key=lambda a: int(a.keys[0]))
        self.firsts = np.array([a.keys[0] for a in self.arrays], np.uint64)
        self.lasts = np.array([a.keys[-1] for a in self.arrays], np.uint64)
        self.lengths = sorted({n for a in self.arrays for n in a.lengths.tolist()})
        self.labels = max((a.labels for a in self.arrays), default=0)

    def probe(self, candidates: list[bytes]) -> list[tuple[bytes, int] | None]:
        found: list[tuple[bytes, int] | None] = [None] * len(candidates)
        wanted = np.fromiter((xxhash.xxh64_intdigest(c, SEED) for c in candidates), np.uint64, len(candidates))
        if not self.arrays:
            return found
        order = np.argsort(wanted, kind="stable")
        begins, ends = np.searchsorted(wanted[order], self.firsts), np.searchsorted(wanted[order], self.lasts, "right")
        for k in np.flatnonzero(ends > begins).tolist():
            self.arrays[k].probe(wanted, order[begins[k] : ends[k]], candidates, found)
        return found


_OPEN: dict[str, DigestArrays] = {}


def _arrays(uri: str) -> DigestArrays:
    if uri not in _OPEN:
        _OPEN.clear()
        _OPEN[uri] = DigestArrays(uri)
    return _OPEN[uri]


def judge(arrays: DigestArrays, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
    """(host, path, rule, the rule's verdict) of each url."""
    split = [split_url(u) for u in urls]
    candidates: list[bytes] = []
    owner: list[int] = []
    for k, (host, path) in enumerate(split):
        prefixes = [BETWEEN + path[:n].encode(errors="surrogatepass") for n in arrays.lengths if n <= len(path)]
        end = len(host)
        for _ in range(arrays.labels):  # the tails of so many labels at most
            dot = host.rfind(".", 0, end) if end > 0 else -1
            if tail := host[dot + 1 :].encode(errors="surrogatepass"):
                candidates += [tail + p for p in prefixes]
                owner += [k] * len(prefixes)
            if dot < 0:
                break
            end = dot
    best: dict[int, tuple[bytes, int]] = {}
    for k, hit in zip(owner, arrays.probe(candidates)):
        if hit and (k not in best or len(hit[0]) > len(best[k][0])):
            best[k] = hit
    return [(host, path, *((best[k][0].replace(BETWEEN, b"", 1).decode(), ("allow", "block")[best[k][1]]) if k in best else (None, None))) for k, (host, path) in enumerate(split)]


def build(spark: SparkSession, rules: DataFrame, files: int | None = None) -> str:
    """Writes the arrays of a table (host, path, verdict) to the shared folder; returns the folder's URI.  files: ranges of keys, Spark's number by default."""
    uri = scratch(prepare(spark), "url-digests")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [(r["host"], r["path"], r["verdict"]) for b in batches for r in b.to_pylist()]
        if rows:
            write_digests(iter(rows), f"{uri}/{TaskContext.get().partitionId():06d}.digests")
        yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

    known = rules.where("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    lower = known.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    # Spark's xxhash64 of one string is XXH64 with SEED: the stored key.  Its sign is turned, so signed order is the keys' order;
    # equal rules have equal keys and so meet in one file.
    key = F.xxhash64(F.concat("host", F.lit(BETWEEN.decode()), "path")).bitwiseXOR(F.lit(-(1 << 63)))
    dealt = lower.repartitionByRange(files, key) if files else lower.repartitionByRange(key)
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return uri


def filter_urls(pages: DataFrame, array: str, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (page_id), host, path, rule and verdict of each row's url."""
    prepare(pages.sparkSession)
    keep = keep or ["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(_arrays(array), batch.column(batch.num_columns - 1).to_pylist())
            host, path, rule, verdict = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())], names=[*keep, "host", "path", "rule", "verdict"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes)
    return pages.select(*keep, F.col("url").cast("string").alias("__url")).mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")
