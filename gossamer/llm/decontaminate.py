"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of documents of one input partition, of a bounded number
of words; a longer document is cut into stretches that overlap by a window
less one word, each a shard of its own.  All of a shard's words are numbered by
its own vocabulary.  The suffixes are sorted by prefix doubling, from rank to
rank only where they are not yet apart (each separator between documents is a
symbol of its own, so the order is total), the Burrows-Wheeler transform goes
into a wavelet matrix, all windows are searched backward at once through its
ranks, and occurrences are located by walking back to sampled suffixes; the
first position of each stretch is a sample, so no walk crosses a separator.
The words inside occurrences are merged to removal spans.

The windows are a stated query set.  Spark cuts the items into windows and
writes equal ones once, with their items, to files of about `per_file` windows
in the shared folder; each shard is asked for one file after another.  A window
with a word that a shard hasn't can't occur there.

Edges: null, empty and word-less texts have no words; an item of no words has
no window; equal items and equal windows each count for all their items;
null item_ids give hits but are in no list; repeated rows and null doc_ids
are kept; an empty benchmark hits nothing; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import filesystem, fresh, materialize, prepare, source, texts_of

#: Word characters stay, A-Z are lower-cased, all other ASCII characters become spaces.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SAMPLE = 16


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text."""
    return text.translate(WORDS).split()


class BitRank:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate((bits, np.zeros(64 - len(bits) % 64, bool))), bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.n, self.ones = len(bits), int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols by bit planes from the highest: zeros of a plane go before its ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth, self.planes = max(1, int(n_symbols - 1).bit_length()), []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.planes.append(BitRank(bits))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        begin = np.zeros_like(at)
        for level, plane in zip(range(self.depth - 1, -1, -1), self.planes):
            one, zeros = (symbols >> level & 1).astype(bool), plane.n - plane.ones
            ones_at, ones_begin = plane.rank(at), plane.rank(begin)
            at = np.where(one, zeros + ones_at, at - ones_at)
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, how often it is before that place)."""
        symbols, begin = np.zeros_like(at), np.zeros_like(at)
        for plane in self.planes:
            one, zeros = plane.get(at), plane.n - plane.ones
            ones_at, ones_begin = plane.rank(at), plane.rank(begin)
            at = np.where(one, zeros + ones_at, at - ones_at)
            begin = np.where(one, zeros + ones_begin, begin - ones_begin)
            symbols = symbols << 1 | one
        return symbols, at - begin


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order.  Zeros are separators, each smaller than the next and than all symbols; the text ends with one."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) - 1 + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    slots = np.arange(n)  # places of the order that are not settled; equal ranks lie side by side
    h = 1
    sorted_rank = rank[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1])))
    sizes = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads, sizes)  # a suffix's rank is its group's first place
    slots = slots[np.repeat(sizes > 1, sizes)]
    while len(slots):
        some = order[slots]
        behind = rank[np.minimum(some + h, n - 1)]  # the last symbol is a separator and settled, so no unsettled suffix ends here
        key = rank[some] * np.int64(n) + behind
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[some] = np.repeat(slots[heads], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


class FMIndex:
    """Backward search over one shard's symbols; 0 separates."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(text)
        self.n = len(text)
        before = text[order - 1]  # the text ends with a separator, which stands before its first place too
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.matrix = WaveletMatrix(before, n_symbols)
        first = np.concatenate(([True], text[:-1] == 0))
        sampled = (order % sample == 0) | first[order]
        self.sampled, self.places = BitRank(sampled), order[sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each window (equal lengths)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        alive = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, k]
            at = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low[alive], high[alive])))
            low[alive], high[alive] = self.below[symbol] + at[: len(alive)], self.below[symbol] + at[len(alive) :]
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        dead = np.ones(len(windows), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place of the suffix in each row."""
        places, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        rows = rows.copy()
        while len(alive):
            found = self.sampled.get(rows[alive])
            done = alive[found]
            places[done] = self.places[self.sampled.rank(rows[done])] + steps[done]
            alive = alive[~found]
            if len(alive):
                symbol, count = self.matrix.access(rows[alive])
                rows[alive] = self.below[symbol] + count
                steps[alive] += 1
        return places


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """All windows of an item, their words space-joined; a shorter item is one window, no words are none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]


def write_windows(benchmark: DataFrame, size: int = 13, per_file: int = 200_000) -> str:
    """Writes the benchmark's distinct windows (text, items) to Parquet files of about per_file windows in the shared folder; returns the folder."""
    spark = prepare(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch.column("text"))):
                found = list(dict.fromkeys(windows_of(words_of(text), size)))
                for k in range(0, len(found), 10_000):
                    some = found[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"window": pa.array(some, pa.binary()), "item": pa.array([item] * len(some), pa.string())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    # A copy of each (window, item) is enough; those of a window then meet.
    windows = materialize(items.mapInArrow(cut, "window binary, item string").distinct().groupBy("window").agg(F.array_sort(F.collect_list("item")).alias("items")), "windows")
    uri = fresh(spark, "benchmark")
    windows.repartition(max(1, -(-windows.count() // per_file)), F.xxhash64("window")).write.parquet(uri)
    return uri


class WindowTable:
    """One file of windows: its words, and for each length the windows as places in them, with their items."""

    def __init__(self, name: str):
        with source(name) as file:
            table = pq.ParquetFile(file).read()
        split = [w.split() for w in table.column("window").to_pylist()]
        owners = table.column("items").to_pylist()
        number: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for words, items in zip(split, owners):
            windows, about = by_length.setdefault(len(words), ([], []))
            windows.append([number.setdefault(w, len(number)) for w in words])
            about.append(items)
        self.words = list(number)
        self.lengths = [(np.array(windows, np.int64), about) for _, (windows, about) in sorted(by_length.items())]

    def coded(self, vocabulary: dict[bytes, int]) -> Iterator[tuple[np.ndarray, list[list[str]]]]:
        """(windows as symbols of a shard, their items) of each length; those with words that the shard hasn't are left out."""
        symbol = np.fromiter((vocabulary.get(w, 0) for w in self.words), np.int64, len(self.words))
        for windows, about in self.lengths:
            symbols = symbol[windows]
            there = np.flatnonzero(symbols.all(axis=1))
            if len(there):
                yield symbols[there], [about[k] for k in there.tolist()]


_TABLES: dict[str, tuple[list[str], WindowTable | None]] = {}


def tables_of(uri: str) -> Iterator[WindowTable]:
    """The files of windows, one after another; the first stays with the worker."""
    if uri not in _TABLES:
        files, path = filesystem(uri)
        names = sorted(f"{uri}/{f.base_name}" for f in files.get_file_info(FileSelector(path)) if f.base_name.endswith(".parquet"))
        _TABLES.clear()
        _TABLES[uri] = names, WindowTable(names[0]) if names else None
    names, first = _TABLES[uri]
    for k, name in enumerate(names):
        yield first if k == 0 else WindowTable(name)


def numbering() -> defaultdict[bytes, int]:
    """A vocabulary that numbers words from 1 on as they come."""
    return defaultdict(count(1).__next__)


def search_shard(stretches: list[np.ndarray], vocabulary: dict[bytes, int], tables: Iterator[WindowTable]) -> tuple[list[np.ndarray], list[set[str]]]:
    """(which words are hit, item ids) of each stretch of symbols."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    for at, part in zip(begin.tolist(), stretches):
        text[at : at + len(part)] = part
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    hit = np.zeros(len(text) + 1, np.int64)
    items: list[set[str]] = [set() for _ in stretches]
    if sizes.sum():
        index = FMIndex(text, len(vocabulary) + 1)
        for table in tables:
            for windows, owners in table.coded(vocabulary):
                low, high = index.search(windows)
                n = high - low
                which = np.flatnonzero(n)
                for k in range(0, len(which), 4096):  # occurrences of so many windows at a time
                    some = which[k : k + 4096]
                    rows = np.repeat(low[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
                    at = index.locate(rows)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + windows.shape[1], -1)
                    pairs = np.unique(of[at] * np.int64(len(owners)) + np.repeat(some, n[some]))
                    for d, w in zip((pairs // len(owners)).tolist(), (pairs % len(owners)).tolist()):
                        items[d].update(x for x in owners[w] if x is not None)
    inside = np.cumsum(hit[:-1]) > 0
    return [inside[a : a + n] for a, n in zip(begin.tolist(), sizes.tolist())], items


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, keep: list[str] | None = None, shard_words: int = 1_000_000) -> DataFrame:
    """One row for each row of docs: the columns `keep` (doc_id), n_words, spans (merged removal spans in words, end exclusive), items.

    shard_words bounds the words of one index.
    """
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    if shard_words < 2 * size:
        raise ValueError("a shard holds two windows at least")
    uri = write_windows(benchmark, size)
    wanted = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = numbering()
        held: list[pa.RecordBatch] = []
        parts: list[np.ndarray] = []
        n_held = 0

        def code(words: list[bytes]) -> np.ndarray:
            return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))

        def rows(kept: list[pa.RecordBatch], hits: list[np.ndarray], items: list[set[str]]) -> pa.RecordBatch:
            spans = []
            for hit in hits:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            columns = [pa.concat_arrays([b.column(k) for b in kept]) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays(
                [
                    *columns,
                    pa.array([len(h) for h in hits], pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*keep, "n_words", "spans", "items"],
            )

        def emit() -> pa.RecordBatch:
            nonlocal held, parts, n_held, vocabulary
            out = rows(held, *search_shard(parts, vocabulary, tables_of(uri)))
            held, parts, n_held, vocabulary = [], [], 0, numbering()
            return out

        for batch in batches:
            for k, text in enumerate(texts_of(batch.column(batch.num_columns - 1))):
                words, own = words_of(text), batch.slice(k, 1).select(list(range(batch.num_columns - 1)))
                if parts and n_held + len(words) > shard_words:
                    yield emit()
                if len(words) <= shard_words:
                    held.append(own)
                    parts.append(code(words))
                    n_held += len(words)
                    continue
                hit, items = np.zeros(len(words), bool), set()
                for a in range(0, len(words) - size + 1, shard_words - size + 1):
                    found, some = search_shard([code(words[a : a + shard_words])], vocabulary, tables_of(uri))
                    hit[a : a + shard_words] |= found[0]
                    items |= some[0]
                    vocabulary = numbering()
                yield rows([own], [hit], [items])
        if parts:
            yield emit()

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return wanted.mapInArrow(run, f"{kinds}, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def n_hit(spans: str) -> Column:
    """Words inside the removal spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def contaminated(n_words: Column, hit: Column, share: int = 20) -> Column:
    """A document is contaminated if at least one word in `share` is hit."""
    return (hit > 0) & (share * hit >= n_words)
