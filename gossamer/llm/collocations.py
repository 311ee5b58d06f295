"""Phrase collocation mining by hashed bucket counts (PCY / DHP).

Texts are cut into pieces at punctuation and line ends, pieces into words;
phrases are runs of words within a piece.  Each pass over the corpus counts the
phrases of one length exactly, and those of the next length in hashed buckets.
The buckets that reach the least frequency are broadcast as a bitmap, and so
are the hashes of the phrases that did (both `1 << bits` bits, whatever the
corpus).  The next pass counts a phrase only if its bucket is set and, after
Apriori, both phrases one word shorter may be frequent; it hashes a longer one
into buckets only if both its ends passed the same tests.  Bits can be shared,
so they only save work: what is kept is decided by exact counts.

A task adds up its own counts and buckets before anything is shuffled, so a
word that is everywhere is a row for each task.  Longer phrases that contain
a candidate meet it as the largest count for each contained phrase, and the
best of each group are first found within salted parts of the group.

Edges: null and empty texts have no words; a null group is `und`; repeated
rows and equal ids count each; an empty table, or one without candidates,
gives no rows; other columns are ignored.  A batch of texts is held by one
task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.shared import materialize, prepare

#: Words of the longest phrase.
LONGEST = 4
#: Bits of a bitmap, as a power of two: 1 << 24 bits are 2 MB.
BITS = 24
#: Bytes of bucket counts in one row; a task holds 4 << BITS bytes of counts.
BLOCK = 1 << 16
#: Distinct phrases that a task adds up before it hands them on.
HELD = 200_000
#: Bytes of texts that are cut into words together, or one longer text.
CHUNK = 4_000_000

_SPLIT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK[[0x20, 0x09]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(texts: list[bytes], groups: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words, the number of each word's piece, its group) of texts; a text ends its last piece."""
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # places after each text's line end
    blank, cut = _BLANK[raw], _SPLIT[raw]
    inside = np.concatenate(([False], ~(blank | cut), [False]))
    start, stop = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = stop - start
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]].tobytes()))
    return words, np.cumsum(cut)[start] if len(start) else start, groups[np.searchsorted(ends, start, "right")]


def hashes_of(words: list[str]) -> np.ndarray:
    """64-bit hashes that are the same in every task."""
    return hash_array(np.array(words, object), categorize=False)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Counts:
    """What one task has counted: phrases (group, phrase) exactly, and the buckets of those one word longer."""

    def __init__(self, bits: int, least: int, buckets: bool):
        self.phrases: dict[tuple[str, str], int] = {}
        self.least = least
        self.buckets = np.zeros(1 << bits, np.uint32) if buckets else None

    def add_phrases(self, keys: list[tuple[str, str]], counts: np.ndarray) -> None:
        held = self.phrases
        for key, n in zip(keys, counts.tolist()):
            held[key] = held.get(key, 0) + n

    def add_buckets(self, hashes: np.ndarray) -> None:
        np.add.at(self.buckets, (hashes & np.uint64(len(self.buckets) - 1)).astype(np.int64), np.uint32(1))

    def block(self, at: int) -> np.ndarray:
        """Counts from place `at`, cut at the least frequency or at 255, which is then the bitmap's bound."""
        return np.minimum(self.buckets[at : at + BLOCK], min(self.least, 255)).astype(np.uint8)


def _set(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set; all are where there is no bitmap."""
    if bitmap is None:
        return np.ones(len(hashes), bool)
    at = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def count_chunk(texts: list[bytes], groups: np.ndarray, names: list[str], length: int, bucket_bits: np.ndarray | None, frequent: np.ndarray | None, out: Counts) -> None:
    """Adds the phrases of `length` words that may be frequent, and the buckets of those one word longer.

    bucket_bits: buckets of this length; frequent: hashes of the frequent phrases one word shorter.
    """
    words, piece, group = words_of(texts, groups)
    if not len(words):
        return
    coded = words.dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    salt, word_hash = ~hashes_of(names)[group], hashes_of(known)[code]

    def hashes(k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each place, whether they are in one piece)."""
        n = len(code) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = salt[:n].copy()
        for s in range(k):
            h = _mix(h ^ word_hash[s : n + s])
        return h, piece[:n] == piece[k - 1 :]

    own, whole = hashes(length)
    passed = whole & _set(bucket_bits, own)
    if length > 1 and len(own):
        shorter = _set(frequent, hashes(length - 1)[0])
        passed &= shorter[:-1] & shorter[1:]
    at = np.flatnonzero(passed)
    if length == 1:
        each = np.bincount(group * len(known) + code)
        found = np.flatnonzero(each)
        out.add_phrases([(names[k // len(known)], known[k % len(known)]) for k in found.tolist()], each[found])
    elif len(at):
        # Phrases are told apart by their words; sorted by hash, equal ones lie side by side, but for shared hashes.
        at = at[np.argsort(own[at])]
        differs = np.ones(len(at), bool)
        differs[1:] = group[at[1:]] != group[at[:-1]]
        for s in range(length):
            differs[1:] |= code[at[1:] + s] != code[at[:-1] + s]
        first = np.flatnonzero(differs)
        columns = [code[at[first] + s].tolist() for s in range(length)]
        keys = [(names[g], " ".join([known[c] for c in row])) for g, row in zip(group[at[first]].tolist(), zip(*columns))]
        out.add_phrases(keys, np.diff(np.append(first, len(at))))
    if out.buckets is not None:
        longer, whole = hashes(length + 1)
        if len(longer):
            out.add_buckets(longer[whole & passed[:-1] & passed[1:]])


def _pass(docs: DataFrame, length: int, least: int, bits: int, bucket_bits: np.ndarray | None, frequent: np.ndarray | None) -> tuple[DataFrame, np.ndarray | None, np.ndarray | None]:
    """(group, phrase, n) of the phrases of `length` words with at least `least` (all words for 1), the bitmap of the next length's buckets, that of these phrases' hashes."""
    spark = docs.sparkSession
    more = length < LONGEST
    sent = spark.sparkContext.broadcast((bucket_bits, frequent))  # two bitmaps of 1 << bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_buckets, own_frequent = sent.value
        out = Counts(bits, least, more)

        def phrases() -> Iterator[pa.RecordBatch]:
            keys, counts = list(out.phrases), list(out.phrases.values())
            out.phrases = {}
            for k in range(0, len(keys), 10_000):
                some = keys[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in some], pa.string()), pa.array([p for _, p in some], pa.string()), pa.array(counts[k : k + 10_000], pa.int64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())],
                    names=["g", "phrase", "n", "block", "counts"],
                )

        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            coded = pc.fill_null(batch.column("g"), "und").dictionary_encode()
            groups, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and size + len(texts[end]) <= CHUNK:
                    size += len(texts[end])
                    end += 1
                count_chunk(texts[begin:end], groups[begin:end], names, length, own_buckets, own_frequent, out)
                begin = end
                if len(out.phrases) >= HELD:
                    yield from phrases()
        yield from phrases()
        if more and out.buckets.any():
            for k in range(0, len(out.buckets), BLOCK):
                block = out.block(k)
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([k // BLOCK], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["g", "phrase", "n", "block", "counts"])

    rows = materialize(docs.mapInArrow(run, "g string, phrase string, n long, block int, counts binary"), f"counted{length}")
    counted = rows.where("block is null").groupBy("g", "phrase").agg(F.sum("n").alias("n"))
    counted = materialize(counted if length == 1 else counted.where(F.col("n") >= least), f"phrases{length}")
    if not more:
        return counted, None, None
    return counted, _bucket_bitmap(rows.where("block is not null").select("block", "counts"), least, bits), _phrase_bitmap(counted.where(F.col("n") >= least), bits)


def _joined(parts: DataFrame, bits: int) -> np.ndarray:
    """One bitmap of (block, set) parts; their number and size are bounded by `bits`, whatever the corpus."""
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(r["set"], np.uint8)
        at = r["block"] * max(1, min(BLOCK, 1 << bits) // 8)
        bitmap[at : at + len(part)] |= part
    return bitmap


def _bucket_bitmap(blocks: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets whose counts over all tasks reach `least`: blocks are added up as they come, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= min(least, 255), bitorder="little").tobytes()], pa.binary())], names=["block", "set"])

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_buffer(), np.uint8)
                if block != now:
                    if now is not None:
                        yield told()
                    now, total = block, np.zeros(len(part), np.int64)
                total += part
        if now is not None:
            yield told()

    parts = blocks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(run, "block int, set binary")
    return _joined(parts, bits)


def _phrase_bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes of phrases (g, phrase), made within partitions and joined by blocks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            rows = [p.split(" ") for p in batch.column(1).to_pylist()]
            h = ~hashes_of(batch.column(0).to_pylist())
            for words in zip(*rows):  # phrases are of one length
                h = _mix(h ^ hashes_of(list(words)))
            at = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
            np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
        step = max(1, min(BLOCK, 1 << bits) // 8)
        for k in range(0, len(bitmap), step):
            if bitmap[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([bitmap[k : k + step].tobytes()], pa.binary())], names=["block", "set"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "set"])
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, np.uint8)
                if block != now:
                    if now is not None:
                        yield told()
                    now, total = block, part.copy()
                else:
                    total |= part
        if now is not None:
            yield told()

    kinds = "block int, set binary"
    return _joined(phrases.select("g", "phrase").mapInArrow(mark, kinds).repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(join, kinds), bits)


def phrase_counts(docs: DataFrame, group: str = "lang", least: int = 30, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((g, words, phrase, n) of all phrases of up to four words with at least `least` occurrences, (g, total) words of each group)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("g"), F.col("text").cast("string").alias("text"))
    tables, bucket_bits, frequent, total = [], None, None, None
    for length in range(1, LONGEST + 1):
        counted, bucket_bits, frequent = _pass(docs, length, least, bits, bucket_bits, frequent)
        if length == 1:
            total = counted.groupBy("g").agg(F.sum("n").alias("total"))
        tables.append(counted.where(F.col("n") >= least).select("g", F.lit(length).alias("words"), "phrase", "n"))
        if length < LONGEST and not (bucket_bits.any() and frequent.any()):
            break  # nothing longer can be frequent
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, total


def mine(docs: DataFrame, group: str = "lang", least: int = 30, share: int = 80, top: int = 2000, salts: int = 16, bits: int = BITS) -> DataFrame:
    """g, rank, phrase, a, l, r, n, score: the `top` phrases of two to four words of each group.

    a: occurrences; l, r: those of the two parts at the cut that scores least; score: floor(2000000 a / (l + r)).
    Phrases within a longer candidate that has at least `share` percent of their occurrences are left out.
    """
    counts, total = phrase_counts(docs, group, least, bits)
    counts = materialize(counts, "counts")
    candidates = counts.where("words > 1").select("g", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    span = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = candidates.select("g", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("g", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left, right = counts.select("g", F.col("phrase").alias("first"), F.col("n").alias("l")), counts.select("g", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products pass 64 bits
    scored = cuts.join(left, ["g", "first"]).join(right, ["g", "rest"]).withColumns({"up": wide("a") * F.lit(2_000_000).cast("decimal(7,0)"), "down": wide("l") + wide("r")}).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("g", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where(F.size("w") > 2).select("g", "w", F.col("a").alias("more"), F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size")).select(
        "g", "w", "more", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at")
    ).select("g", span(F.col("at"), F.col("size")).alias("phrase"), "more").groupBy("g", "phrase").agg(F.max("more").alias("more"))
    kept = best.join(inner, ["g", "phrase"], "left").where(F.col("more").isNull() | (wide("more") * 100 < wide("a") * share))
    kept = kept.select("g", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # at most salts times top rows of a group
    return ranked.join(total, "g").select("g", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
