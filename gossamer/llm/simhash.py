"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: words are separated by ASCII white space, three-word shingles
(repeats included) are hashed by XXH64 with seed 42, and a fingerprint bit is
1 if it is set in over half of the hashes.

Links: two fingerprints that differ in at most r bits agree on at least two
of r + 2 bands (r differing bits spoil at most r bands), so the distinct
fingerprints meet in the buckets of all C(r + 2, 2) pairs of bands.  Within a
bucket their bit planes lie side by side; the planes that differ from a
probe are added up in carry-save counters for 64 members at once, and such a
block is left as soon as the counters of all its members have passed r.  Small
buckets lie side by side in the same planes, each member against its own
bucket's probe.  A bucket above `chunk` members is dealt out as pairs of
chunks, so no task gathers it.  Each
task emits the edges of a spanning forest of its links, never all pairs;
label propagation with pointer jumping joins the forests.

Edges: null, empty and word-less texts have fingerprint zero and are linked
like any other; fewer than three words are one shingle; equal fingerprints
link; null doc_ids are kept (a component of nulls alone has a null id);
repeated rows are kept; an empty table gives no rows; clashing names of other
columns do no harm, as those are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import Notes, materialize, notes, prepare, replayable, row_number, texts_of

BITS = 64
#: Buckets of at most so many members lie side by side.
SMALL = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and space or \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(raw), 1 << 15):
        bits = np.unpackbits(raw[k : k + (1 << 15)], axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(raw), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns `keep` (doc_id) and fingerprint (the same 64 bits as a signed long) of each row."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], names=[*keep, "fingerprint"])

    prepare(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{kinds}, fingerprint long")


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bands that share out the 64 bits."""
    n = radius + 2
    bounds = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: bit i of value k is bit k of plane i; 64 x ceil(n / 64) words."""
    n = len(values)
    padded = np.zeros(-(-n // 64) * 64, "<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_blocks(differ: Callable[[int, np.ndarray], np.ndarray], n: int, radius: int) -> np.ndarray:
    """For each of n blocks of 64 pairs a word with a 1 for each pair that differs in at most `radius` planes.

    differ(bit, blocks) gives the words of pairs that differ in a plane.  Carry-save counters of as many bits as the radius needs,
    and a sticky overflow, hold 64 distances in a few words; a block is left once all of its pairs have passed the radius.
    """
    depth = max(1, radius.bit_length())  # the counters hold up to 2^depth - 1 >= radius
    out, alive, every = np.zeros(n, np.uint64), np.arange(n), ~np.uint64(0)
    counters, over = np.zeros((depth, n), np.uint64), np.zeros(n, np.uint64)
    for bit in range(BITS):
        carry = differ(bit, alive)
        for c in counters:
            c ^= carry
            carry = carry & ~c
        over |= carry
        if bit >= 7 and bit % 4 == 3:
            left = _passed(counters, over, radius) != every
            if not left.all():
                alive, counters, over = alive[left], counters[:, left], over[left]
                if not len(alive):
                    return out
    out[alive] = ~_passed(counters, over, radius)
    return out


def within(planes: np.ndarray, probes: np.ndarray, radius: int) -> np.ndarray:
    """For each probe, a bit for each member: 1 if they differ in at most `radius` bits."""
    width = planes.shape[1]

    def differ(bit: int, blocks: np.ndarray) -> np.ndarray:
        probe = np.uint64(0) - (probes >> np.uint64(bit) & np.uint64(1))
        return planes[bit][blocks % width] ^ probe[blocks // width]

    return near_blocks(differ, len(probes) * width, radius).reshape(len(probes), width)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Whether left[k] and right[k] differ in at most `radius` bits."""
    a, b = planes_of(left), planes_of(right)
    words = near_blocks(lambda bit, blocks: a[bit][blocks] ^ b[bit][blocks], a.shape[1], radius)
    return np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little", count=len(left)).astype(bool)


def _passed(counters: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """1 where the counter is above the radius."""
    if radius == 0:
        return over | counters[0]
    above, equal = over.copy(), ~np.uint64(0)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above |= equal & counters[k]
            equal = equal & ~counters[k]
    return above


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges (values) of a spanning forest of the links within `left`, or between `left` and `right`."""
    if right is not None and not (len(left) and len(right)):
        return []
    values = left if right is None else np.concatenate((left, right))
    members, base = (left, 0) if right is None else (right, len(left))
    tree, edges, planes = np.arange(len(values)), [], planes_of(members)
    step = max(1, (1 << 20) // (planes.shape[1] * 8))
    for k in range(0, len(left), step):
        hits = within(planes, left[k : k + step], radius)
        bits = np.unpackbits(np.ascontiguousarray(hits.astype("<u8")).view(np.uint8), axis=1, bitorder="little", count=len(members))
        for probe in np.flatnonzero(bits.any(axis=1)).tolist():
            near = np.flatnonzero(bits[probe]) + base
            trees, first = np.unique(tree[near], return_index=True)
            other = trees != tree[probe + k]
            if other.any():
                edges += [(int(values[probe + k]), int(values[near[x]])) for x in first[other].tolist()]
                tree[np.isin(tree, trees[other])] = tree[probe + k]
    return edges


def linked_groups(values: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each of many small groups; group g is values[starts[g]:starts[g + 1]].

    In the k-th step every group's members after its k-th are compared with that one, all groups at once.
    """
    sizes = np.diff(np.append(starts, len(values)))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    place, tree = np.arange(len(values)) - first, np.arange(len(values))
    edges = [(values[:0], values[:0])]
    for k in range(int(sizes.max(initial=1)) - 1):
        member = np.flatnonzero((place > k) & (size > k + 1))
        probe = first[member] + k
        near = near_pairs(values[member], values[probe], radius)
        near &= tree[member] != tree[probe]
        member, probe = member[near], probe[near]
        trees, one = np.unique(tree[member], return_index=True)
        if len(one):
            edges.append((values[probe[one]], values[member[one]]))
            to = np.arange(len(values))
            to[trees] = tree[probe[one]]
            tree = to[tree]
    return np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges])


def links(values: DataFrame, radius: int = 3, chunk: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all distinct longs of column `fingerprint` at most `radius` bits apart, by way of each other.

    A bucket is a pair of bands' bits.  Buckets above `chunk` members are dealt out as pairs of chunks.
    """
    shares = bands(radius)

    def key(i: int, j: int):
        (a, wa), (b, wb) = shares[i], shares[j]
        low = F.shiftrightunsigned("fingerprint", a).bitwiseAND((1 << wa) - 1)
        high = F.shiftrightunsigned("fingerprint", b).bitwiseAND((1 << wb) - 1)
        return F.shiftleft(high, wa).bitwiseOR(low).cast("long")

    pairs = list(combinations(range(len(shares)), 2))
    entries = values.select("fingerprint", F.posexplode(F.array(*[key(i, j) for i, j in pairs])).alias("band", "bucket"))
    sizes = entries.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Members of buckets of one have no partner there.  The chunk comes from a hash, so each row finds its own.
    members = entries.join(sizes, ["band", "bucket"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("chunks")).cast("int")
    dealt = members.withColumn("mine", mine).select(
        "fingerprint", "band", "bucket", "mine",
        F.explode(F.expr("transform(sequence(0, chunks - 1), x -> named_struct('first', least(x, mine), 'second', greatest(x, mine)))")).alias("at"),
    )
    grouped = dealt.select("band", "bucket", F.col("at.first").alias("first"), F.col("at.second").alias("second"), F.col("mine"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        for last, batch in _with_last(batches):
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            rows = rows if rest is None else np.concatenate((rest, rows))
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([len(rows)] if last else [])]
            size, head = np.diff(bounds), rows[bounds[:-1]]
            small = (size > 1) & (size <= SMALL) & (head[:, 2] == head[:, 3])
            chosen = np.repeat(small, size)
            some = size[small]
            left, right = linked_groups(rows[: bounds[-1]][chosen, 5].astype(np.uint64), np.cumsum(some) - some, radius)
            edges = []
            for g in np.flatnonzero((size > 1) & ~small).tolist():
                group = rows[bounds[g] : bounds[g + 1]]
                mine = group[:, 4] == group[0, 2]
                edges += linked(group[mine, 5].astype(np.uint64), None if group[0, 2] == group[0, 3] else group[~mine, 5].astype(np.uint64), radius)
            more = np.array(edges, np.uint64).reshape(-1, 2)
            rest = rows[bounds[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in ((left, more[:, 0]), (right, more[:, 1]))], names=["a", "b"])

    prepare(values.sparkSession)
    keys = ["band", "bucket", "first", "second"]
    return grouped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _with_last(batches: Iterator) -> Iterator[tuple[bool, object]]:
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest `least` of the nodes reachable by edges (a, b).  nodes: node, least.

    Each round takes the smallest label of the neighbours, then the label of the label's own node (pointer jumping);
    written tables between rounds keep the lineage short.  The label travels with the node that owns it.
    """
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(nodes.select("node", F.struct("least", F.col("node").alias("owner")).alias("label")).join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "labels")
    alone = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.col("least").alias("label"))
    while True:
        heard = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("heard"))
        step = labels.join(heard.withColumnRenamed("b", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        step = materialize(step, "labels")
        if step.where("label.owner <> old.owner").isEmpty():
            return alone.union(step.select("node", "label.least"))
        owners = step.select(F.col("node").alias("owner"), F.col("label").alias("further"))
        jumped = step.withColumn("owner", F.col("label.owner")).join(owners, "owner", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        labels = materialize(jumped, "labels")


def _grouped(rows: DataFrame, least: Column, radius: int, chunk: int) -> DataFrame:
    """(fingerprint, label): the smallest `least` of the rows in each distinct fingerprint's component."""
    nodes = materialize(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min(least).alias("least")), "nodes")
    found = components(nodes, links(nodes.select(F.col("node").alias("fingerprint")), radius, chunk))
    return materialize(found.select(F.col("node").alias("fingerprint"), "label"), "components")


def near_duplicates(docs: DataFrame, radius: int = 3, chunk: int = 2048) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id reachable by links) of each row."""
    rows = materialize(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "fingerprints")
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))  # nulls come last
    found = _grouped(rows, least, radius, chunk)
    return rows.join(found, "fingerprint", "left").select("doc_id", "fingerprint", F.col("label.id").alias("component_id"))


def deduplicate(docs: DataFrame, radius: int = 3, chunk: int = 2048) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (of equal ids, of the smallest hash of the text, then the first row); nulls come last.

    Fingerprints and row numbers alone are shuffled; the rows that stay are noted for the tasks that meet them again.
    """
    docs = replayable(docs)
    mark = "_" * (max(map(len, docs.columns)) + 1)  # no column's name
    keyed = docs.select(row_number().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    rows = materialize(fingerprints(keyed, ["row", "doc_id", "hash"]), "fingerprints")
    least = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "hash", "row")
    stay = notes(_grouped(rows, least, radius, chunk).select("label.row", "label.hash").distinct())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        said = Notes(stay, TaskContext.get().partitionId())
        for batch in batches:
            at, about = said.upto(batch.num_rows)
            if len(at) and not np.array_equal(batch.column(batch.num_columns - 1).to_numpy()[at], about["hash"].to_numpy()):
                raise ValueError("the table changed between two jobs")
            yield batch.take(pa.array(at)).drop_columns([mark])

    return docs.select("*", F.xxhash64("text").alias(mark)).mapInArrow(keep, docs.schema)
