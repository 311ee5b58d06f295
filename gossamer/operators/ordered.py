"""The choice of a sequential pass over ids, in rounds whose number does not grow with the length of chains.

Nodes are taken in the order of their ids; one is chosen if none of its places
is taken, and then takes them all.  Ids are cut into blocks of `width`
consecutive ones.  A task passes through whole blocks, so a chain costs rounds
only where it goes from block to block.

Where few places are shared by a block and earlier ones (at most NARROW, as in
chains and bands), the pass is made once for all combinations of those places'
states, as bits of one integer.  What a block then says is a table from states
at its entry to states at its exit; tables of FAN consecutive ranges are composed
into one, level by level, and the states found at the top are handed down
again.  That is a pass, 2 log(blocks) / log(FAN) steps over the tables and
another pass, however long a chain is.

Otherwise, as for the lines of an ordered grid, blocks decide what does not
depend on places that earlier blocks may still take.  Each round decides at
least the first block that is left, so their number is at most that of the
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.session import materialize, prepare

#: Ids of a block, unknown states at its entry that are tabulated, ranges that are composed in one step.
WIDTH, NARROW, FAN = 1 << 16, 6, 32


def variable(k: int, unknown: int) -> int:
    """Bits of the k-th of some unknown states over all their combinations."""
    return sum(1 << s for s in range(1 << unknown) if s >> k & 1)


def pass_bits(nodes: list[tuple[int, list]], taken: dict, every: int) -> dict[int, int]:
    """The combinations (bits) in which each node is chosen; `taken` holds those in which a place is, and is brought up to the end."""
    chosen = {}
    for i, places in nodes:
        free = every & ~reduce(int.__or__, (taken.get(k, 0) for k in places), 0)
        chosen[i] = free
        if free:
            for k in places:
                taken[k] = taken.get(k, 0) | free
    return chosen


def pass_known(nodes: list[tuple[int, list]], taken: set, open_places: set) -> tuple[list[int], list[int]]:
    """(chosen, left out) nodes as far as that is known while the places `open_places` may be taken or not."""
    chosen, out = [], []
    for i, places in nodes:
        if any(k in taken for k in places):
            out.append(i)
        elif any(k in open_places for k in places):
            open_places.update(places)  # if this node is chosen, they are taken
        else:
            chosen.append(i)
            taken.update(places)
    return chosen, out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Whole blocks, as lists of their columns, of rows sorted by block and id."""
    held: list[pa.RecordBatch] = []

    def told(batch: pa.RecordBatch) -> tuple[int, dict[str, list]]:
        return batch.column("block")[0].as_py(), {c: batch.column(c).to_pylist() for c in batch.schema.names}

    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield told(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield told(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def nodes_of(rows: dict[str, list]) -> list[tuple[int, list]]:
    out: list[tuple[int, list]] = []
    for i, k in zip(rows["i"], rows["k"]):
        if not out or out[-1][0] != i:
            out.append((i, []))
        out[-1][1].append(k)
    return out


def _laid_out(reach: DataFrame, width: int) -> DataFrame:
    """(block, i, k, lo, hi): the first and last block of the nodes with each place."""
    dealt = reach.select("i", "k", F.floor(F.col("i") / width).cast("long").alias("block"))
    spans = dealt.groupBy("k").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    return dealt.join(spans, "k")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "i")


def _compose(members: pd.DataFrame, first: int, unknown: list, states: dict) -> tuple[dict, list[tuple[int, list]]]:
    """(states at the end, (range, places taken at its entry) where `unknown` is empty) of consecutive ranges' tables, from states as bits over the unknown ones."""
    every = (1 << (1 << len(unknown))) - 1
    entries = []
    for m in members.sort_values("range").itertuples():
        own = [states.get(k, 0) for k in m.entry]
        entries.append((m.range, [k for k, bits in zip(m.entry, own) if bits & 1]))
        cases = [every]
        for bits in own:  # case t: the j-th entry is taken where bit j of t is set
            cases = [c & ~bits for c in cases] + [c & bits for c in cases]
        for k, table in zip(m.exit, m.table):
            table = int.from_bytes(table, "little")
            states[k] = states.get(k, 0) | reduce(int.__or__, (c for t, c in enumerate(cases) if table >> t & 1), 0)
    return states, entries


def _table_rows(number: int, entry: list, entry_lo: list, exits: list[tuple]) -> dict:
    """exits: (place, last block, bits)."""
    return {"range": number, "entry": entry, "entry_lo": entry_lo, "exit": [k for k, _, _ in exits], "exit_hi": [h for _, h, _ in exits], "table": [b.to_bytes((1 << len(entry)) // 8 + 1, "little") for _, _, b in exits], "narrow": True}


def _tables(laid: DataFrame, kind: str) -> DataFrame:
    """A row for each block: its table, or none (not narrow) where too many places are shared with earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches):
            lo, hi = dict(zip(rows["k"], rows["lo"])), dict(zip(rows["k"], rows["hi"]))
            entry = sorted(k for k, b in lo.items() if b < block)
            out = {"range": block, "entry": [], "entry_lo": [], "exit": [], "exit_hi": [], "table": [], "narrow": False}
            if len(entry) <= NARROW:
                taken = {k: variable(n, len(entry)) for n, k in enumerate(entry)}
                pass_bits(nodes_of(rows), taken, (1 << (1 << len(entry))) - 1)
                out = _table_rows(block, entry, [lo[k] for k in entry], [(k, b, taken.get(k, 0)) for k, b in hi.items() if b > block])
            yield pa.RecordBatch.from_pylist([out], schema=arrow)

    arrow, ddl = _schema(kind)
    return _by_block(laid).mapInArrow(run, ddl)


def _schema(kind: str) -> tuple[pa.Schema, str]:
    place = pa.string() if kind == "string" else pa.int64()
    fields = [("range", pa.int64()), ("entry", pa.list_(place)), ("entry_lo", pa.list_(pa.int64())), ("exit", pa.list_(place)), ("exit_hi", pa.list_(pa.int64())), ("table", pa.list_(pa.binary())), ("narrow", pa.bool_())]
    return pa.schema(fields), f"range long, entry array<{kind}>, entry_lo array<long>, exit array<{kind}>, exit_hi array<long>, table array<binary>, narrow boolean"


def _raise(tables: DataFrame, kind: str, size: int) -> DataFrame:
    """Tables of ranges FAN times as long as `size` blocks: consecutive tables composed."""

    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        first, last = number * FAN * size, (number + 1) * FAN * size
        out = {"range": number, "entry": [], "entry_lo": [], "exit": [], "exit_hi": [], "table": [], "narrow": False}
        lo = {k: b for m in members.itertuples() for k, b in zip(m.entry, m.entry_lo) if b < first}
        if members.narrow.all() and len(lo) <= NARROW:
            entry = sorted(lo)
            states, _ = _compose(members, first, entry, {k: variable(n, len(entry)) for n, k in enumerate(entry)})
            hi = {k: b for m in members.itertuples() for k, b in zip(m.exit, m.exit_hi) if b >= last}
            out = _table_rows(number, entry, [lo[k] for k in entry], [(k, b, states.get(k, 0)) for k, b in hi.items()])
        return pd.DataFrame([out])

    return tables.withColumn("above", F.floor(F.col("range") / FAN)).groupBy("above").applyInPandas(run, _schema(kind)[1])


def _lower(tables: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(range, taken): places taken at the entry of each of the tables' ranges; known: the same of the ranges above."""

    def run(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        taken = members["taken"].iloc[0]
        _, entries = _compose(members, 0, [], {k: 1 for k in (taken if taken is not None else [])})
        return pd.DataFrame({"range": [r for r, _ in entries], "taken": [t for _, t in entries]})

    joined = tables.withColumn("above", F.floor(F.col("range") / FAN)).join(known.withColumnRenamed("range", "above"), "above", "left")
    return joined.groupBy("above").applyInPandas(run, f"range long, taken array<{kind}>")


def _decide(laid: DataFrame, known: DataFrame | None) -> DataFrame:
    """(i, chosen) of the nodes that can be decided.  known: (range, taken) of all blocks, or None where places of earlier blocks are open."""
    states_known = known is not None
    if states_known:
        held = known.select(F.col("range").alias("block"), F.explode("taken").alias("k"), F.lit(True).alias("was"))
        laid = laid.join(held, ["block", "k"], "left")
    else:
        laid = laid.withColumn("was", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches):
            taken = {k for k, was in zip(rows["k"], rows["was"]) if was}
            unsure = set() if states_known else {k for k, b in zip(rows["k"], rows["lo"]) if b < block}
            chosen, out = pass_known(nodes_of(rows), taken, unsure)
            yield pa.RecordBatch.from_arrays([pa.array([*chosen, *out], pa.int64()), pa.array([True] * len(chosen) + [False] * len(out), pa.bool_())], names=["i", "chosen"])

    return _by_block(laid).mapInArrow(run, "i long, chosen boolean")


def first_of_all(reach: DataFrame, width: int = WIDTH, counted: list[str] | None = None) -> DataFrame:
    """(i): the nodes that a pass in the order of ids chooses; reach: (i, k), the places k of each node, longs or strings.

    counted: gets the name of each step over all rows or tables, for those who want to know their number.
    """
    prepare(reach.sparkSession)
    kind = {"string": "string"}.get(dict(reach.dtypes)["k"], "long")
    reach = reach.select("i", F.col("k").cast(kind).alias("k"))
    count = counted if counted is not None else []
    chosen: list[DataFrame] = []
    while True:
        laid = materialize(_laid_out(reach, width), "laid")
        count.append("round")
        bounds = laid.agg(F.min("block").alias("low"), F.max("block").alias("high"), F.max(F.col("lo") < F.col("block")).alias("linked")).first()
        if bounds.low is None:
            break
        if bounds.linked:
            known = _states(laid, kind, bounds.high, count)
            found = materialize(_decide(laid, known), "decided")
            chosen.append(found.where("chosen").select("i"))
            if known is not None:
                break
        else:  # no place is shared by blocks
            chosen.append(materialize(_decide(laid, None), "decided").where("chosen").select("i"))
            break
        taken = laid.join(found.where("chosen"), "i", "left_semi").select("k").distinct()
        gone = laid.join(taken, "k", "left_semi").select("i").unionByName(found.select("i")).distinct()
        reach = laid.join(gone, "i", "left_anti").select("i", "k")
    return reduce(DataFrame.unionByName, chosen) if chosen else laid.select("i")


def _states(laid: DataFrame, kind: str, last: int, count: list[str]) -> DataFrame | None:
    """(range, taken) at the entry of all blocks, or None where a range's entry is too wide for tables."""
    levels, size = [materialize(_tables(laid, kind), "tables")], 1
    count.append("tables")
    while True:
        if not levels[-1].where("not narrow").isEmpty():
            return None
        if last // size == 0:
            break
        levels.append(materialize(_raise(levels[-1], kind, size), "tables"))
        count.append("up")
        size *= FAN
    known = levels[-1].select("range", F.col("entry").alias("taken"))  # the top has no entries
    for tables in reversed(levels[:-1]):
        known = materialize(_lower(tables, known, kind), "states")
        count.append("down")
    return known
