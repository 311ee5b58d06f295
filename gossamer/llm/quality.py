"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins.  Shallow trees are boosted
cyclically, one feature at a time, on the logistic loss; the sum of a
feature's trees is a lookup table over its bins.  Then the pairs whose coarse
grids explain most of what is left are boosted the same way, each by trees
that split once along each of their two features.  A score is the logistic
function of an intercept and one table entry for each feature and pair.

Labels are learned from a bounded sample (`sample` rows, those with the
smallest hash of doc_id); all else covers all rows.  No label, lang, source or
doc_id is an input of a score.

Edges: null and empty texts have features of zeros and get a score; null
doc_ids are scored and never learned from, nor are null labels; a doc_id
with several labels or texts counts with the mean of its labels at each text;
repeated rows are scored each; without usable labels the score is 0.5; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import prepare, texts_of

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "symbol", "comma_stop", "non_ascii", "line_length",
    "distinct_words", "top_word", "repeats_before", "word_ends_symbol", "upper_words", "bar", "worst_line_symbol", "symbol_lines", "upper_lines", "exclamation", "distinct_bytes", "byte_entropy",
)
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[0x21:0x30] = _SYMBOL[0x3A:0x41] = _SYMBOL[0x5B:0x61] = _SYMBOL[0x7B:0x7F] = True
_SYMBOL[[0x2C, 0x2E]] = False


def features_of(text: bytes) -> list[float]:
    """FEATURES of a UTF-8 text."""
    raw, words = np.frombuffer(text, np.uint8), text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(raw), len(words)
    counts = np.bincount(raw, minlength=256)
    lengths = np.fromiter(map(len, words), np.int32, m)
    seen = Counter(words)
    share = counts[counts > 0] / n
    lines = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    lines = lines[lines < n]
    size = np.diff(np.concatenate((lines, [n])))
    symbols, uppers = _SYMBOL[raw], _UPPER[raw]
    line_symbols = np.add.reduceat(symbols, lines, dtype=np.int32) / size
    line_uppers = np.add.reduceat(uppers, lines, dtype=np.int32) / size
    symbol_bytes = int(symbols.sum())
    ends = np.fromiter((w[-1] for w in words), np.uint8, m)
    starts = np.fromiter((w[0] for w in words), np.uint8, m)
    longest = size >= 12
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float((lengths > 12).mean()),
        int(uppers.sum()) / n, int(counts[0x30:0x3A].sum()) / n, symbol_bytes / n, int(counts[0x2C] + counts[0x2E]) / m,
        int(counts[128:].sum()) / n, float(np.log1p(n / len(lines))), len(seen) / m, max(seen.values()) / m,
        sum(map(eq, words, words[1:])) / m, float(_SYMBOL[ends].mean()), float((_UPPER[starts] & _UPPER[ends]).mean()), int(counts[0x7C]) / m,
        float(line_symbols[longest].max()) if longest.any() else 0.0, float((line_symbols > 0.06).mean()), float((line_uppers > 0.4).mean()), int(counts[0x21]) / m,
        len(share) / 256, float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables: edges of each feature's bins, a table for each feature, and (i, j, coarse table) for each pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions, then the logistic function."""
        b = self.bins(x)
        margin = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            margin += table[b[:, k]]
        for i, j, table in self.pairs:
            margin += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Values over the bins of the tree that splits greedily up to `leaves` leaves."""
    cuts, values = [0, len(g)], np.zeros(len(g))
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                inner = np.arange(a + 1, b)
                got = gain(a, inner) + gain(inner, b) - gain(a, b)
                k = int(got.argmax())
                if got[k] > best:
                    best, at = got[k], int(inner[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    for a, b in zip(cuts, cuts[1:]):
        values[a:b] = _leaf(G[b] - G[a], H[b] - H[a], ridge)
    return values


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """(values over a grid, gain) of the best tree with one cut along each side."""
    G, H = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    score = 0.0
    quarters = []
    for G4, H4 in zip(_quarters(G), _quarters(H)):
        quarters.append(_leaf(G4, H4, ridge))
        score = score + G4**2 / (H4 + ridge)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    values = np.zeros(g.shape)
    for q, (a, b) in zip(quarters, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        values[a, b] = q[i, j]
    return values, float(score[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + ridge))


def _quarters(c: np.ndarray) -> tuple[np.ndarray, ...]:
    low = c[1:-1, 1:-1]
    return low, c[1:-1, -1:] - low, c[-1:, 1:-1] - low, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + low


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 80, rate: float = 0.15, n_pairs: int = 12, pair_rounds: int = 40, grid: int = 8, ridge: float = 2.0) -> AdditiveModel:
    """Learns the tables from features x and labels y in [0, 1]."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(k)] if n else [np.zeros(0)] * k
    sizes = [len(e) + 1 for e in edges]
    coarse = [np.minimum(np.arange(s) * grid // max(1, s), grid - 1) for s in sizes]
    mean = float(np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4))
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, [np.zeros(s) for s in sizes], coarse, [])
    if not n:
        return model
    b = model.bins(x)
    margin = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            tree = rate * _shallow(np.bincount(b[:, f], g, sizes[f]), np.bincount(b[:, f], h, sizes[f]), ridge)
            model.tables[f] += tree
            margin += tree[b[:, f]]
    g, h = slopes()
    cells = {}
    for i in range(k):
        for j in range(i + 1, k):
            cell = coarse[i][b[:, i]] * grid + coarse[j][b[:, j]]
            cells[i, j] = _cross(np.bincount(cell, g, grid * grid).reshape(grid, grid), np.bincount(cell, h, grid * grid).reshape(grid, grid), ridge)[1]
    chosen = sorted(cells, key=cells.get, reverse=True)[:n_pairs]
    tables = {p: np.zeros((grid, grid)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            cell = coarse[i][b[:, i]] * grid + coarse[j][b[:, j]]
            tree = rate * _cross(np.bincount(cell, g, grid * grid).reshape(grid, grid), np.bincount(cell, h, grid * grid).reshape(grid, grid), ridge)[0]
            tables[i, j] += tree
            margin += tree.ravel()[cell]
    model.pairs = [(i, j, tables[i, j]) for i, j in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 12_000) -> AdditiveModel:
    """The model of `target`, from at most `sample` labelled rows that are not held out."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(target).cast("double")).alias("label"))
    # At most `sample` ids and labels, 16 bytes each, are sent out.
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id").groupBy("doc_id", "text").agg(F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features_of(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = rows.mapInArrow(run, "doc_id long, label double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", F.col("x").cast("string")).limit(sample).toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["label"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) and score (0 to 1) of each row."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features_of(t) for t in texts_of(batch.column(batch.num_columns - 1))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{kinds}, score double")
