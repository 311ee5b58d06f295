"""Features, trees and scores of the additive model against plain definitions."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import quality, queries

from .conftest import CASES

SYMBOLS = {c for c in range(0x21, 0x7F) if not chr(c).isalnum()} - {ord(","), ord(".")}


def upper(c):
    return 0x41 <= c <= 0x5A


def features_by_hand(text):
    words = text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, m, seen = len(text), len(words), Counter(words)
    lines, begin = [], 0
    while begin < n:  # a line has its line end
        end = text.find(b"\n", begin)
        end = n if end < 0 else end + 1
        lines.append(text[begin:end])
        begin = end
    part = lambda line, f: sum(map(f, line)) / len(line)
    symbol = SYMBOLS.__contains__
    count = Counter(text)
    return [
        math.log1p(n), math.log1p(m), sum(map(len, words)) / m, sum(len(w) > 12 for w in words) / m,
        part(text, upper), part(text, lambda c: 0x30 <= c <= 0x39), part(text, symbol), (count[ord(",")] + count[ord(".")]) / m,
        part(text, lambda c: c >= 128), math.log1p(n / len(lines)), len(seen) / m, max(seen.values()) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, sum(symbol(w[-1]) for w in words) / m, sum(upper(w[0]) and upper(w[-1]) for w in words) / m, count[ord("|")] / m,
        max((part(x, symbol) for x in lines if len(x) >= 12), default=0.0), sum(part(x, symbol) > 0.06 for x in lines) / len(lines), sum(part(x, upper) > 0.4 for x in lines) / len(lines), count[ord("!")] / m,
        len(count) / 256, -sum(c / n * math.log2(c / n) for c in count.values()),
    ]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZ09 .,|!#\n\tßé漢"), max_size=80))
def test_features(text):
    assert np.allclose(quality.features_of(text.encode()), features_by_hand(text.encode()), atol=1e-12)


def gain(g, h, ridge):
    return g**2 / (h + ridge)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 9)), min_size=1, max_size=9))
def test_shallow_trees_split_greedily(slopes):
    g, h = np.array(slopes, float).T
    cuts = [0, len(g)]
    for _ in range(2):
        found = []
        for a, b in zip(cuts, cuts[1:]):
            for c in range(a + 1, b):
                more = gain(g[a:c].sum(), h[a:c].sum(), 2.0) + gain(g[c:b].sum(), h[c:b].sum(), 2.0) - gain(g[a:b].sum(), h[a:b].sum(), 2.0)
                found.append((more, c))
        if not found or max(found)[0] <= 1e-9:
            break
        best = max(x for x, _ in found)
        cuts = sorted([*cuts, min(c for x, c in found if x >= best - 1e-12)])
    tree = quality._shallow(g, h, 2.0)
    total = lambda values: sum(gain(g[a:b].sum(), h[a:b].sum(), 2.0) for a, b in values)
    own = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(g)]
    # Each leaf has its value, and the tree takes away as much of the loss as the greedy one (equal gains may be cut elsewhere).
    assert all(np.allclose(tree[a:b], g[a:b].sum() / (h[a:b].sum() + 2.0)) for a, b in zip(cuts, cuts[1:])) or abs(total(zip(own, own[1:])) - total(zip(cuts, cuts[1:]))) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_crossed_trees_cut_both_sides_where_they_gain_most(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
    best = max((sum(gain(g[a, b].sum(), h[a, b].sum(), 2.0) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5))), i, j) for i in range(1, 4) for j in range(1, 5))
    values, got = quality._cross(g, h, 2.0)
    assert got == pytest.approx(best[0] - gain(g.sum(), h.sum(), 2.0))
    for a in (slice(0, best[1]), slice(best[1], 4)):
        for b in (slice(0, best[2]), slice(best[2], 5)):
            assert np.allclose(values[a, b], g[a, b].sum() / (h[a, b].sum() + 2.0))


def score_by_hand(model, x):
    bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
    margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-margin))


def test_query_scores_are_sums_of_table_entries(spark, sf_dir, cases):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op7_quality(spark, sf_dir).collect():
        assert r.score == pytest.approx(score_by_hand(model, features_by_hand(texts[r.doc_id])), abs=1e-9)
    short = sorted((c[0] is not None, c[0] or 0, score_by_hand(model, features_by_hand((c[1] or "").encode()))) for c in CASES)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in quality.score(cases, model).collect())
    assert [x[:2] for x in short] == [x[:2] for x in found] and np.allclose([x[2] for x in short], [x[2] for x in found], atol=1e-9)
