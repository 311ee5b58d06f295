"""Packing of texts of equal lengths, and url rules in many files of key ranges."""

import numpy as np
import pytest
import xxhash

from gossamer.llm import packing, url_filter
from gossamer.llm.queries import vocabulary


@pytest.mark.parametrize("size", [1366, 683, 2049, 1500, 1025, 820, 4097, 5000, 586, 3000])
def test_equal_lengths_are_recut(size):
    """Pieces that miss the capacity by a few tokens are cut further; each token keeps its one place."""
    lengths = packing.cut(np.full(400, size), 1024)[2]
    piece, short, part, loads = packing.fitted(lengths, 4096)
    assert np.array_equal(np.bincount(piece, short), lengths) and (short > 0).all() and (np.diff(piece) >= 0).all()
    assert np.array_equal(np.bincount(part, short, len(loads)), loads) and loads.max() <= 4096
    assert len(loads) * 4096 <= 1.02 * lengths.sum() + 4096


def test_pieces_that_fit_stay_whole():
    sizes = np.random.default_rng(0).integers(1, 1025, 700)
    piece, short, _, loads = packing.fitted(sizes, 4096)
    assert np.array_equal(short, sizes) and len(loads) == -(-int(sizes.sum()) // 4096)


def test_equal_texts_pack_with_little_padding(spark):
    """Whole texts of one length through the operator: ids in order, no gaps, at most 2 % padding."""
    from gossamer.llm.tokens import tokenizer

    path = vocabulary("word_bpe_49k.json")
    text = " ".join(["word"] * 1365)
    docs = spark.createDataFrame([(k, text) for k in range(400)], "doc_id long, text string").repartition(1)
    rows = packing.pack(docs, path).collect()
    ids, sizes = tokenizer(path).encode([text], 2)
    assert sizes[0] == 1366
    for k in (0, 7, 399):
        own = sorted((r.start, r.length, r.ids) for r in rows if r.doc_id == k)
        assert b"".join(x for _, _, x in own) == ids.astype("<u4").tobytes()
        assert [s for s, _, _ in own] == [0, *np.cumsum([n for _, n, _ in own])[:-1].tolist()]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    for some in places.values():
        some.sort()
        assert [o for o, _, _ in some] == [0, *np.cumsum([n for _, n, _ in some])[:-1].tolist()] and sum(n for _, n, _ in some) <= some[0][2]
    assert sum(some[0][2] for some in places.values()) <= 1.02 * 400 * 1366


@pytest.mark.parametrize("files", [1, 7, 50])
def test_rules_in_ranges_of_keys(spark, files):
    """No two files share keys, and a candidate is probed only in the file of its key."""
    rules = [(f"h{k}.example.org", f"/{k % 9}/", ("allow", "block")[k % 2]) for k in range(600)] + [("com", "", "block")]
    uri = url_filter.build(spark, spark.createDataFrame(rules, "host string, path string, verdict string"), files)
    arrays = url_filter.DigestArrays(uri)
    assert len(arrays.arrays) == files or files == 50 and len(arrays.arrays) > 40
    keys = np.concatenate([a.keys for a in arrays.arrays])
    assert np.array_equal(keys, np.unique(keys)) and len(keys) == len(rules)
    assert set(keys.tolist()) == {xxhash.xxh64_intdigest(h.encode() + b"\0" + p.encode(), 42) for h, p, _ in rules}
    met = []
    for a in arrays.arrays:
        probe = a.probe
        a.probe = lambda wanted, some, *rest, a=a, probe=probe: (met.append(len(some)), np.testing.assert_array_equal((wanted[some] >= a.keys[0]) & (wanted[some] <= a.keys[-1]), True), probe(wanted, some, *rest))
    urls = [f"http://h{k}.example.org/{k % 9}/x" for k in range(0, 600, 50)] + ["http://www.x.com/", "http://h1.example.org/2/", None, "nothing"]
    got = url_filter.judge(arrays, urls)
    assert [v for _, _, _, v in got] == [("allow", "block")[k % 2] for k in range(0, 600, 50)] + ["block", None, None, None]
    assert len(met) <= min(files, 600)
