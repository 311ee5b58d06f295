"""Phrase mining against plain counters over whole texts."""

import re
from collections import Counter

import pytest

from gossamer.llm import collocations, queries

from .conftest import CASES

LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, least, share=80, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(len(words)):
                for size in range(1, min(4, len(words) - k) + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    frequent = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    covered = set()
    for (lang, w), n in frequent.items():
        for size in range(2, len(w)):
            for k in range(len(w) - size + 1):
                part = (lang, w[k : k + size])
                if 100 * n >= share * counts[part]:
                    covered.add(part)
    found = {}
    for (lang, w), a in frequent.items():
        if (lang, w) not in covered:
            score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, totals[lang], -score) for lang, some in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("g", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_over_its_whole_table(spark, sf_dir):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op12_collocations(spark, sf_dir).withColumnRenamed("lang", "g")
    assert rows_of(got) == by_hand(rows, 30) and got.count() > 20


@pytest.mark.parametrize("bits", [6, 12, 20])
def test_shared_bits_change_nothing(spark, sf_dir, bits):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r.text, r.lang) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert rows_of(collocations.mine(docs, least=4, top=300, bits=bits)) == by_hand(rows, 4, top=300)


def test_edges(cases):
    rows = [(t, lang) for _, t, lang, *_ in CASES]
    for least in (1, 2):
        assert rows_of(collocations.mine(cases, least=least, bits=12)) == by_hand(rows, least)


def test_pieces_words_and_ties(spark):
    texts = ["a b c d e", "A B\tC  d e.", "a b; c d: e\x0ba b", "b a!b a?b a", "  ", ".", "x", "a b a b", "é É é É", "a\x00b c\x1cd", "ab c", "a bc", None, "to be or not to be or not to be or not to be"]
    rows = [(t, g) for t in texts for g in ("en", "und", None) for _ in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for least in (3, 5):
        assert rows_of(collocations.mine(docs, least=least, bits=10)) == by_hand(rows, least)
    assert len(rows_of(collocations.mine(docs, least=3, top=2, salts=3, bits=10))) == 4  # en, and und with the nulls


def test_a_word_that_is_everywhere(spark):
    rows = [("the " * 5000, "en")] * 20 + [(f"word{k} other{k}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    assert rows_of(collocations.mine(docs, bits=16)) == by_hand(rows, 30)


def test_no_candidates(nothing, spark):
    assert collocations.mine(nothing, bits=10).collect() == []
    assert collocations.mine(spark.createDataFrame([("a b", "en")], "text string, lang string"), bits=10).collect() == []
