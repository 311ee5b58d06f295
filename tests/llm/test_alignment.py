"""Cross-tokenizer alignment against plain loops over bytes, with the libraries called one text at a time."""

import hashlib
from collections import Counter
from functools import cache

import public_tokenizers
import pytest

from gossamer.llm import alignment, queries

from .conftest import CASES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_tokens(text):
    """(id, bytes) by the tokenizers library, which spells tokens as printable characters."""
    library = libraries()[0]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found = library.encode(text, add_special_tokens=False)
    return [(k, bytes(of[c] for c in t)) for k, t in zip(found.ids, found.tokens)]


def piece_tokens(text):
    library, out = libraries()[1], []
    for k in library.encode(text):
        piece = library.id_to_piece(k)
        out.append((k, bytes([int(piece[1:-1], 16)]) if library.is_byte(k) else piece.replace("▁", " ").encode()))
    return out


def by_hand(rows):
    kept, count = [], Counter()
    for doc_id, text in rows:
        a, b = (byte_tokens(" " + text), piece_tokens(text)) if text else ([], [])
        raw = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            kept.append((doc_id, 0, 0, [], []))
            continue
        at_a = [k for k, (_, x) in enumerate(a) for _ in x]
        at_b = [k for k, (_, x) in enumerate(b) for _ in x]
        groups, left, right = [], [], []
        for p in range(len(raw)):
            ends = [p + 1 == len(raw) or at[p + 1] != at[p] for at in (at_a, at_b)]
            if ends[0]:
                left.append(str(a[at_a[p]][0]))
            if ends[1]:
                right.append(str(b[at_b[p]][0]))
            if all(ends):
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
        links = [(a[i][0], b[j][0]) for i, j in sorted(set(zip(at_a, at_b)))]
        count.update(set(links))
        kept.append((doc_id, len(a), len(b), groups, links))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [
        (d, n_a, n_b, len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for d, n_a, n_b, g, links in kept
    ]


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def run(docs, hot=200_000):
    from pyspark.sql import functions as F

    size = alignment.encoder(B).size
    aligned = alignment.align(alignment.tokens(docs, A, B), size).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    return alignment.scores(aligned, size, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"], hot)


def test_query_over_its_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op13_alignment(spark, sf_dir)) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("hot", [200_000, 5])
def test_edges(cases, hot):
    assert rows_of(run(cases, hot)) == sorted(by_hand([(d, t) for d, t, *_ in CASES]), key=str)


def test_texts_of_few_and_odd_bytes(spark):
    texts = ["!", "!!", "! !", " ", "  two  spaces", "▁", "tab\tand\nline", "a\u0000b", "\U0001f600 ok", "é", "<s> </s> <0x41> <unk>", "ﬁ ligature", "<|endoftext|>", "ha" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(run(docs)) == sorted(by_hand(list(enumerate(texts))), key=str)


def test_nothing(nothing):
    assert run(nothing).collect() == []


def test_vocabulary_files_agree():
    """The same vocabulary as ranks and as spelled entries."""
    assert alignment.encoder(A).parts == alignment.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).parts


def test_lists_by_offset(spark):
    """At each offset the token that covers the byte before it, and how many tokens begin before it: groups of one token a side are told by one difference."""
    row = alignment.tokens(spark.createDataFrame([(1, "Hello worlds, xyzzy")], "doc_id long, text string"), A, B).first()
    for ids, ends, of in ((row.a_ids, row.a_ends, row.a_of), (row.b_ids, row.b_ends, row.b_of)):
        starts = [0, *ends[:-1]]
        assert of[1:] == [k for k, a, b in zip(ids, starts, ends) for _ in range(a, b)]
    begun = lambda ends, at: sum(e <= at for e in ends)
    assert row.at == [begun(row.a_ends, k) + begun(row.b_ends, k) for k in range(row.a_ends[-1] + 1)]
