"""Token blocks, packing, media and WARC: exact round trips and brute force."""

import hashlib
import io
import os
import tarfile
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gossamer.llm import media, packing, queries, token_blocks, warc
from gossamer.llm import tokens
from gossamer.llm.tokens import WholeTexts

from .conftest import CASES


@cache
def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("chars", [1, 300, 1_000_000])
def test_texts_in_batches_have_the_ids_of_the_library(monkeypatch, spark, sf_dir, name, chars):
    monkeypatch.setattr(tokens, "BATCH_CHARS", chars)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(20).collect()] + [c[1] for c in CASES if len(c[1] or "") < 10_000]
    ids, sizes = WholeTexts(queries.vocabulary(name)).encode(texts, 7)
    expected = [[*library(name)(t), 7] for t in texts]
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]
    assert WholeTexts(queries.vocabulary(name)).encode([])[0].tolist() == []


def test_a_very_long_word():
    word = "abcdefghij" * 1_000
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        assert WholeTexts(queries.vocabulary(name)).encode([word])[0].tolist() == library(name)(word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.just(2**32 - 1), st.just(0)), min_size=1, max_size=700), st.sampled_from([0.5, 0.9, 0.97, 1.0]))
def test_blocks_round_trip(ids, percentile):
    values = np.array(ids, np.uint32)
    padded = np.concatenate((values, np.full(-len(values) % 128, values[-1])))
    index, words, exceptions = token_blocks.pack(padded, percentile)
    assert np.array_equal(token_blocks.unpack(index, words, exceptions), padded)
    assert (index["n_exceptions"] <= 128 - np.ceil(percentile * 128) + 1e-9).all()


def token_blocks_by_hand(rows):
    encode, start, out = library("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*encode(text), 0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_blocks(spark, sf_dir, cases, nothing):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_blocks(spark, sf_dir).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(got) == token_blocks_by_hand(docs)
    found = token_blocks.read_shards(token_blocks.write_shards(cases, queries.vocabulary("byte_bpe_50k.json"))).collect()
    by_hand = token_blocks_by_hand([(c[0], c[1]) for c in CASES])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((a, n, c) for a, _, n, c in by_hand)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered]])[:-1].tolist()
    assert [r.doc_id for r in ordered] == [a for a, *_ in by_hand]
    assert token_blocks.read_shards(token_blocks.write_shards(nothing, queries.vocabulary("byte_bpe_50k.json"))).count() == 0


def test_reader_reads_any_stretch(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 1_200_000).astype(np.int32)
    with open(tmp_path / "s", "wb") as out:
        writer = token_blocks.ShardWriter(out, 0.97)
        for k in range(0, len(ids), 7001):
            part = ids[k : k + 7001]
            writer.add([k], part, np.array([len(part)]))
        writer.close()
    with token_blocks.source(str(tmp_path / "s")) as file:
        reader = token_blocks.ShardReader(file)
        for a, n in ((0, 10), (127, 2), (1_048_570, 20), (5, 1_199_990), (1_199_999, 1)):
            assert np.array_equal(reader.ids(a, n), ids[a : a + n])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_keeps_all_and_is_even(sizes, n):
    sizes = np.array(sizes)
    part, loads = packing.differencing(sizes, n)
    assert len(part) == len(sizes) and part.min() >= 0 and part.max() < n
    assert np.bincount(part, weights=sizes, minlength=n).astype(int).tolist() == loads.tolist()
    assert loads.max() - loads.min() <= sizes.max()
    _, windows = packing.windows(sizes, 1000)
    assert windows.max() <= 1000 and windows.sum() == sizes.sum()


def check_packing(pieces, rows, capacity=4096):
    encode = library("word_bpe_49k.json")
    left = Counter((d, len(e), crc(e)) for d, t in rows for e in [[*encode(t), 2]])
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length, p.padded_length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    for own in by_sequence.values():
        own.sort()
        total = 0
        for offset, length, _ in own:
            assert offset == total
            total += length
        assert total <= capacity and own[0][2] == (total if total & (total - 1) == 0 else capacity)
    found = Counter()
    for (doc_id, n), own in by_doc.items():
        starts = Counter(s for s, _ in own)
        copies = starts[0]
        if copies == 1:
            ids = [i for _, x in sorted(own) for i in x]
            found[doc_id, n, crc(ids)] += 1
        else:  # repeated rows: each start as often
            assert set(starts.values()) == {copies}
            ids = [i for s in sorted(starts) for i in next(x for t, x in own if t == s)]
            found[doc_id, n, crc(ids)] += copies
    assert found == left
    return by_sequence


def test_many_empty_texts_and_a_giant_one_stay_small():
    """Memory follows the pieces, not pieces times windows."""
    import tracemalloc

    for sizes in (np.ones(20_000, np.int64), np.full(4_000, 1000)):
        tracemalloc.start()
        part, loads = packing.windows(sizes, 4096)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1000 * len(sizes)
        assert np.bincount(part, weights=sizes).astype(int).tolist() == loads.tolist() and loads.max() <= 4096


def test_blocks_end_within_documents(spark):
    rows = [(k, "one two three " * (40 if k % 7 else 3000)) for k in range(60)] + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check_packing(packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), block=3, block_pieces=50).collect(), rows)


def test_packing(spark, sf_dir, cases, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sequences = check_packing(packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    filled = sum(n for s in sequences.values() for _, n, _ in s)
    assert sum(s[0][2] for s in sequences.values()) < 1.05 * filled
    check_packing(packing.pack(cases, queries.vocabulary("word_bpe_49k.json")).collect(), [(c[0], c[1]) for c in CASES])
    assert packing.pack(nothing, queries.vocabulary("word_bpe_49k.json")).count() == 0
    assert "ids_crc32" in queries.op5_packing(spark, sf_dir).columns


def test_media(spark, sf_dir, cases, nothing):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_media(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        stored = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest(), len(stored))
    found = media.media_columns(cases).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes) for r in found) == Counter((c[0], len((c[1] or "").encode()), len(media.payload_of((c[1] or "").encode()))) for c in CASES)
    assert len({(r.shard, r.offset) for r in found}) == len({media.payload_of((c[1] or "").encode()) for c in CASES})  # stored once
    for r in found:
        assert hashlib.sha256(media.decode_png(media.member(r.shard, r.offset, r.length))).hexdigest() == r.digest
        assert f"{r.digest}.png" in media.members(r.shard) and (r.width, r.depth) == (64, 8)
    assert media.media_columns(nothing).count() == 0
    # One stored copy for each payload over all shards, and no other shard is left.
    shards = {r.shard for r in found}
    folder = next(iter(shards)).rsplit("/", 1)[0].removeprefix("file:")
    assert {f for f in os.listdir("/" + folder.lstrip("/"))} == {s.rsplit("/", 1)[1] for s in shards}
    assert Counter(n for s in shards for n in media.members(s)) == Counter({f"{r.digest}.png" for r in found})


def test_media_shards_are_tar_files():
    info = tarfile.TarInfo("a.png")
    info.size = 3
    raw = info.tobuf(tarfile.USTAR_FORMAT) + b"abc" + bytes(509) + bytes(1024)
    assert tarfile.open(fileobj=io.BytesIO(raw)).extractfile("a.png").read() == b"abc"


PAGES = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (7, "http://a/7", "x" * 1000), (7, "http://a/7", "x" * 1000), (None, "http://a", "x" * 1000),
    (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999), (5, None, None), (6, "http://a/\r\nInjected: 1", ""), (8, "", "é" * 500), (9, "u", "é" * 500), (10, "long", "WARC/1.1\r\n\r\n" * 300_000),
]


def warc_by_hand(rows):
    newest = {}
    for page_id, _, html in rows:
        newest[html or ""] = max(newest.get(html or "", -(2**63)), -(2**63) if page_id is None else page_id)
    out = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and newest[html or ""] != page_id and sum((h or "") == (html or "") for _, _, h in rows) > 1
        out[page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", newest[html or ""] if again else None] += 1
    return out


def test_warc(spark, sf_dir):
    fields = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert Counter(map(fields, queries.op3_warc(spark, sf_dir).collect())) == warc_by_hand(pages)
    from pyspark.sql import functions as F

    made = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2).withColumns({"digest": F.lit(1), "n": F.lit(2), "newest": F.lit(3)})
    archives = warc.normalise(warc.write_archives(made))
    rows = warc.read_records(archives).collect()
    assert Counter(map(fields, rows)) == warc_by_hand(PAGES)
    assert Counter((r.page_id, bytes(r.block)) for r in rows if r.record_type == "response") == Counter((p, (h or "").encode()) for p, _, h in PAGES if (p not in (1, 2, None, 8)))
    assert warc.read_records(warc.normalise(warc.write_archives(made.limit(0)))).count() == 0


def test_normaliser_reads_whole_file_and_many_members():
    import gzip

    whole = [warc.record(k, f"http://{k}", bytes([65 + k]) * (k * 1000), "0" * 40, "response", None) for k in range(5)]
    for packed in (gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        got = [w for _, _, w in warc.records(warc._inflated(io.BytesIO(packed)))]
        assert got == whole


def test_cut_archives_are_errors():
    """Without its trailer, cut at a flush point, cut anywhere, or with a second member cut: never a shorter list of records."""
    import gzip

    whole = [warc.record(k, f"http://{k}", bytes([65 + k]) * 3000, "0" * 40, "response", None) for k in range(3)]
    pack, flushed = zlib.compressobj(6, zlib.DEFLATED, 31), b""
    for w in whole[:2]:
        flushed += pack.compress(w) + pack.flush(zlib.Z_FULL_FLUSH)
    packed = gzip.compress(b"".join(whole))
    for bad in (packed[:-8], packed[:-1], packed[:40], packed[:10], flushed, packed + packed[:-8], packed + packed[:5], packed[:-8] + bytes(8)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(warc._inflated(io.BytesIO(bad))))


def test_replayable_tables(spark, sf_dir, cases):
    """Scans stay as they are, anything else is written; notes reach the rows that they are about."""
    from gossamer.llm import shared
    from pyspark.sql import functions as F

    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text")
    assert shared.replayable(scan) is scan and shared.replayable(cases) is not cases and shared.replayable(scan.withColumn("r", F.rand())) is not scan
    for df in (scan, shared.replayable(cases.select("doc_id", "text"))):
        uri = shared.notes(df.select(shared.row_number().alias("row"), F.xxhash64("text").alias("hash"), "doc_id").where("doc_id > 3"))

        def check(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            said = shared.Notes(uri, TaskContext.get().partitionId())
            for b in batches:
                at, about = said.upto(b.num_rows)
                want = [k for k, d in enumerate(b.column("doc_id").to_pylist()) if d is not None and d > 3]
                ok = at.tolist() == want and (not want or about["doc_id"].to_pylist() == [b.column("doc_id")[k].as_py() for k in want])
                yield pa.RecordBatch.from_pydict({"ok": [ok], "n": [len(want)]})

        got = df.mapInArrow(check, "ok boolean, n long").collect()
        assert all(r.ok for r in got) and sum(r.n for r in got) == df.where("doc_id > 3").count()
