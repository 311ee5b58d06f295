"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Python only tokenises: it gives, for each text, the ids of both tokenizers,
the byte offsets at which their tokens end, and for each offset the number of
tokens that begin before it and the token that covers the byte before it.  All else is Spark's higher-order functions.  The
`array_intersect` of the two end arrays are the offsets where both tokenizers
end a token; they cut the tokens into groups.  The union of the end arrays
cuts the bytes into the ranges that one token of each side covers: each range
is one link.  Links are then counted over the corpus, a document once for
each pair of ids.

The counts of the `hot` most frequent pairs (a bound on rows, 16 bytes each)
are broadcast, so frequent pairs never meet in one task; all other pairs are
joined by a shuffle.

Edges: null and empty texts, and texts that a tokenizer does not give back
byte for byte, have no tokens and zeros everywhere; each row is a document of
its own, whatever its doc_id (null, repeated or equal texts); an empty table
gives no rows; other columns are ignored.  A text's tokens, links and groups
are held by one task at a time, some 110 bytes for each byte of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import materialize, prepare

#: Bytes of texts whose tokens leave a worker together; a longer text leaves alone.
BATCH_BYTES = 1_000_000
SPACE = "▁"
#: Lists of a text, and what stands at offset 0, before which there is no byte.
LISTS, NONE = ("a_ids", "a_ends", "a_of", "a_at", "b_ids", "b_ends", "b_of", "at"), np.zeros(1, np.int32)


class ByteLevel:
    """A byte-level vocabulary: ids of a text, with strings of special tokens as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        """path: a file of base64 tokens and ranks, or a tokenizers file, whose entries spell bytes as printable characters."""
        import tiktoken

        self.size, self.ranks = 0, self._ranks(path)
        self.size = max(self.ranks.values()) + 1
        self.parts = [b""] * self.size
        for token, k in self.ranks.items():
            self.parts[k] = token
        # Contractions, letters, digits and other signs, each with one space before it, and white space: the pattern of this vocabulary's file.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.library = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int]:
        if not path.endswith(".json"):
            with open(path, "rb") as file:
                return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        import json

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"] for x in told.get("added_tokens", [])}
        return {bytes(byte[c] for c in token): k for token, k in told["model"]["vocab"].items() if token not in special}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.library.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]

    def joined(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids)


class Pieces:
    """A sentence-piece vocabulary that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.parts = [self._bytes(k) for k in range(self.size)]

    def _bytes(self, k: int) -> bytes:
        piece = self.library.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(k) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))


_OPEN: dict[str, ByteLevel | Pieces] = {}


def encoder(path: str) -> ByteLevel | Pieces:
    """This worker's encoder of a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = (Pieces if path.endswith(".model") else ByteLevel)(path)
    return _OPEN[path]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def tokens(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id and, for each side, ids, ends (byte offsets in a space and the text) and of (at each offset the id of the token that covers the byte before it; none at 0).

    a_at is the number of A's token that begins at or covers each offset (at the end that of none), at that of both sides' together.
    """
    prepare(docs.sparkSession)

    def side(coder: ByteLevel | Pieces, lengths: np.ndarray, ids: list[int] | np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        if coder.joined(ids) != raw:
            return None
        ids = np.asarray(ids).astype(np.int32)
        size = lengths[ids]
        at = np.repeat(np.arange(len(ids) + 1, dtype=np.int32), np.append(size, 1))
        return ids, np.cumsum(size, dtype=np.int32), np.concatenate((NONE, ids[at[:-1]])), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [encoder(a), encoder(b)]
        lengths = [np.array([len(p) for p in c.parts], np.int32) for c in coders]
        nothing = [np.zeros(0, np.int32)] * len(LISTS)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= BATCH_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                some = [t or "" for t in texts[begin:end]]
                both = [c.encode(some) for c in coders]
                rows = []
                for k, text in enumerate(some):
                    raw = b" " + text.encode()
                    found = [side(c, n, ids[k], raw) for c, n, ids in zip(coders, lengths, both)] if text else [None]
                    rows.append(nothing if None in found else [*found[0], *found[1][:3], found[0][3] + found[1][3]])
                columns = [_lists(list(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), *columns], names=["doc_id", *LISTS])
                begin = end

    lists = ", ".join(f"{c} array<int>" for c in LISTS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {lists}")


def _group(start: Column, end: Column) -> Column:
    """a1,a2|b1 of the bytes from start to end, where tokens of both sides begin and end; mostly one token of each, so two in all."""
    at, a_at = ([F.col(c)[k] for k in (start, end)] for c in ("at", "a_at"))
    b_at = [x - y for x, y in zip(at, a_at)]
    many = lambda ids, x: F.array_join(F.slice(ids, x[0] + 1, x[1] - x[0]).cast("array<string>"), ",")
    one = F.concat(F.col("a_of")[end].cast("string"), F.lit("|"), F.col("b_of")[end].cast("string"))
    return F.when(at[1] - at[0] == 2, one).otherwise(F.concat(many("a_ids", a_at), F.lit("|"), many("b_ids", b_at)))


def align(tokens: DataFrame, b_size: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (text: a1,a2|b1;a3|b2,b3) and links (a's id times b_size plus b's id, in byte order).

    Lambdas use columns of `tokens` and their own variables alone: another column would be computed again at every element.  They
    are interpreted, so what they look up is laid out for few steps.
    """
    bounds = F.concat(F.array(F.lit(0)), F.array_intersect("a_ends", "b_ends"))
    text = lambda c: F.array_join(F.transform(F.slice(c, 2, F.size(c) - 1), lambda end, k: _group(c[k], end)), ";")
    groups = F.transform(F.array(bounds), lambda c: F.struct((F.size(c) - 1).cast("long").alias("n"), text(c).alias("text")))[0]
    ends = F.sort_array(F.array_union("a_ends", "b_ends"))
    number = lambda e: F.col("a_of")[e].cast("long") * F.lit(b_size).cast("long") + F.col("b_of")[e]
    return tokens.select(
        "doc_id", F.size("a_ids").cast("long").alias("n_a"), F.size("b_ids").cast("long").alias("n_b"), groups.alias("groups"), F.transform(ends, number).alias("links"),
    ).select("doc_id", "n_a", "n_b", F.col("groups.n").alias("n_groups"), F.col("groups.text").alias("groups"), "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked, and whether no pair of its a id has more; aligned has links."""
    counts = aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    return counts


def scores(aligned: DataFrame, b_size: int, keep: list[str], hot: int = 200_000) -> DataFrame:
    """The columns `keep` of each row, n_links, n_best (links whose pair's count is the highest of its a id's) and count_sum (over links)."""
    rows = materialize(aligned.select(*keep, "links").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    most = counts.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("count").alias("most"))
    pairs = materialize(counts.withColumn("a", F.expr(f"pair div {b_size}")).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")), "pairs")
    links = rows.select("row", F.explode("links").alias("pair"))
    top = materialize(pairs.orderBy(F.desc("count"), "pair").limit(hot), "hot")
    near = links.join(F.broadcast(top), "pair", "left")
    sums = [F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")]
    found = near.where(F.col("count").isNotNull()).groupBy("row").agg(*sums)
    if pairs.count() > hot:
        rest = near.where(F.col("count").isNull()).groupBy("row", "pair").agg(F.count("*").alias("times")).join(pairs, "pair")
        found = found.unionByName(rest.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = rows.select("row", *keep, F.size("links").cast("long").alias("n_links"))
    return kept.join(found, "row", "left").select(*keep, "n_links", zero("n_best"), zero("count_sum"))
