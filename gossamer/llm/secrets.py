"""Secret scans: three patterns, and a battery of randomness tests.

Patterns (places are code points, ends exclusive): `assign`, a secret-like
name, a separator and a value of 12 characters or more; `access`, access key
ids; `hex`, long runs of lower-case hexadecimal digits.

Battery: each maximal token of 20 or more base64-like characters is given the
encoding of the smallest alphabet that holds it (ENCODINGS), but for one
separator in twelve characters; none is left out beforehand.  Its null hypothesis is an ordinary token: words run together, with
capitals, numbers, separators or slashes between them.  Four statistics are
compared with what such tokens of that length and encoding give: chi-squared
over the alphabet, the surprise of the letters under language's shares, the number of runs of character class
(in letters of one case: of vowels and others), and the serial correlation of
neighbouring symbols.  Their z scores are added up with the encoding's weights
(Stouffer), and a token that isn't even over its alphabet at all (chi-squared, 1 %) or
runs on in order has p = 1.  So have digits alone, which ordinary numbers may
be.  The nulls were calibrated on words of the test documents and of English
joined in fifteen ways; tests/llm/test_battery.py holds recall and false
discoveries of each encoding.  A token with separators is one hypothesis as a
whole, and each of its parts of 20 letters and digits or more another, so a key
behind a path is found by itself; hexadecimal digits in groups, as in UUIDs,
are tested without their hyphens.
The different tokens of a document (a repeated one counts once) are judged
together by a weighted Benjamini-Hochberg step: weights grow with the length,
as short tokens tell less, and are 1 on average; the expected share of false
discoveries stays below `rate` as far as the nulls hold.

Edges: null and empty texts have no spans; tokens of any length are tested
whole; ties in start are ordered by kind; null doc_ids and repeated rows are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.shared import prepare

KINDS = ("assign", "access", "hex", "random")
_NAMES = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a maximal run
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


class Encoding(NamedTuple):
    """An alphabet, and the null of ordinary tokens in it.

    alike: their mean serial correlation.  change: their share of neighbours of different class; classes are digits, upper-case,
    lower-case and other characters, or (of one case alone) vowels and others, where random tokens change less often, not more.
    uneven: what chi-squared over the alphabet exceeds its degrees of freedom by, for each character of an ordinary token.
    weights of the z scores of letters, runs, serial correlation and chi-squared; spread: the standard deviation of their sum under the null.
    """

    name: str
    alphabet: str
    change: float
    alike: float
    weights: tuple[float, float, float, float]
    spread: float
    uneven: float
    vowels: bool = False


#: Encodings from the smallest alphabet up.
ENCODINGS = (
    Encoding("digits", _DIGITS, 0.0, 0.0, (0.0, 0.0, 0.0, 0.0), 1.0, 0.0),
    Encoding("hex", _DIGITS + "abcdef", 0.25, 0.30, (0.5, 1.0, 0.8, 1.0), 1.0, 0.9),
    Encoding("hex", _DIGITS + "ABCDEF", 0.25, 0.30, (0.5, 1.0, 0.8, 1.0), 1.0, 0.9),
    Encoding("lower", _LOWER, 0.62, 0.0, (1.0, 1.0, 0.0, 0.3), 1.0, 0.7, True),
    Encoding("upper", _UPPER, 0.62, 0.0, (1.0, 1.0, 0.0, 0.3), 1.0, 0.7, True),
    Encoding("base32", _UPPER + "234567", 0.17, 0.25, (1.5, 0.6, 0.5, 0.3), 1.0, 1.1),
    Encoding("lower36", _DIGITS + _LOWER, 0.20, 0.40, (1.0, 1.0, 0.5, 0.3), 1.0, 1.2),
    Encoding("upper36", _DIGITS + _UPPER, 0.20, 0.40, (1.0, 1.0, 0.5, 0.3), 1.0, 1.2),
    Encoding("alphanumeric", _UPPER + _LOWER + _DIGITS, 0.30, 0.25, (1.0, 1.0, 0.5, 0.3), 1.1, 2.4),
    Encoding("base64", _UPPER + _LOWER + _DIGITS + "+/", 0.30, 0.25, (1.0, 1.0, 0.5, 0.3), 1.0, 2.4),
    Encoding("base64url", _UPPER + _LOWER + _DIGITS + "-_", 0.30, 0.25, (1.0, 1.0, 0.5, 0.3), 1.0, 2.4),
    Encoding("mixed", _UPPER + _LOWER + _DIGITS + "+/-_", 0.35, 0.25, (1.0, 1.0, 0.5, 0.3), 1.0, 2.4),
)
#: Per cent of the letters A to Z in written language; rare ones count as 0.8, as names and abbreviations have them.
_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.8, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.8, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.8, 2.0, 0.8)
_SETS = [frozenset(e.alphabet) for e in ENCODINGS]
_CLASS = np.full(128, 3, np.int8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 0, 1, 2
_VOWEL = np.zeros(128, np.int8)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1


_WITHOUT = str.maketrans("", "", "+/-_")
_HEX_SETS = [frozenset(e.alphabet) for e in ENCODINGS if e.name == "hex"]
#: A token's parts between separators, if they are tokens themselves.
_PART = re.compile(r"[A-Za-z0-9]{20,}")


def hypotheses(text: str) -> list[tuple[int, int, str]]:
    """(start, end, string) of what is tested: the tokens, and the parts between separators of a token that has any."""
    out = []
    for m in _TOKEN.finditer(text):
        out.append((m.start(), m.end(), m[0]))
        body = m[0].rstrip("=")
        out += [(m.start() + p.start(), m.start() + p.end(), p[0]) for p in _PART.finditer(body) if len(p[0]) < len(body)]
    return out


def encoding_of(token: str) -> int | None:
    """Place in ENCODINGS of the smallest alphabet that holds the token; None if none does."""
    used = set(token.rstrip("="))
    return next((k for k, s in enumerate(_SETS) if used <= s), None)


def _surprises(alphabet: str) -> tuple[np.ndarray, float, float]:
    """(surprise of each code under language's shares of the alphabet's letters, 0 for other codes; mean and variance over language)."""
    letters = [c for c in alphabet if c.isalpha()]
    share = np.array([_LETTERS[ord(c.upper()) - 65] for c in letters])
    share /= max(share.sum(), 1e-9)
    out, each = np.zeros(128), -np.log(share)
    out[[ord(c) for c in letters]] = each
    mean = float(share @ each)
    return out, mean, float(share @ (each - mean) ** 2)


_SURPRISES = [_surprises(e.alphabet) for e in ENCODINGS]


def randomness(token: str) -> tuple[float, float, float, float]:
    """(z of the letters' shares, z of runs, z of serial correlation, p value under the null of ordinary tokens); high z and low p mean randomness."""
    body = token.rstrip("=")
    plain = body.translate(_WITHOUT)
    # A few separators don't widen the alphabet, nor do those of hexadecimal digits in groups.
    if len(body) - len(plain) <= len(body) // (8 if any(set(plain) <= h for h in _HEX_SETS) else 12):
        body = plain
    kind = encoding_of(body)
    if kind is None or len(body) < 2 or not any(ENCODINGS[kind].weights):
        return 0.0, 0.0, 0.0, 1.0
    known, n = ENCODINGS[kind], len(body)
    k = len(known.alphabet)
    codes = np.frombuffer(body.encode("ascii"), np.uint8)
    counts = np.bincount(codes, minlength=128)
    chi = float((counts.astype(float) ** 2).sum()) * k / n - n
    surprise, mean, variance = _SURPRISES[kind]
    letters = int(counts[surprise > 0].sum())
    z_letters = (float(surprise[codes].sum()) - letters * mean) / math.sqrt(letters * variance) if letters else 0.0
    classes = (_VOWEL if known.vowels else _CLASS)[codes]
    changes = int((classes[1:] != classes[:-1]).sum())
    z_runs = (changes - (n - 1) * known.change) / math.sqrt((n - 1) * known.change * (1 - known.change)) * (-1 if known.vowels else 1)
    x = codes.astype(float) - codes.mean()
    spread = float((x * x).sum())
    serial = float((x[1:] * x[:-1]).sum()) / spread if spread else 1.0
    z_serial = (known.alike - serial) * math.sqrt(n)
    # A token must be even (the 99th percentile of chi-squared, by Wilson and Hilferty) and not go on as it began (alphabets in order).
    free = k - 1
    even = chi <= free * (1 - 2 / (9 * free) + 2.326 * math.sqrt(2 / (9 * free))) ** 3 and serial * math.sqrt(n) < 3.09
    # Under the null chi-squared is the larger, by `uneven` for each character.
    z_even = (free + n * known.uneven - chi) / math.sqrt(2 * free + 4 * n * known.uneven)
    z = sum(w * x for w, x in zip(known.weights, (z_letters, z_runs, z_serial, z_even))) / math.sqrt(sum(w * w for w in known.weights)) / known.spread
    return z_letters, z_runs, z_serial, 0.5 * math.erfc(z / math.sqrt(2)) if even else 1.0


def discoveries(tokens: list[str], rate: float, reference: int = 32) -> list[bool]:
    """Which tokens the weighted Benjamini-Hochberg step over the different ones finds random; the weight of length n is n / reference, at most 2, over the mean weight."""
    if not tokens:
        return []
    family = list(dict.fromkeys(tokens))
    p = np.array([randomness(t)[3] for t in family])
    weight = np.minimum(2.0, np.array([len(t) for t in family]) / reference)
    q = p / np.minimum(weight / float(weight.mean()), 2.0)
    order = np.argsort(q, kind="stable")
    passed = np.flatnonzero(q[order] <= rate * np.arange(1, len(q) + 1) / len(q))
    found = {family[k] for k in order[: passed[-1] + 1]} if len(passed) else set()
    return [t in found for t in tokens]


def spans_of(text: str, rate: float = 0.01) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span, in order."""
    spans: set[tuple[int, int, int]] = set()
    if (":" in text or "=" in text) and any(h in text.lower() for h in _HINTS):
        spans.update((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12)
    if "AKIA" in text:
        spans.update((m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18)
    spans.update((m.start(), 2, m.end()) for m in _HEX.finditer(text))
    tested = hypotheses(text)
    if tested:
        spans.update((start, 3, end) for (start, end, _), found in zip(tested, discoveries([t for _, _, t in tested], rate)) if found)
    return sorted(spans)


def scan(docs: DataFrame, keep: list[str] | None = None, rate: float = 0.01) -> DataFrame:
    """The columns `keep` (doc_id) and spans, an array of (kind, start, end) by start and kind, of each row."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t or "", rate)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*keep, "spans"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, f"{kinds}, spans array<struct<kind: string, start: long, end: long>>")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones merged) replaced by a mark; n_chars, where there is one, follows the text; null stays null."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")
    sizes = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text or not (spans := spans_of(text)):
            return text
        parts, place = [], 0
        for a, _, b in spans:
            if a >= place:
                parts += [text[place:a], mark]
            place = max(place, b)
        return "".join([*parts, text[place:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, before = list(batch.columns), batch.column(at).to_pylist()
            after = [clean(t) for t in before]
            columns[at] = pa.array(after, batch.column(at).type)
            if sizes is not None:
                columns[sizes] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[sizes].to_pylist(), before, after)], columns[sizes].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
