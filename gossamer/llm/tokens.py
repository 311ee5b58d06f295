"""Whole-text tokenization with the public vocabulary files.

Every whole text goes to the `tokenizers` library as it is, with nothing set
but add_special_tokens=False.  Texts are given to it in batches of bounded
length; a longer text is a batch of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: Characters of one call of the library, which bounds what its results take.
BATCH_CHARS = 1_000_000


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most BATCH_CHARS characters, or of one longer text."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class WholeTexts:
    """ids of whole texts under one vocabulary file, as the library gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as int32, number of ids of each text); `end` is appended to each text; null is empty."""
        tail = [] if end is None else [end]
        parts, sizes = [np.zeros(0, np.int32)], []
        for some in batches_of([t or "" for t in texts]):
            for found in self.library.encode_batch_fast(some, add_special_tokens=False):
                parts.append(np.array(found.ids + tail, np.int32))
                sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.array(sizes, np.int64)


_OPEN: dict[str, WholeTexts] = {}


def tokenizer(path: str) -> WholeTexts:
    """This worker's tokenizer for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = WholeTexts(path)
    return _OPEN[path]
