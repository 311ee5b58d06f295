"""Texts with the strings of added tokens: the library's default ids, alone and among other texts."""

import pytest

from gossamer.llm import queries
from gossamer.llm.tokens import WholeTexts

TEXTS = ["x <|endoftext|> y", "x y", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> end", "<|endoftext", "", None, "é漢 <|endoftext|>", "a<|endoftext|><|endoftext|>  b\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_ids_of_the_library(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary(name))
    expected = [own.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    ids, sizes = WholeTexts(queries.vocabulary(name)).encode(TEXTS)
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_ids_of_an_added_token():
    assert WholeTexts(queries.vocabulary("byte_bpe_50k.json")).encode(["x <|endoftext|> y"])[0].tolist() == [87, 220, 50256, 331]
    assert WholeTexts(queries.vocabulary("word_bpe_49k.json")).encode(["x <|endoftext|> y"])[0].tolist() == [343, 49407, 344]
