"""Words of ASCII letters are tokenized without the pattern; ids stay those of the library."""

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import tokens


def test_words_of_letters_are_not_split_by_the_pattern():
    enc = tokens.encoder(tokens.default_path())
    asked, find = [], enc.find
    enc.find = lambda text: asked.append(text) or find(text)
    text = "First " + " ".join(a + b + "qzx" for a in "abcdefgh" for b in "ijklmnop") + " l'été 12th end."
    want = Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc(text), "<u4").tolist() == want
    assert asked == ["First", " l'été", " 12th", " 12", " end."]


def test_texts_that_go_to_the_library_whole():
    enc, library = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    plain = ["a b", "été à", "a  b", "a \tb", "a\x85b \xa0c", "tab\tin\nlines ", "word\x1bx", " ", "ɏ"]
    odd = ["a\0b", "a\x1cb c", "x\x1f", "né\0", "é\x1d", "a<|endoftext|>b", "é <|endoftext|>", "ɐ", "語 a"]
    assert not any(map(enc.strange, plain)) and all(map(enc.strange, odd))
    for text in plain + odd:
        assert np.frombuffer(enc(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
