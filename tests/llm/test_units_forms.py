"""Units are brought to few different ones, and their ids stay those of the tokenizer."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vitrine.llm import packing

public = pytest.importorskip("public_tokenizers")


def _odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    latin = "aAbBsStTzéÉßÿÝ×÷µªº²'.,;!*$|<>-_09 \n\t\xa0\x85\xad"
    wide = latin + "İıſKÅ̱̀̇—…ж日𝄞 \x1c"
    words = ["Word", "word,", "WORD***", "it's,", "x., ", "), ", "'S, ", "<|endoftext|>", "<|ENDOFTEXT|>", "3. ", "e, ", "... ", "H̱, ", "ÉCOLE. "]
    out = []
    for i in range(n):
        letters = latin if i % 2 else wide
        parts = [rng.choice(words) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(12)]
        out.append(rng.choice(["", " "]).join(parts))
    return out


def test_units_of_odd_texts_are_the_tokenizers_ids():
    path = public.path(packing.TOKENIZER)
    for units in (packing.Units(path), packing.Units(path, keep=20)):
        for text in _odd_texts(1500):
            want = units.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(units.ids(text), "<u4").tolist() == want, repr(text)


def test_forms_of_a_word_reach_the_model_once():
    units, asked = packing.Units(public.path(packing.TOKENIZER)), []

    class Model:
        def tokenize(self, letters, model=units.model):
            asked.append(letters)
            return model.tokenize(letters)

    units.model = Model()
    units.ids("Quizzling quizzling, Quizzling. QUIZZLING quizzling*** Quizzling!!")
    units.ids("Quizzling,日本 quizzling$$$ QUIZZLING")
    assert asked.count("quizzling") == 1 and len(asked) == 1
