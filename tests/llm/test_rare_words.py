"""Words that a worker does not remember cost little, and their counts stay those of the library."""

from __future__ import annotations

import random

import pytest

from vitrine.llm import token_counts

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


def test_marks_make_no_new_words():
    machine = token_counts.Transducer(token_counts.PieceModel(public.path(token_counts.MODEL)))
    machine.tokens("quizzling quizzling, quizzling. quizzling) quizzling*** quizzling")
    assert {w for w in machine.words if "quizzling" in w} == {"▁quizzling"}


@pytest.mark.parametrize("open_arcs", [1, 256])
def test_counts_of_odd_texts_are_the_librarys(monkeypatch, open_arcs):
    import sentencepiece

    monkeypatch.setattr(token_counts, "OPEN_ARCS", open_arcs)
    path = public.path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = token_counts.Transducer(token_counts.PieceModel(path), keep=2000)
    rng = random.Random(8)
    runs = ["".join(rng.choices(s, k=400)) for s in ("ab", "theions", "=-_", "日本のé", "aAeEtT.,_²{") for _ in range(20)]
    for text in _odd_texts(800) + runs:
        assert machine.tokens(text) == len(library.encode(text)), repr(text)
    assert len(machine.apart) <= 4000 and len(machine.words) <= 4400
