"""What a Python worker remembers is bounded low enough for two workers an executor, and forgetting changes no result."""

from __future__ import annotations

import inspect

import public_tokenizers

from vitrine.llm.packing import TOKENIZER, Units
from vitrine.llm.token_counts import Transducer


def test_units_forget_and_keep_their_ids():
    path = public_tokenizers.path(TOKENIZER)
    small, large = Units(path, keep=5), Units(path)
    assert large.keep <= 200_000
    texts = [" ".join(f"wörd{i * j}, x{i}{j}." for j in range(9)) for i in range(30)]
    assert [small.ids(t) for t in texts] == [large.ids(t) for t in texts]
    assert len(small) + len(small.old) < len(large)


def test_states_kept_by_default():
    assert inspect.signature(Transducer).parameters["keep"].default <= 100_000
