"""Suffix arrays of texts whose substrings repeat: one induction, whatever the depth of the repeats."""

import numpy as np

from marlstone.llm import suffix_dedup


def deep_texts():
    rng = np.random.default_rng(3)
    for part, times in (((1, 2, 1, 0, 3), 120), ((1, 0), 300), ((0,), 400)):
        yield np.tile(part, times)
    line = rng.integers(1, 27, 110)
    yield np.concatenate([np.append(line[rng.integers(0, 9) :], 0) for _ in range(12)])
    yield rng.integers(0, 3, 900)


def test_names_that_repeat_take_one_induction(monkeypatch):
    calls, induce = [], suffix_dedup._induce
    monkeypatch.setattr(suffix_dedup, "_induce", lambda *args: calls.append(len(args[0])) or induce(*args))
    for text in deep_texts():
        calls.clear()
        raw = text.astype(">u2").tobytes()
        assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda k: raw[2 * k :])
        assert calls == [len(text)]


def test_doubling_orders_all_suffixes():
    for text in [*deep_texts(), np.zeros(1, np.int64), np.arange(50)[::-1]]:
        raw = text.astype(">u2").tobytes()
        assert suffix_dedup._doubled(text).tolist() == sorted(range(len(text)), key=lambda k: raw[2 * k :])
