"""The configuration program against best fit and the bound; token ids of odd texts against the tokenizer."""

import random
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import packing
from granary.llm.queries import tokenizer_file


def sequences(plan):
    return sum(often for _, often in plan)


@pytest.mark.parametrize("seed", range(50))
def test_plan_is_never_above_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([100, 256, 600])
    low, high = sorted((r.randrange(1, capacity + 1), r.randrange(1, capacity + 1)))
    histogram = dict(Counter(r.randrange(low, high + 1) for _ in range(r.randrange(0, 1500))))
    plan, held = packing.plan(histogram, capacity), Counter()
    for config, often in plan:
        assert often > 0 and sum(x * n for x, n in config.items()) <= capacity
        for x, n in config.items():
            held[x] += n * often
    assert held == histogram
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    bound = packing.lower_bound(lengths, counts, capacity) if len(lengths) else 0
    assert bound <= sequences(plan) <= sequences(packing.best_fit(lengths.tolist(), counts.tolist(), capacity))


def test_program_packs_most_pieces_of_a_wide_histogram():
    r = random.Random(3)
    histogram = Counter(min(2047, max(1, int(r.lognormvariate(6, 1)))) for _ in range(20_000))
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(x)] for x in lengths])
    found, left = packing.configuration_program(lengths, counts, 2048)
    assert left.sum() < 0.1 * counts.sum() and len(found) <= len(lengths)
    assert sequences(packing.plan(dict(histogram))) <= packing.lower_bound(lengths, counts, 2048) + 1


def test_best_configuration_against_brute_force():
    r = random.Random(7)
    for _ in range(40):
        lengths = r.sample(range(3, 30), 4)
        most, values = [r.randrange(1, 4) for _ in lengths], [r.random() for _ in lengths]
        options = {}
        for a in range(most[0] + 1):
            for b in range(most[1] + 1):
                for c in range(most[2] + 1):
                    for d in range(most[3] + 1):
                        used = (a, b, c, d)
                        size = sum(n * x for n, x in zip(used, lengths))
                        if size <= 50:
                            worth = sum(n * x for n, x in zip(used, values))
                            options[size] = max(options.get(size, -1), worth)
        found = packing.best_configuration(lengths, most, values, 50)
        assert sum(n * lengths[i] for i, n in found.items()) == max(options)
        assert abs(sum(n * values[i] for i, n in found.items()) - options[max(options)]) < 1e-9


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def ids_of(text):
    cache = packing.word_ids(tokenizer_file())
    words = packing.separated(text.encode("utf-8", "replace")).split()
    cache.learn(set(words))
    return array("I", b"".join(cache[w] for w in words)).tolist()


PIECES = st.sampled_from(["the", "Word", "ÄÖ", "ß", "İi", "naïve", "é", "ﬁn", "中文", "１２", "a.b", "end.", "!?", "<|", "|>", "don't", " ", " ", "​", "\x00", "  ", "\n\t", "𝔸", "3.14", "x²"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=12).map("".join), st.lists(PIECES, max_size=12).map(" ".join)))
def test_ids_of_odd_texts(tokenizer, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids
