"""Merges of every kind against the tokenizers library: also those whose parts never meet."""

import random
from itertools import product

import pytest

from lodestone.llm import bpe

END = bpe.WORD_END


def library(vocab, merges):
    from tokenizers import Tokenizer, models

    return Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=END))


def compare(letters, merges, longest):
    base = [*letters, *(x + END for x in letters)]
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*base, *(u + v for u, v in merges)]))}
    own, lib = bpe.MergeAutomaton(vocab, merges), library(vocab, merges)
    for n in range(1, longest + 1):
        for word in map("".join, product(letters, repeat=n)):
            assert own.encode(word) == lib.encode(word).ids, (word, merges)


def test_parts_that_never_meet():
    compare("abc", [("b", "c" + END), ("a", "b"), ("ab", "c" + END)], 6)
    compare("ab", [("a", "a"), ("a", "b"), ("a", "ab"), ("aa", "b")], 9)


@pytest.mark.parametrize("seed", range(40))
def test_random_merges_equal_the_library(seed):
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    known, merges, made = [*letters, *(x + END for x in letters)], [], set()
    for _ in range(rnd.randint(1, 14)):
        u, v = rnd.choice([t for t in known if not t.endswith(END)]), rnd.choice(known)
        if u + v in made or u + v in known or len(u + v) > 12:
            continue
        merges.append((u, v))
        made.add(u + v)
        known.append(u + v)
    compare(letters, merges, 9 if len(letters) == 2 else 6)
