"""Invented texts."""

import random

WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from old trees near cold water".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))
