"""Invented prose."""

import random


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "or", "ti", "shi", "ré", "wo", "ing", "ka", "mo"]
    out = []
    for i in range(n):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.08:
            out[-1] += ".\n"
    return " ".join(out)
