"""Invented prose in two languages."""

import random

WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}


def prose(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    w = WORDS[lang]
    return " ".join(rng.choice(w) + rng.choice(["", "", "en", "ing", "ung"]) for _ in range(n))
