"""Made-up texts for tests."""

WORDS = "the of and river lantern boat copper kettle gate paper green blue road house stone light water wind hand tree field night door".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))
