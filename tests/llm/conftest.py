import random

import pytest


@pytest.fixture(scope="session")
def words():
    """A maker of distinct texts from a small vocabulary."""
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "na") for b in ("n", "rt", "sk", "la", "", "vi", "pe", "do")]

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return make
