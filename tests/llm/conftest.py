import numpy as np
import pytest


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(3)


@pytest.fixture(scope="session")
def words(rng):
    """A made vocabulary of 400 words."""
    return ["".join(rng.choice(list("aeioubcdfglmnprst"), rng.integers(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(rng, words):
    """A function from a number of words to prose."""
    return lambda n: " ".join(rng.choice(words, n))
