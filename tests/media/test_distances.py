"""Edit distances by bits against the table of cells, and long unlike texts."""
import random
import time

import numpy as np

from mediaframe.operators.evaluate import _by_bits, edit_distance


def cells(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_distances_equal_the_table():
    r = random.Random(1)
    for _ in range(400):
        x, y = ([r.randrange(r.choice([2, 4, 30])) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 130]))] for _ in range(2))
        assert edit_distance(np.array(x, int), np.array(y, int)) == cells(x, y)
        if x and y:
            assert _by_bits(np.array(x), np.array(y)) == cells(x, y) == _by_bits(np.array(y), np.array(x))


def test_unlike_texts_of_twenty_thousand_words():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 5000, 20_000), r.integers(0, 5000, 19_000)
    began = time.time()
    d = edit_distance(x, y)
    assert time.time() - began < 30 and 15_000 < d <= 20_000
