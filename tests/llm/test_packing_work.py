"""The genetic part of best-fit packing works where best fit alone is not proven least."""

import inspect

import numpy as np

from perflog.llm import packing as P


def test_births_better_a_hard_block():
    rng, sizes = np.random.default_rng(1), []
    for _ in range(400):  # three pieces that fill a sequence
        a, b = int(rng.integers(513, 1024)), int(rng.integers(513, 1024))
        sizes += [a, b, 2048 - a - b] if a + b < 2048 else [2048 - a, a]
    sizes = np.array(sizes, np.int64)
    how = {k: p.default for k, p in inspect.signature(P.pack).parameters.items()}
    assert how["births"] >= 2 * how["population"]
    rng = np.random.default_rng([0, 0, 0])
    people = [P.fresh(sizes, 2048, rng, 0.0 if k == 0 else .04 * (1 + k)) for k in range(how["population"])]
    alone = len(np.unique(people[0]))
    for _ in range(how["epochs"]):
        people = P.evolve(sizes, people, 2048, how["births"], how["population"], rng)
    best = people[0]
    assert len(np.unique(best)) <= alone - 2 and np.bincount(best, weights=sizes).max() <= 2048
