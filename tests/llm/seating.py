"""The seating process customer by customer, and the parent's tables by Gibbs in one process: what the draws are held against."""

import numpy as np

from readroute.llm import language_model as lm


class Seating:
    """The process itself, customer by customer.

    sizes[i, : tables[i]] are the tables of dish i; `new` gives, for chosen dishes, the
    weight of a new table. `room` is only what is there at first.
    """

    def __init__(self, customers: np.ndarray, discount: float, new, rng: np.random.Generator, room: int):
        self.discount, self.new, self.rng = discount, new, rng
        self.customers = np.zeros(len(customers), np.int64)
        self.tables = self.customers.copy()
        self.sizes = np.zeros((len(customers), room), np.int64)
        while len(who := np.flatnonzero(self.customers < customers)):
            self.enter(who)

    def leave(self, who: np.ndarray) -> None:
        """One customer of each dish, chosen evenly, goes."""
        passed = np.cumsum(self.sizes[who], axis=1) <= (self.rng.random(len(who)) * self.customers[who])[:, None]
        place = passed.sum(1)
        self.sizes[who, place] -= 1
        self.customers[who] -= 1
        empty = self.sizes[who, place] == 0
        gone, hole = who[empty], place[empty]
        self.tables[gone] -= 1
        self.sizes[gone, hole] = self.sizes[gone, self.tables[gone]]
        self.sizes[gone, self.tables[gone]] = 0

    def enter(self, who: np.ndarray) -> None:
        """One customer of each dish is seated."""
        if self.tables[who].max() == self.sizes.shape[1]:
            self.sizes = np.pad(self.sizes, ((0, 0), (0, self.sizes.shape[1])))
        weight = np.maximum(self.sizes[who] - self.discount, 0)
        weight[np.arange(len(who)), self.tables[who]] = np.where(self.tables[who] > 0, self.new(who), 1.0)
        weight = np.cumsum(weight, axis=1)
        place = (weight <= self.rng.random((len(who), 1)) * weight[:, -1:]).sum(1)
        self.tables[who] += self.sizes[who, place] == 0
        self.sizes[who, place] += 1
        self.customers[who] += 1


def parent_tables(customers, known, rng):
    """Tables of words in the parent, each drawn in turn given all others."""
    level = lm.Restaurants(customers, lm.DISCOUNT[1], lm.STRENGTH[1], rng)
    total, of, base = np.array([level.tables.sum()]), np.zeros(len(customers), np.int64), np.full(len(customers), 1 / (known + 1))
    for _ in range(lm.BURN_IN + 1):
        level.sweep(customers, total, of, np.zeros(1), base)
    return level.tables
