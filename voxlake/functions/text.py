"""Text functions of catalogues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """The suffix automaton of a text: each state stands for the parts of the text that end at the same places."""

    def __init__(self, text: str):
        self.step, self.link, self.size = [{}], [-1], [0]
        last = 0
        for c in text:
            new = self._state({}, 0, self.size[last] + 1)
            at = last
            while at >= 0 and c not in self.step[at]:
                self.step[at][c] = new
                at = self.link[at]
            if at >= 0:
                met = self.step[at][c]
                if self.size[met] > self.size[at] + 1:  # the state stands for longer parts too: those that c extends get one of their own
                    own = self._state(dict(self.step[met]), self.link[met], self.size[at] + 1)
                    while at >= 0 and self.step[at].get(c) == met:
                        self.step[at][c] = own
                        at = self.link[at]
                    self.link[met], met = own, own
                self.link[new] = met
            last = new

    def _state(self, step: dict, link: int, size: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.step) - 1

    def longest_in(self, text: str) -> str:
        """The longest part of `text` that the automaton's text holds, the first of equal ones."""
        at = n = best = end = 0
        for i, c in enumerate(text):
            while at and c not in self.step[at]:
                at = self.link[at]
                n = self.size[at]
            if c in self.step[at]:
                at, n = self.step[at][c], n + 1
            if n > best:
                best, end = n, i + 1
        return text[end - best : end]


def common_part(a: str | None, b: str | None) -> str | None:
    return None if a is None or b is None else Automaton(b).longest_in(a)


def longest_common_substring(a: Column, b: Column) -> Column:
    """The longest common substring, the first in `a` of equal ones; NULL if either is. One pass over each text, in Arrow batches."""

    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([common_part(x, y) for x, y in zip(left, right, strict=True)], dtype=object)

    return run(a, b)
