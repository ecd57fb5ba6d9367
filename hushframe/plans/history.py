"""Decisions of a review as versions of a table: a new version for each step, undo and redo by choosing one."""

from __future__ import annotations

from pyspark.sql import DataFrame

STATES = 50


class History:
    """Up to fifty states; a step after an undo drops what was undone."""

    def __init__(self, first: DataFrame) -> None:
        self.states, self.at = [first], 0

    @property
    def now(self) -> DataFrame:
        return self.states[self.at]

    def step(self, new: DataFrame) -> DataFrame:
        self.states = [*self.states[: self.at + 1], new][-STATES:]
        self.at = len(self.states) - 1
        return new

    def undo(self) -> DataFrame:
        self.at = max(0, self.at - 1)
        return self.now

    def redo(self) -> DataFrame:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.now
