"""A bounded memory of values by key, in two generations: what was used since the last turn survives it."""

from __future__ import annotations


class Recall:
    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, wanted: set) -> list:
        """Keys without a value; all others of ``wanted`` are young afterwards."""
        if len(self.young) + len(wanted) > self.most:
            self.old, self.young = self.young, {}
        new = []
        for key in wanted.difference(self.young):
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self.young[key] = value
        return new
