"""Encoding text by text at the speed of a lookup.

Where a tokenizer never merges across certain borders, a text's ids are the ids of its units in a row, and units repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class UnitCache:
    """Units to whatever ``encode`` makes of them.

    Two generations bound the memory: once the young one holds half of ``limit`` it becomes the old one, and what is asked
    for again moves to the new young one.  Frequent units so stay, rare ones go.
    """

    def __init__(self, encode: Callable[[list], Iterable], limit: int = 400_000) -> None:
        self.encode = encode
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, units: list) -> list:
        """The value of each unit, in order."""
        values = list(map(self.young.get, units))
        open_at = [i for i, v in enumerate(values) if v is None]
        if not open_at:
            return values
        if len(self.young) > self.limit // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for u in {units[i] for i in open_at}:
            value = old.get(u)
            if value is None:
                new.append(u)
            else:
                young[u] = value
        young.update(zip(new, self.encode(new)))
        for i in open_at:
            values[i] = young[units[i]]
        return values
