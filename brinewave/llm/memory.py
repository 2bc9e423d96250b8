"""What a worker remembers, within bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Remembered:
    """Values by key in two generations: when the new one is full, it becomes the old one, and what the old one held and
    nobody asked for since is gone. Frequent keys stay, rare ones go a few at a time.
    """

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def joined(self, keys: list[str], learn: Callable[[set[str]], None]) -> bytes:
        """The values of the keys, one after the other; learn(unknown) must put those of unknown keys in."""
        try:
            return b"".join(map(self.new.__getitem__, keys))
        except KeyError:
            self.ready(keys, learn)
            return b"".join(map(self.new.__getitem__, keys))

    def ready(self, keys: Iterable[str], learn: Callable[[set[str]], None]) -> None:
        """See to it that the keys are there together, however many they are."""
        unknown = set(keys).difference(self.new)
        if len(self.new) + len(unknown) > self.most:
            self.old, self.new = self.new, {}
            unknown = set(keys)
        again = self.old.keys() & unknown
        self.new.update((k, self.old[k]) for k in again)
        if rest := unknown.difference(again):
            learn(rest)

    def values(self, keys: Iterable[str], learn: Callable[[list[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """The values of distinct keys, in their order; learn(unknown) gives those of unknown keys and puts in what is worth it."""
        found = dict(zip(keys, map(self.new.get, keys)))
        if unknown := [k for k, v in found.items() if v is None]:
            if len(self.new) + len(unknown) > self.most:
                self.old, self.new = self.new, {}
            again = {k: v for k, v in zip(unknown, map(self.old.get, unknown)) if v is not None}
            self.new.update(again)
            found.update(again)
            if rest := [k for k in unknown if k not in again]:
                found.update(learn(rest))
        return found
