"""Places of the public tokenizers' files, and bounded caches for their results."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: A cache keeps two generations of at most about this many entries, so a worker's memory is bounded.
CACHE_ENTRIES = 350_000
#: Longer pieces are not kept.
CACHE_CHARS = 64


def vocabulary(name: str) -> str:
    """Path of a file of the installed tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """piece -> result, made by ``make`` for many missing pieces at once.

    When the younger generation is full it becomes the older one; pieces still in use move over.
    """

    def __init__(self, make: Callable[[list[str]], Iterable]):
        self.make, self.young, self.old = make, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def of(self, pieces: list[str]) -> list:
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, pieces))
        if None in found:
            self._learn({p for p, r in zip(pieces, found) if r is None}, found, pieces)
        return found

    def _learn(self, missing: set[str], found: list, pieces: list[str]) -> None:
        """Fill the gaps of ``found``, from the older generation or by ``make``."""
        new = {p: self.old[p] for p in missing if p in self.old}
        rest = [p for p in missing if p not in new]
        new.update(zip(rest, self.make(rest)))
        self.young.update((p, r) for p, r in new.items() if len(p) <= CACHE_CHARS)
        for i, piece in enumerate(pieces):
            if found[i] is None:
                found[i] = new[piece]
