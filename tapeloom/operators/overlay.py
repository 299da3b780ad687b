"""A map of the state store as one batch sees it."""

from __future__ import annotations


class Overlay:
    """What a batch asks a map state for is read once, what it changes is written once. Keys and values are tuples.

    whole: read all of the state at once; then nothing is asked for one by one, nor is it asked what is to be removed, and
    what is put and taken away again within the batch leaves nothing behind.
    """

    def __init__(self, state, whole: bool = False):
        self.state, self.changed = state, set()
        self.seen = dict(state.iterator()) if whole else {}
        self.stored = frozenset(self.seen) if whole else None

    def get(self, key: tuple) -> tuple | None:
        if self.stored is not None:
            return self.seen.get(key)
        if key not in self.seen:
            self.seen[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.seen[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        if value is None and self.stored is not None and key not in self.stored:
            self.seen.pop(key, None)
            self.changed.discard(key)
            return
        self.seen[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.state.updateValue(key, self.seen[key])
            elif self.state.containsKey(key) if self.stored is None else key in self.stored:
                self.state.removeKey(key)
