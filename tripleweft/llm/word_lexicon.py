"""A minimal acyclic word transducer in one flat array of 32-bit numbers.

The words are compiled into a deterministic automaton whose equal suffixes are
shared. Every transition carries a number; their sum along a word's path is the
word's place in byte order, and under that place stand the word's output ids.
All parts lie in one array, so that a file of it can be memory-mapped and used
as it is.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

_HEADER = 4  # numbers of transitions, states, words and ids
MAX_BYTES = 64  # longer words are not compiled


def compile_lexicon(words: Mapping[bytes, list[int]]) -> np.ndarray:
    """The automaton of `words` with their output ids; empty and overlong words are left out.

    Words come in byte order, so once a word is in, the path on which its
    successor parts from it can only be joined to an equal state or kept.
    """
    order = sorted(w for w in words if 0 < len(w) <= MAX_BYTES)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}
    open_path: list[list] = [[False, []]]  # states of the word in work, root first: final, transitions
    previous = b""

    def close(depth: int) -> None:
        while len(open_path) > depth + 1:
            final, arcs = open_path.pop()
            state = (final, tuple(arcs))
            number = known.get(state)
            if number is None:
                number = known[state] = len(states)
                states.append(state)
            open_path[-1][1].append((previous[len(open_path) - 1], number))

    for word in order:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        open_path += [[False, []] for _ in range(len(word) - shared)]
        open_path[-1][0] = True
        previous = word
    close(0)
    states.append((open_path[0][0], tuple(open_path[0][1])))  # the root is the last state

    below = np.zeros(len(states), np.int64)  # words that end at or behind a state
    key, target, output = [], [], []
    for number, (final, arcs) in enumerate(states):  # targets come before their sources
        before = int(final)
        for label, to in arcs:
            key.append(number << 8 | label)
            target.append(to)
            output.append(before)
            before += int(below[to])
        below[number] = before
    ids = [words[w] for w in order]
    offsets = np.cumsum([0, *map(len, ids)])
    final = [state[0] for state in states]
    parts = [[len(key), len(states), len(order), offsets[-1]], key, target, output, final, offsets, *ids]
    return np.concatenate([np.asarray(part, np.int32) for part in parts])


class Lexicon:
    """A compiled lexicon; `flat` may be memory-mapped."""

    def __init__(self, flat: np.ndarray):
        arcs, states, self.n_words, n_ids = map(int, flat[:_HEADER])
        sizes = [arcs, arcs, arcs, states, self.n_words + 1, n_ids]
        edges = np.cumsum([_HEADER, *sizes])
        parts = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.key, self.target, self.output, self.final, self.offsets, self.ids = parts
        self.root = states - 1

    def places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each word of a ragged byte array its place, or -1 if it is not in the lexicon.

        All words take a step together; those that have ended or have no
        transition leave the walk.
        """
        length = np.diff(offsets)
        place = np.full(len(length), -1, np.int64)
        at = np.flatnonzero((length > 0) & (length <= MAX_BYTES))
        if not len(self.key):
            return place
        state = np.full(len(at), self.root, np.int64)
        total = np.zeros(len(at), np.int64)
        for step in range(MAX_BYTES):
            wanted = (state << 8 | data[offsets[at] + step]).astype(np.int32)
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[arc] == wanted
            at, arc, total = at[found], arc[found], total[found]
            state, total = self.target[arc].astype(np.int64), total + self.output[arc]
            ended = length[at] == step + 1
            whole = ended & (self.final[state] != 0)
            place[at[whole]] = total[whole]
            at, state, total = at[~ended], state[~ended], total[~ended]
            if not len(at):
                break
        return place
