"""A minimal acyclic transducer: words to lists of ids, in one memory-mappable block.

Words are added in sorted order; a state that will not change any more is replaced by an
equal one if there is one, so that common suffixes are shared (incremental minimisation of
a sorted list). Each edge carries how many words precede those behind it, which makes the
automaton a minimal perfect hash: the sum along a path is the word's number, and that
number selects its ids.
"""

from __future__ import annotations

import mmap
import tempfile
from array import array
from bisect import bisect_left
from itertools import accumulate

_FIELDS = ("starts", "targets", "skips", "ends", "ids")


def compile_words(words: dict[str, list[int]]) -> bytes:
    """Header of six lengths, five arrays of unsigned 32-bit numbers, labels and finals."""
    ordered = sorted((w.encode(), ids) for w, ids in words.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, edges) of frozen states

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            frozen = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], frozen))

    for word, _ in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0])
    counts = []
    for final, edges in states:  # children are frozen before their parents
        counts.append(final + sum(counts[t] for _, t in edges))
    starts, labels, targets, skips = array("I", [0]), bytearray(), array("I"), array("I")
    for final, edges in states:
        before = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += counts[target]
        starts.append(len(labels))
    ends = array("I", accumulate((len(ids) for _, ids in ordered), initial=0))
    ids = array("I", (i for _, each in ordered for i in each))
    arrays = (starts, targets, skips, ends, ids)
    header = array("I", [root, len(states), *map(len, arrays), len(labels)])
    return b"".join([header.tobytes(), *[a.tobytes() for a in arrays], bytes(labels), bytes(f for f, _ in states)])


class Lexicon:
    """Reads a compiled block through a memory map. The file is unlinked at once: the map
    holds it, and nothing is left in the executor's folder."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        head = view[:32].cast("I")
        self.root, states = head[0], head[1]
        at = 32
        for name, n in zip(_FIELDS, head[2:7], strict=True):
            setattr(self, name, view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.labels = view[at : at + head[7]]
        self.finals = view[at + head[7] : at + head[7] + states]

    def get(self, word: str) -> list[int] | None:
        state, number = self.root, 0
        starts, labels, targets, skips = self.starts, self.labels, self.targets, self.skips
        for byte in word.encode():
            stop = starts[state + 1]
            edge = bisect_left(labels, byte, starts[state], stop)
            if edge == stop or labels[edge] != byte:
                return None
            number += skips[edge]
            state = targets[edge]
        if not self.finals[state]:
            return None
        return self.ids[self.ends[number] : self.ends[number + 1]].tolist()
