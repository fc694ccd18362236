"""Many patterns in one pass: a prefix tree with failure links over literals that every match must hold.

The tree is laid out as one table, state x kind of byte, so a step is a lookup. Text is cut into lanes of equal
length that advance side by side, each with as much text before it as the longest literal needs; the number of steps
depends neither on the number of patterns nor on the texts' lengths.
"""

from __future__ import annotations

import re
from collections import deque
from re import _constants as op, _parser as parser

import numpy as np

LANE = 1024
BREAK = 0xFF  # stands between texts; no byte of UTF-8
#: Letters beyond ASCII that match an ASCII letter when case is ignored.
FOLDED = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}


def literals(pattern: str) -> tuple[list[str], bool] | None:
    """Lower-case ASCII strings of which every match holds one, and whether the pattern is that string and nothing else.

    None if there are none, as in ``\\w+`` or ``a?``.
    """
    tree = parser.parse(pattern)
    found = _best(_held(tree))
    if not found:
        return None
    pure = len(found) == 1 and all(kind is op.LITERAL for kind, _ in tree) and len(tree) == len(found[0])
    return found, pure


def _held(tree) -> list[list[str]]:
    """Groups of strings; of each group one string stands in every match."""
    groups, run = [], ""
    for kind, value in tree:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # without width: what surrounds them is adjacent
            continue
        groups, run = [*groups, [run]], ""
        if kind is op.SUBPATTERN:
            groups += _held(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            groups += _held(value[2])
        elif kind is op.ATOMIC_GROUP:
            groups += _held(value)
        elif kind is op.BRANCH:
            ways = [_best(_held(way)) for way in value[1]]
            groups.append([s for way in ways for s in way] if all(ways) else [])
    return [*groups, [run]]


def _best(groups: list[list[str]]) -> list[str]:
    """The group whose shortest string is longest."""
    return max((g for g in groups if g and all(g)), key=lambda g: (min(map(len, g)), -len(g)), default=[])


class Automaton:
    """Where which of ``words`` (ASCII) end in a text of bytes."""

    def __init__(self, words: list[str]):
        alphabet = sorted({b for w in words for b in w.encode()})
        self.kinds = np.zeros(256, np.int32)  # 0: no word has it
        self.kinds[alphabet] = np.arange(1, len(alphabet) + 1)
        width = len(alphabet) + 1
        children, ends = [{}], [[]]
        for number, word in enumerate(words):
            at = 0
            for b in word.encode():
                kind = int(self.kinds[b])
                if kind not in children[at]:
                    children[at][kind] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][kind]
            ends[at].append(number)
        n = len(children)
        self.table = np.zeros((n, width), np.int32)
        fail, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)  # shorter: next state on the failure path where a word ends
        queue = deque()
        for kind, child in children[0].items():
            self.table[0, kind] = child
            queue.append(child)
        while queue:  # by depth, so that rows of shorter paths are complete
            at = queue.popleft()
            self.table[at] = self.table[fail[at]]
            self.shorter[at] = fail[at] if ends[fail[at]] else self.shorter[fail[at]]
            for kind, child in children[at].items():
                fail[child] = self.table[fail[at], kind]
                self.table[at, kind] = child
                queue.append(child)
        self.ends = np.array([e[0] if e else -1 for e in ends], np.int64)  # words are distinct
        self.hit = (self.ends >= 0) | (self.shorter > 0)
        self.longest = max(map(len, words), default=1)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place behind the end, number of the word) of all occurrences, by place."""
        lanes = max(1, -(-len(text) // LANE))
        before = self.longest - 1
        padded = np.full(before + lanes * LANE, BREAK, np.uint8)
        padded[before : before + len(text)] = text
        kinds = self.kinds[padded]
        start, width, flat = np.arange(lanes) * LANE, self.table.shape[1], self.table.reshape(-1)
        state, states = np.zeros(lanes, np.int32), np.zeros((LANE, lanes), np.int32)
        for step in range(before + LANE):
            state = flat[state * width + kinds[start + step]]
            if step >= before:
                states[step - before] = state
        states = states.T.reshape(-1)  # in the order of the text
        at = np.flatnonzero(self.hit[states])
        places, numbers, here = [], [], states[at]
        while len(at):
            own = self.ends[here] >= 0
            places.append(at[own] + 1)
            numbers.append(self.ends[here[own]])
            here = self.shorter[here]
            more = here > 0
            at, here = at[more], here[more]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, numbers = np.concatenate(places), np.concatenate(numbers)
        order = np.lexsort((numbers, places))
        return places[order], numbers[order]


def apart(words: np.ndarray, rows: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per occurrence, ordered by word, row and place, whether a scan from the left that goes on behind each match counts it."""
    keep, close = np.ones(len(places), bool), np.zeros(len(places), bool)
    size = lengths[words]
    close[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1]) & (places[1:] - places[:-1] < size[1:])
    last = -1  # the match counted last among those that overlap
    for i in np.flatnonzero(close).tolist():
        last = last if close[i - 1] else i - 1
        keep[i] = places[i] - places[last] >= size[i]
        if keep[i]:
            last = i
    return keep


def compiled(pattern: str, case_sensitive: bool) -> re.Pattern:
    return re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)
