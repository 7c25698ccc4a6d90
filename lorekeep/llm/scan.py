"""Finite-state scans over code points, without regular expressions.

A text is an array of character classes. A deterministic automaton reads it in
chunks of equal length: every chunk yields a state map (for each entry state,
the state at its end), maps compose associatively, and a parallel prefix scan
over the maps gives every chunk's true entry state. A second pass then has the
state before every character, and a table of (state, class) says where a piece
begins.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_LAST, WHITE_LAST, WHITE, BREAK = range(9)
CLASSES = 9
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, HELD_SPACE, SHORT_TAIL, LONG_TAIL, ENDED = range(9)
STATES = 9
CHUNK = 64

#: Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def base_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[list(WHITE_SPACE)] = WHITE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classify(points: np.ndarray, breaks: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """The class of every code point. ``breaks``: positions that only separate texts; ``base``: the code points'
    classes, Python's if none are given. Classes look at most two characters ahead: a quote that a contraction
    may follow, and white space that is the last before something else.
    """
    classes = (base_classes() if base is None else base)[points]
    classes[breaks] = BREAK
    ends = np.append(classes[1:], np.uint8(BREAK))
    last = (classes == WHITE) & (ends != WHITE) & (ends != BREAK)
    classes[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
    quotes = np.flatnonzero((points == 39) & (classes == OTHER))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        solid = np.concatenate([classes != BREAK, np.zeros(2, bool)])
        one, two, sound = padded[quotes + 1], padded[quotes + 2], solid[quotes + 1]
        classes[quotes[sound & np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        classes[quotes[sound & solid[quotes + 2] & long]] = QUOTE2
    return classes


class Automaton:
    """next and begins: tables of (state, class)."""

    def __init__(self, moves: np.ndarray, begins: np.ndarray) -> None:
        self.moves, self.begins = moves.astype(np.intp), begins.astype(bool)

    def states(self, classes: np.ndarray) -> np.ndarray:
        """The state before every character."""
        n = len(classes)
        flat = self.moves.ravel()
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, BREAK, np.intp)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None] * CLASSES, rows, axis=1)
        scaled = flat * CLASSES
        for column in grid:
            maps = scaled.take(maps + column)
        maps = prefix(maps // CLASSES)
        entry = np.empty(rows, np.intp)
        entry[0] = START
        entry[1:] = maps[START, :-1]
        out = np.empty((CHUNK, rows), np.intp)
        state = entry * CLASSES
        for k, column in enumerate(grid):
            out[k] = state
            state = scaled.take(state + column)
        return (out.T.ravel()[:n]) // CLASSES

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which a piece begins."""
        return np.flatnonzero(self.begins.ravel().take(self.states(classes) * CLASSES + classes))


def prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, one a column, in a logarithmic number of rounds."""
    n, step = maps.shape[1], 1
    while step < n:
        joined = maps.copy()
        joined[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        maps, step = joined, step * 2
    return maps


def _automaton(attach_space: bool, single_numbers: bool) -> Automaton:
    moves = np.zeros((STATES, CLASSES), np.uint8)
    begins = np.ones((STATES, CLASSES), bool)
    for state in range(STATES):
        joins = {state} | ({IN_LETTERS, IN_NUMBERS, IN_OTHERS} if state == HELD_SPACE else set())
        moves[state, LETTER] = {SHORT_TAIL: ENDED, LONG_TAIL: SHORT_TAIL}.get(state, IN_LETTERS)
        begins[state, LETTER] = state not in (SHORT_TAIL, LONG_TAIL) and IN_LETTERS not in joins
        moves[state, NUMBER] = IN_NUMBERS
        begins[state, NUMBER] = IN_NUMBERS not in joins or single_numbers
        for quote, tail in ((OTHER, IN_OTHERS), (QUOTE1, SHORT_TAIL), (QUOTE2, LONG_TAIL)):
            inside = IN_OTHERS in joins
            moves[state, quote] = IN_OTHERS if inside else tail
            begins[state, quote] = not inside
        moves[state, SPACE_LAST] = HELD_SPACE if attach_space else ENDED
        moves[state, WHITE_LAST] = ENDED
        moves[state, WHITE] = IN_WHITE
        begins[state, WHITE] = state != IN_WHITE
        moves[state, BREAK] = START
    return Automaton(moves, begins)


@cache
def spaced() -> Automaton:
    """Pieces of public_tokenizers.PATTERN: a single space belongs to the piece after it."""
    return _automaton(attach_space=True, single_numbers=False)


@cache
def bare() -> Automaton:
    """Pieces of the lower-case vocabulary: white space is no part of any, every number is a piece of its own."""
    return _automaton(attach_space=False, single_numbers=True)
