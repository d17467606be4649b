"""Rolling hashes and the anchors they pick, for operators that look for equal passages.

Units are bytes or words.  Every window of `length` units has one anchor: the smallest hash among
the runs of `span` units inside it, the leftmost if several are equal.  Equal windows have equal
anchors at equal places, so passages that repeat meet wherever rows are dealt by anchor, and text
whose anchors occur once needs no further look.
"""

from __future__ import annotations

import re

import numpy as np

# An odd factor has an inverse modulo 2 ** 64, which takes the place out of a sum of powers.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
PLACE_BITS = 24
# Windows, or an eighth as many words, that are looked at together; bounds the memory of a long text.
PIECE = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, many: int) -> np.ndarray:
    made = np.full(many, base, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)


class Powers:
    """Powers of the factor and of its inverse, made longer when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, many: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < many:
            self.up, self.down = (_powers(base, max(many, 2 * len(self.up), 1 << 16)) for base in (FACTOR, INVERSE))
        return self.up[:many], self.down[:many]


POWERS = Powers()


def mixed(values: np.ndarray) -> np.ndarray:
    """The values scattered over 64 bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(29)
    return values


def _sums(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of units times powers, and the inverse powers."""
    up, down = POWERS.upto(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of unit ranges, independent of where they stand."""
    sums, down = _sums(units)
    return mixed((sums[ends] - sums[starts]) * down[starts])


def run_hashes(units: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all runs of `span` units."""
    if len(units) < span:
        return np.zeros(0, np.uint64)
    sums, down = _sums(units)
    return mixed((sums[span:] - sums[:-span]) * down[: len(units) - span + 1])


def word_ranges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 text start and end."""
    spaces = np.concatenate([[True], SPACE_BYTES[np.frombuffer(data, np.uint8)], [True]])
    edges = np.flatnonzero(spaces[1:] != spaces[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 text."""
    starts, ends = word_ranges(data)
    letters = np.frombuffer(data, np.uint8)
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(starts), PIECE // 8):
        first, last = starts[at : at + PIECE // 8], ends[at : at + PIECE // 8]
        found.append(range_hashes(letters[first[0] : last[-1]], first - first[0], last - first[0]))
    return np.concatenate(found)


def anchors(units: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last window that it is the anchor of.

    Windows are taken PIECE at a time; an anchor at the seam of two pieces comes twice.
    """
    width = length - span + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    found = []
    for start in range(0, max(len(units) - length + 1, 0), PIECE):
        hashes = run_hashes(units[start : start + PIECE + length - 1], span)
        # The place in the low bits makes the smallest value tell where it stands, leftmost first.
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        found.append((hashes[place[first]], start + first, start + last))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))
