"""A whole page matched in one function, as the definition says it: what the relations and kernels are held against."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from gridmill.operators.match import LEAST_OVERLOOKED, LEAST_PLACED, Cell, Page, aligned


def normal(s: str) -> str:
    return re.sub("[^a-z0-9]", "", s.lower())


@dataclass
class Word:
    id: str
    text: str
    left: float
    top: float
    width: float
    height: float
    norm: str = field(default="", init=False)
    band: int = field(default=-1, init=False)

    def __post_init__(self) -> None:
        self.norm = normal(self.text)

    @property
    def centre(self) -> tuple[float, float]:
        return self.left + self.width / 2, self.top + self.height / 2


def line_groups(words: list[Word], height: float) -> list[list[int]]:
    """Indexes of words by line, each line from left to right."""
    threshold, out, last = max(2.0, height * 0.005), [], None
    for i in sorted(range(len(words)), key=lambda i: words[i].top):
        if last is None or words[i].top - last > threshold:
            out.append([])
        out[-1].append(i)
        last = words[i].top
    return [sorted(x, key=lambda i: words[i].left) for x in out]


def column_count(rows: list[list[Cell]]) -> int:
    """The usual row length, the larger of equals."""
    return max(Counter(map(len, rows)).items(), key=lambda x: (x[1], x[0]))[0]


def column_separators(words: list[Word], lines: int, bands: int) -> list[float] | None:
    """Middles of the widest channels between bands, at the least coverage that leaves enough of them; None if none does."""
    if bands < 2 or not words:
        return None
    events: Counter = Counter()
    for w in words:
        events[w.left] += 1
        events[w.left + w.width] -= 1
    xs = sorted(events)
    chars, widths = sum(len(w.text) for w in words if w.text and w.width > 0), sum(w.width for w in words if w.text and w.width > 0)
    least = max(2.0, 0.5 * (widths / chars if chars else 8.0))
    low, high = xs[0], xs[-1]
    for most in range(max(1, math.floor(0.2 * lines)) + 1):
        channels, start, cover = [], None, 0
        for x in xs:
            cover += events[x]
            if cover <= most and start is None:
                start = x
            elif cover > most and start is not None:
                channels.append((start, x))
                start = None
        good = [(a, b) for a, b in channels if a > low and b < high and b - a >= least]
        if len(good) >= bands - 1:
            widest = sorted(good, key=lambda c: (c[0] - c[1], c[0]))[: bands - 1]
            return sorted((a + b) / 2 for a, b in widest)
    return None


class PlainPage(Page):
    """All steps of a page."""

    def __init__(self, rows: list[list[str]], words: list[Word], height: float | None):
        super().__init__([[normal(v) for v in row] for row in rows], words)
        self.height = height if height else max((w.top + w.height for w in words), default=0)

    def geometry(self) -> tuple[list[int], list[list[int]]] | None:
        """Band of each column (-1: none) and words of each row; None if the page has no such grid."""
        if not self.cells or not self.words:
            return None
        n = column_count(self.cells)
        full = [any(c < len(row) and row[c].norm for row in self.cells) for c in range(n)]
        bands = [sum(full[:c]) if f else -1 for c, f in enumerate(full)]
        if n < 2 or sum(full) < 2:
            return None
        lines = line_groups(self.words, self.height)
        separators = column_separators(self.words, len(lines), sum(full))
        if separators is None:
            return None
        for w in self.words:
            w.band = sum(s < w.centre[0] for s in separators)
        return bands, self.align(bands, lines, sum(full))

    def align(self, bands: list[int], lines: list[list[int]], n_bands: int) -> list[list[int]]:
        """Words of the lines that each row spans."""
        by_line = [["".join(self.words[i].norm for i in line if self.words[i].band == b) for b in range(n_bands)] for line in lines]
        by_row = [["".join(cell.norm for c, cell in enumerate(row) if c < len(bands) and bands[c] == b) for b in range(n_bands)] for row in self.cells]
        return [sorted(i for line in lines[span[0] : span[1]] for i in line) if span else [] for span in aligned(by_row, by_line)]

    def by_grid(self, bands: list[int], row_words: list[list[int]]) -> None:
        for r, c, cell in self.flat():
            if cell.norm and c < len(bands) and bands[c] >= 0:
                self.try_run(r, c, np.array([i for i in row_words[r] if self.words[i].band == bands[c] and not self.taken[i]], np.int64))

    def placed_share(self) -> float:
        some = [cell for _, _, cell in self.flat() if cell.norm]
        return sum(bool(c.words) for c in some) / len(some) if some else 0.0

    def look_into_empty(self) -> None:
        """Words that stand where an empty cell should be are attached to it, but not claimed."""
        spans = [x.get() for x in self.across]
        for r, c, cell in self.flat():
            if cell.status != "empty":
                continue
            down, across = self.down[r].get(), spans[c]
            if across is None:
                left = next((spans[k] for k in range(c - 1, -1, -1) if spans[k]), None)
                right = next((spans[k] for k in range(c + 1, len(spans)) if spans[k]), None)
                across = (left[1], right[0]) if left and right else None
            if down and across:
                there = self.region(across, down).tolist()
                if self.size[there].sum() >= LEAST_OVERLOOKED:
                    cell.words = there


def match_page(rows: list[list[str]], words: list[Word], height: float | None = None) -> list[list[tuple[str, list[str]]]]:
    """(status, word ids) of each cell."""
    page = PlainPage(rows, words, height)
    found = page.geometry()
    if found:
        page.by_grid(*found)
        if page.placed_share() < LEAST_PLACED:
            page, found = PlainPage(rows, words, height), None
    if not found:
        page.by_walk()
    page.by_gaps()
    page.by_region()
    page.look_into_empty()
    return [[(cell.status, [words[i].id for i in cell.words]) for cell in row] for row in page.cells]
