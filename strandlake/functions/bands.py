"""Where in a text reads may align well: its diagonals are dealt into bands, and a band that lacks a read's words holds no high score.

A word of an alignment that stands on no diagonal of its band has an error in it. Errors that stab all such words, as few as can be, bound the
score from above, so no alignment that reaches the bound asked for is lost. The bands left are scored exactly, cell by cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

from .pairwise import Scoring, _codes

#: Letters of a word, diagonals from one band's first to the next one's, and values (of reads and bands) or cells of a row worked on at once.
WORD, STRIDE, CELLS = 4, 16, 1 << 17
#: After so many letters pairs without a score are left.
LOOK = 6


def least_loss(s: Scoring) -> int:
    """What an error takes at least from an alignment that would match at each of its read's letters."""
    return min(s.match + s.mismatch, s.gap_open, s.match + s.gap_extend)


def drift(s: Scoring, loss: float) -> int:
    """How many diagonals the gaps of an alignment that loses no more than that can cross; a little more, so that bands come in few widths."""
    letters = 0 if loss < s.gap_open else 1 + int((loss - s.gap_open) // max(1, min(s.gap_open, s.gap_extend)))
    return -(-letters // 4) * 4


class Bands:
    """A text's bands for reads of up to `longest` letters. A read's letter i lies on diagonal d of a band at the text's place d + i."""

    def __init__(self, text: str, longest: int, s: Scoring):
        self.s, self.longest = s, longest
        self.n_bands = -(-(longest + len(text)) // STRIDE)
        #: places of the table's rows: those of the text, `longest` before it, and what bands reach behind it
        self.n_places = STRIDE * (self.n_bands + longest // STRIDE + 2)
        self.text = np.full(self.n_places + longest + 2 * STRIDE, -3, np.int32)
        self.text[longest : longest + len(text)] = _codes(text, s.never, 1)
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, width: int) -> np.ndarray:
        """For each word, shift within a stride and band whether none of `width` neighbouring diagonals holds the word."""
        if width not in self.tables:
            words = _words(self.text[None, : self.n_places])[0]
            held = np.zeros((4**WORD + 1, self.n_places + width), bool)
            held[words, np.arange(len(words))] = True
            held[4**WORD] = False
            reach = 1
            while reach < width:
                step = min(reach, width - reach)
                held[:, :-step] |= held[:, step:]
                reach += step
            self.tables[width] = np.ascontiguousarray(~held[:, : self.n_places].reshape(len(held), -1, STRIDE).transpose(0, 2, 1)).view(np.uint8)
        return self.tables[width]

    def over(self, reads: np.ndarray, score: np.ndarray, width: int, gain: int, loss: int, free: int, backward: bool = False, least: np.ndarray | None = None, most: int | None = None) -> tuple:
        """Places of reads (rows of letters) and bands but for those where no alignment reaches the read's `score`, if a letter gains `gain` and an error takes `loss` of it.

        Alignments begin behind at most `free` letters (backward: end before at most so many), have `least` letters of their read, if told, and none beyond the first `most` ones.
        """
        most = reads.shape[1] if most is None else min(reads.shape[1], most)
        least = np.zeros(len(reads), np.int64) if least is None else least
        found = []
        size = max(1, CELLS // self.n_bands)
        for k in range(0, len(reads), size):
            part = slice(k, k + size)
            who, where = np.nonzero(self._over(reads[part], score[part], width, gain, loss, free, backward, least[part], most))
            found.append((who + k, where))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _over(self, reads: np.ndarray, score: np.ndarray, width: int, gain: int, loss: int, free: int, backward: bool, least: np.ndarray, most: int) -> np.ndarray:
        words, n, unit = _words(reads), reads.shape[1], math.gcd(gain, loss)
        # what alignments have lost of gain * letters so far; more than an alignment of all letters may lose is as good as any more
        spare = (gain * most - score) // unit
        lost, gain, loss = int(spare.max(initial=0)) + 1, gain // unit, loss // unit
        kind = next(x for x in (np.uint8, np.int16, np.int32, np.int64) if lost + loss <= np.iinfo(x).max)
        table, dead = self._table(width), kind(lost)
        begin = lambda j: kind(gain * j) if j <= free and gain * j < lost else dead
        cap, start = np.full((len(reads), self.n_bands), dead), np.empty((len(reads), self.n_bands), kind)
        good, fresh = np.zeros(cap.shape, bool), {}

        def begun(j: int, other: np.ndarray) -> None:
            if begin(j) < dead:  # numpy takes ten times as long for the least of an array and one number
                start.fill(begin(j))
                np.minimum(other, start, out=other)

        # what an alignment that ends before a letter must have lost less than
        ends = np.arange(most + 1)[:, None]
        less = np.where(ends >= least, np.clip(spare - gain * (most - ends) + 1, 0, lost), 0).astype(kind)
        some = less.any(axis=1).tolist()
        for j in range(WORD - 1, most):
            # a word that begins behind an error or the begin can be held from now on
            first = j - WORD + 1
            if first in fresh:
                np.minimum(cap, fresh.pop(first), out=cap)
            else:
                begun(first, cap)
            if some[j]:
                np.logical_or(good, cap < less[j][:, None], out=good)
            i = n - 1 - j if backward else first
            lacking = table[:, i % STRIDE, i // STRIDE : i // STRIDE + self.n_bands][words[:, i]]
            lacking = np.multiply(lacking, dead, dtype=kind)
            erring = cap + kind(loss)
            np.maximum(cap, lacking, out=cap)
            np.subtract(dead, lacking, out=lacking)
            np.maximum(erring, lacking, out=erring)
            begun(j + 1, erring)
            fresh[j + 1] = erring
        for first in range(max(0, most - WORD + 1), most + 1):
            begun(first, cap)
            if first in fresh:
                np.minimum(cap, fresh[first], out=cap)
        return np.logical_or(good, cap < less[most][:, None], out=good)

    def best(self, reads: np.ndarray, who: np.ndarray, where: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, read place, text place) of the best cell of each pair of a read and a band, the first in the read, then in the text."""
        size = max(1, CELLS // width)
        found = [self._best(reads[who[k : k + size]], where[k : k + size], width) for k in range(0, len(who), size)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(3))

    def _rows(self, reads: np.ndarray, bands: np.ndarray, width: int, backward: bool = False) -> Iterator[tuple[int, _Rows]]:
        """The rows of scores, letter by letter, of pairs of a read and a band."""
        n = reads.shape[1]
        low = bands * STRIDE
        letters, read = self.text[np.minimum(low + np.arange(n + width)[:, None], len(self.text) - 1)], np.ascontiguousarray(reads.T)
        if max(letters.max(initial=0), read.max(initial=0)) < 128:
            letters, read = letters.astype(np.int8), read.astype(np.int8)
        rows = _Rows(letters, read, width, self.s)
        for k in range(n):
            rows.add(n - 1 - k if backward else k, backward)
            yield k, rows
            if not rows.score.shape[1]:
                return

    def _best(self, reads: np.ndarray, bands: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, at, to = (np.zeros(len(reads), np.int64) for _ in range(3))
        for i, rows in self._rows(reads, bands, width):
            np.maximum(rows.score, rows.none, out=rows.score)
            value = rows.score.max(axis=0)
            better = np.flatnonzero(value > best)
            if len(better):
                best[better], at[better], to[better] = value[better], i, rows.score[:, better].argmax(axis=0) + bands[better] * STRIDE + i - self.longest
        return best, at, to

    def anchored(self, reads: np.ndarray, who: np.ndarray, where: np.ndarray, width: int, free: int, least: np.ndarray, score: np.ndarray, backward: bool = False) -> np.ndarray:
        """Which pairs of a read and a band may hold an alignment behind at most `free` letters, with the read's `least` letters and `score` or more. Those without a score above 0 are left."""
        size, found = max(1, CELLS // width), [np.zeros(0, np.int64)]
        for k in range(0, len(who), size):
            mine = np.arange(k, min(k + size, len(who)))
            # places of the pairs that are left, and which of them have scored enough
            left, good = mine, np.zeros(len(mine), bool)
            first = int(least[who[mine]].min(initial=0))
            for j, rows in self._rows(reads[who[mine]], where[mine], width, backward):
                if j < free:
                    np.maximum(rows.score, rows.none, out=rows.score)
                if j + 1 >= first:
                    value = rows.score.max(axis=0)
                    good[left - k] |= (value >= score[who[left]]) & (j + 1 >= least[who[left]])
                if j >= free and j % LOOK == LOOK - 1:
                    alive = (rows.score > 0).any(axis=0) & ~good[left - k]
                    rows.keep(alive)
                    left = left[alive]
            found.append(mine[good])
        return np.concatenate(found)


class _Rows:
    """A row of scores for each pair: the cells of one letter, diagonal by diagonal, and of these the pairs side by side."""

    def __init__(self, letters: np.ndarray, read: np.ndarray, width: int, s: Scoring):
        self.letters, self.read, self.width, self.s, self.done = letters, read, width, s, 0
        self.kind = np.int16 if s.match * len(read) + s.gap_open + s.gap_extend * (width + len(read)) + s.mismatch < 1 << 14 else np.int32
        self.never = -(1 << 14) if self.kind == np.int16 else -(1 << 30)
        self.score = np.zeros((width, read.shape[1]), self.kind)
        self.insert = np.full_like(self.score, self.never)
        self._spare()

    def _spare(self) -> None:
        self.same, self.opened, self.gained, self.none = np.empty(self.score.shape, bool), np.empty_like(self.score), np.empty_like(self.score), np.zeros_like(self.score)

    def keep(self, pairs: np.ndarray) -> None:
        if not pairs.all():
            self.letters, self.read, self.score, self.insert = (np.ascontiguousarray(x[:, pairs]) for x in (self.letters, self.read, self.score, self.insert))
            self._spare()

    def add(self, i: int, backward: bool) -> None:
        """The row of letter i behind those before it (backward: those behind it)."""
        s, kind, row, insert, opened, width = self.s, self.kind, self.score, self.insert, self.opened, self.width
        letters = self.letters[i : i + width]
        np.subtract(row, kind(s.gap_open), out=opened)
        np.subtract(insert, kind(s.gap_extend), out=insert)
        # a letter that the text lacks leads to the diagonal before (backward: behind, so the band is turned)
        np.maximum(insert, opened, out=opened)
        insert[:-1] = opened[1:]
        insert[-1] = self.never
        np.equal(letters[::-1] if backward else letters, self.read[i], out=self.same)
        np.multiply(self.same, kind(s.match + s.mismatch), out=self.gained)
        self.gained -= kind(s.mismatch)
        row += self.gained
        np.maximum(row, insert, out=row)
        # letters that the read lacks lead to diagonals behind: runs of one, of up to two, four and so on, as long as a score can pay for
        self.done, step = self.done + 1, 1
        np.subtract(row[:-1], kind(s.gap_open), out=opened[1:])
        opened[0] = self.never
        while step < width and s.gap_open + s.gap_extend * step < s.match * self.done:
            np.subtract(opened[:-step], kind(s.gap_extend * step), out=self.gained[step:])
            np.maximum(opened[step:], self.gained[step:], out=opened[step:])
            step *= 2
        np.maximum(row, opened, out=row)


def _words(letters: np.ndarray) -> np.ndarray:
    """Numbers of the words at each place of rows of letters; words with a letter that matches nothing get 4**WORD, which no table holds."""
    count = max(0, letters.shape[1] - WORD + 1)
    out, whole = np.zeros((len(letters), count), np.int64), np.ones((len(letters), count), bool)
    for k in range(WORD):
        part = letters[:, k : k + count]
        out = out * 4 + (part >> 1 & 3)
        whole &= part >= 0
    return np.where(whole, out, 4**WORD)


def grouped(keys: Iterable[tuple]) -> Iterator[tuple[tuple, list[int]]]:
    """Each key and its places."""
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    yield from places.items()
