"""Local alignment in memory that grows with the sequences' lengths, not with their product, and best-scoring segments."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alignment import cigar_ops

FIELDS = "score long, ref_begin long, ref_end long, read_begin long, read_end long, cigar string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_NONE = -(1 << 30)
#: Cells of a row over all pairs of a batch, and cells of a block whose directions are kept whole.
BATCH_CELLS, BLOCK_CELLS = 1 << 16, 1 << 20
#: Cells of whole matrices over all pairs that share them.
MATRIX_CELLS = 1 << 18
#: Letters of a part of a long reference.
PART = 1 << 11


@dataclass(frozen=True)
class Scoring:
    """A gap of n bases costs gap_open + (n - 1) * gap_extend. A letter of `never` matches nothing, not even itself."""

    match: int = 2
    mismatch: int = 2
    gap_open: int = 3
    gap_extend: int = 1
    never: str = "N"


def _codes(text: str, never: str, side: int) -> np.ndarray:
    """Letters as numbers; those that match nothing get one that the other side lacks."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32).copy()
    for letter in never:
        codes[codes == ord(letter)] = -side
    return codes


def _padded(texts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = text
    return out.astype(np.int8) if out.max() < 128 else out


def _best_cells(refs: np.ndarray, reads: np.ndarray, s: Scoring, anchored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, read place, ref place) of each pair's best cell, the first in the read, then in the reference; one row is held at a time.

    anchored: alignments begin at the first letters of both sides; else anywhere. Short texts are scored in 16 bits. Reads are filled up with -4 and
    come longest first: those that have ended leave the rows.
    """
    n_pairs, n = refs.shape
    left = (reads != -4).sum(axis=0).tolist()
    # the highest score, and the slope of a gap along a whole row
    most = s.match * min(n, reads.shape[1]) + s.gap_extend * (n + 2) + s.gap_open + s.mismatch
    kind, none = (np.int16, -(1 << 14)) if most < 1 << 14 and not anchored else (np.int32, _NONE)
    slope = (s.gap_extend * np.arange(n + 1)).astype(kind)
    row = np.full((n_pairs, n + 1), none if anchored else 0, kind)
    row[:, 0] = 0
    insert = np.full((n_pairs, n + 1), none, kind)
    falling = slope + kind(s.gap_open)
    fresh, spare = np.empty_like(row), np.empty_like(row)
    same = np.empty(refs.shape, bool)
    best, at, to = (np.zeros(n_pairs, np.int64) for _ in range(3))
    every = np.arange(n_pairs)
    gain, cost, opened, extended, floor = kind(s.match + s.mismatch), kind(s.mismatch), kind(s.gap_open), kind(s.gap_extend), kind(none if anchored else 0)
    for i, k in enumerate(left):
        if k < len(row):
            row, fresh, spare, insert, same, refs, every = row[:k], fresh[:k], spare[:k], insert[:k], same[:k], refs[:k], every[:k]
        np.subtract(insert, extended, out=insert)
        np.subtract(row, opened, out=spare)
        np.maximum(insert, spare, out=insert)
        np.equal(refs, reads[:k, i : i + 1], out=same)
        inner = fresh[:, 1:]
        np.multiply(same, gain, out=inner)
        inner -= cost
        inner += row[:, :-1]
        np.maximum(inner, insert[:, 1:], out=inner)
        fresh[:, 0] = floor
        np.maximum(fresh, floor, out=fresh)
        # the best place to open a gap along the row is a running maximum, once the slope of its cost is taken out
        np.add(fresh, slope, out=spare)
        np.maximum.accumulate(spare, axis=1, out=spare)
        spare -= falling
        np.maximum(inner, spare[:, :-1], out=inner)
        row, fresh = fresh, row
        place = row.argmax(axis=1)
        value = row[every, place]
        better = np.flatnonzero(value > best[:k])
        best[better], at[better], to[better] = value[better], i, place[better] - 1
    return best, at, to


def _edge(ref: np.ndarray, read: np.ndarray, s: Scoring, opened: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the whole read against every prefix of ref: the best score, and the best one that ends within an insertion.

    opened: what opening an insertion costs at the very first column.
    """
    n = len(ref)
    slope = s.gap_extend * np.arange(n + 1, dtype=np.int64)
    extra = s.gap_open - s.gap_extend
    row = -extra - slope
    row[0] = 0
    insert = np.full(n + 1, 4 * _NONE, np.int64)
    for i, letter in enumerate(read):
        first = -opened - s.gap_extend * i if i == 0 else insert[0] - s.gap_extend
        insert = np.maximum(insert - s.gap_extend, row - s.gap_open)
        insert[0] = first
        fresh = insert.copy()
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(ref == letter, s.match, -s.mismatch))
        fresh[1:] = np.maximum(fresh[1:], np.maximum.accumulate(fresh + slope)[:-1] - s.gap_open - slope[:-1])
        row = fresh
    return row, insert


def _matrices(refs: np.ndarray, reads: np.ndarray, s: Scoring, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, insert, delete) of all of each read's first letters against all of its reference's, by letters of the read, pairs and letters of the reference."""
    m, n = reads.shape[1], refs.shape[1]
    slope = s.gap_extend * np.arange(n + 1, dtype=np.int64)
    best, insert, delete = (np.full((m + 1, len(refs), n + 1), 4 * _NONE, np.int64) for _ in range(3))
    best[0, :, 0] = 0
    delete[0, :, 1:] = -s.gap_open - slope[:-1]
    best[0, :, 1:] = delete[0, :, 1:]
    for i in range(1, m + 1):
        insert[i] = np.maximum(insert[i - 1] - s.gap_extend, best[i - 1] - s.gap_open)
        insert[i, :, 0] = -head - s.gap_extend * (i - 1)
        row = best[i]
        row[:, 0] = insert[i, :, 0]
        row[:, 1:] = np.maximum(best[i - 1, :, :-1] + np.where(refs == reads[:, i - 1 : i], s.match, -s.mismatch), insert[i, :, 1:])
        delete[i, :, 1:] = np.maximum.accumulate(row + slope, axis=1)[:, :-1] - s.gap_open - slope[:-1]
        row[:, 1:] = np.maximum(row[:, 1:], delete[i, :, 1:])
    return best, insert, delete


def _walked(matrices: tuple[np.ndarray, np.ndarray, np.ndarray], pair: int, ref: np.ndarray, read: np.ndarray, s: Scoring, tail: int) -> list[tuple[int, str]]:
    """The operations of a best alignment of all of ref to all of read, from a pair's matrices, which may reach further."""
    best, insert, delete = (x[:, pair] for x in matrices)
    i, j, ops = len(read), len(ref), []
    # an insertion that goes on behind this block was opened there
    state = "I" if i and insert[i, j] + s.gap_open - tail > best[i, j] else "M"
    while i or j:
        if state == "M":
            if i and j and best[i, j] == best[i - 1, j - 1] + (s.match if read[i - 1] == ref[j - 1] else -s.mismatch):
                ops.append((1, "M"))
                i, j = i - 1, j - 1
            else:
                state = "I" if i and best[i, j] == insert[i, j] else "D"
        elif state == "I":
            ops.append((1, "I"))
            goes_on = i > 1 and (j == 0 or insert[i, j] == insert[i - 1, j] - s.gap_extend)
            i, state = i - 1, "I" if goes_on else "M"
        else:
            ops.append((1, "D"))
            goes_on = j > 1 and (i == 0 or delete[i, j] == delete[i, j - 1] - s.gap_extend)
            j, state = j - 1, "D" if goes_on else "M"
    return ops[::-1]


def _directions(ref: np.ndarray, read: np.ndarray, s: Scoring, head: int, tail: int) -> list[tuple[int, str]]:
    """The operations of a best alignment of all of ref to all of read, from whole matrices of a bounded block."""
    return _walked(_matrices(ref[None], read[None], s, head), 0, ref, read, s, tail)


def _all_directions(pairs: list[tuple[np.ndarray, np.ndarray]], s: Scoring) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """Each small pair's place and the operations of its best alignment, all letters to all: pairs of like size share matrices of bounded size."""
    sizes = [(len(ref) + 1, len(read) + 1) for ref, read in pairs]
    left = sorted(range(len(pairs)), key=lambda k: sizes[k])
    while left:
        mine, wide, high = [], 0, 0
        while left:
            n, m = sizes[left[-1]]
            if mine and (len(mine) + 1) * max(wide, n) * max(high, m) > MATRIX_CELLS:
                break
            mine.append(left.pop())
            wide, high = max(wide, n), max(high, m)
        matrices = _matrices(_padded([pairs[k][0] for k in mine], -3), _padded([pairs[k][1] for k in mine], -4), s, s.gap_open)
        yield from ((k, _walked(matrices, x, *pairs[k], s, s.gap_open)) for x, k in enumerate(mine))


def _whole(ref: np.ndarray, read: np.ndarray, s: Scoring, head: int, tail: int, block: int) -> list[tuple[int, str]]:
    """Operations of a best alignment of all of ref to all of read: halves of the read meet where both sides' scores sum highest.

    head, tail: what opening an insertion costs at either end, less than usual if it goes on beyond.
    """
    m, n = len(read), len(ref)
    if m < 2 or (m + 1) * (n + 1) <= block:
        return _directions(ref, read, s, head, tail)
    half = m // 2
    down, down_gap = _edge(ref, read[:half], s, head)
    up, up_gap = _edge(ref[::-1], read[half:][::-1], s, tail)
    through = down + up[::-1]
    joined = down_gap + up_gap[::-1] + s.gap_open - s.gap_extend
    j, k = int(through.argmax()), int(joined.argmax())
    if through[j] >= joined[k]:
        return _whole(ref[:j], read[:half], s, head, s.gap_open, block) + _whole(ref[j:], read[half:], s, s.gap_open, tail, block)
    # an insertion crosses the middle: it is opened once
    left = _whole(ref[:k], read[: half - 1], s, head, s.gap_extend, block)
    right = _whole(ref[k:], read[half + 1 :], s, s.gap_extend, tail, block)
    return [*left, (2, "I"), *right]


def _cigar(ops: Sequence[tuple[int, str]]) -> str:
    runs: list[list] = []
    for size, op in ops:
        if runs and runs[-1][1] == op:
            runs[-1][0] += size
        else:
            runs.append([size, op])
    return "".join(f"{size}{op}" for size, op in runs)


def _batches(refs: Sequence[np.ndarray], reads: Sequence[np.ndarray]) -> Iterator[list[int]]:
    """Places of pairs without an empty side, the longest read first: references of like size together, so filling up costs less than half as much again."""
    kin = lambda i: int(2 * math.log2(len(refs[i])))
    there = sorted((i for i in range(len(refs)) if len(refs[i]) and len(reads[i])), key=lambda i: (kin(i), -len(reads[i])))
    for _, group in groupby(there, key=kin):
        mine = list(group)
        size = max(1, BATCH_CELLS // (max(len(refs[i]) for i in mine) + 1))
        yield from (mine[k : k + size] for k in range(0, len(mine), size))


def _coded(refs: Sequence[str], reads: Sequence[str], s: Scoring) -> tuple[list[np.ndarray], list[np.ndarray]]:
    held = {x: _codes(x, s.never, 1) for x in set(refs)}
    return [held[x] for x in refs], [_codes(x, s.never, 2) for x in reads]


def _reach(read_end: int, s: Scoring) -> int:
    """How many letters of a reference an alignment of a read's first letters can take: a gap costs no more than the matches before it earn."""
    return read_end + 2 + max(0, s.match * (read_end + 1) - s.gap_open) // max(1, s.gap_extend)


def best_ends(refs: Sequence[str], reads: Sequence[str], s: Scoring = Scoring(), part: int = PART) -> list[tuple[int, int, int]]:  # noqa: B008
    """(score, read end, ref end) of the best local alignment of each pair, 0s without any match; no alignment is traced.

    Long references are looked at in parts, with what an alignment can take before each.
    """
    out = [(0, 0, 0)] * len(refs)
    a, b = _coded(refs, reads, s)
    owner, begins = [], []
    for i, (ref, read) in enumerate(zip(a, b, strict=True)):
        own = range(0, len(ref), part) if len(ref) > 2 * part else (0,)
        owner += [i] * len(own)
        begins += [max(0, x - _reach(len(read), s)) for x in own]
    pieces = [a[i][x : x + part + _reach(len(b[i]), s)] if len(a[i]) > 2 * part else a[i] for i, x in zip(owner, begins, strict=True)]
    for mine in _batches(pieces, [b[i] for i in owner]):
        found = _best_cells(_padded([pieces[k] for k in mine], -3), _padded([b[owner[k]] for k in mine], -4), s, False)
        for k, score, at, to in zip(mine, *(x.tolist() for x in found), strict=True):
            i, to = owner[k], to + begins[k]
            if score and (-score, at, to) < (-out[i][0], *out[i][1:]):
                out[i] = (score, at, to)
    return out


def traced(refs: Sequence[str], reads: Sequence[str], ends: Sequence[tuple[int, int, int]], s: Scoring = Scoring(), block: int = BLOCK_CELLS) -> list[tuple]:  # noqa: B008
    """FIELDS of the best local alignments of pairs whose best_ends are known."""
    out: list[tuple] = [(0, None, None, None, None, "")] * len(refs)
    a, b = _coded(refs, reads, s)
    whole, small = [i for i, (score, _, _) in enumerate(ends) if score > 0], []
    back_refs, back_reads = [a[i][: ends[i][2] + 1][::-1][: _reach(ends[i][1], s)] for i in whole], [b[i][: ends[i][1] + 1][::-1] for i in whole]
    for mine in _batches(back_refs, back_reads):
        _, back_at, back_to = _best_cells(_padded([back_refs[k] for k in mine], -3), _padded([back_reads[k] for k in mine], -4), s, True)
        for k, i, j in zip((whole[k] for k in mine), back_at, back_to, strict=True):
            score, at, to = ends[k]
            ref_begin, read_begin = int(to - j), int(at - i)
            ref, read = a[k][ref_begin : to + 1], b[k][read_begin : at + 1]
            plain = len(ref) == len(read) and int(np.where(ref == read, s.match, -s.mismatch).sum()) == score
            if plain:
                cigar = f"{len(read)}M"
            elif (len(ref) + 1) * (len(read) + 1) <= min(block, MATRIX_CELLS // 8):
                small.append((k, ref, read))
                cigar = ""
            else:
                cigar = _cigar(_whole(ref, read, s, s.gap_open, s.gap_open, block))
            out[k] = (score, ref_begin, to, read_begin, at, cigar)
    for x, ops in _all_directions([(ref, read) for _, ref, read in small], s):
        k = small[x][0]
        out[k] = (*out[k][:-1], _cigar(ops))
    return out


def align_all(refs: Sequence[str], reads: Sequence[str], s: Scoring = Scoring(), block: int = BLOCK_CELLS) -> list[tuple]:  # noqa: B008
    """FIELDS of the best local alignment of each pair; ends are inclusive, from 0.

    Of equally good ends the first in the read, then in the reference, counts; of the beginnings for it, the one nearest in the read, then in the
    reference. Without any match: score 0, an empty CIGAR and null places. Pairs of like size share a batch; a batch holds some rows of scores.
    """
    return traced(refs, reads, best_ends(refs, reads, s), s, block)


def smith_waterman(ref: str, read: str, match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1) -> tuple:
    return align_all([ref], [read], Scoring(match, mismatch, gap_open, gap_extend, never=""))[0]


def local_alignment(ref: Column, read: Column, match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1, never: str = "") -> Column:
    """A struct of FIELDS for each pair of sequences; all fields are null where one of them is."""
    scoring = Scoring(match, mismatch, gap_open, gap_extend, never)

    def align(refs: pd.Series, reads: pd.Series) -> pd.DataFrame:
        there = (refs.notna() & reads.notna()).to_numpy()
        found = iter(align_all(list(refs[there]), list(reads[there]), scoring))
        out = pd.DataFrame([next(found) if x else (None,) * 6 for x in there], columns=_NAMES)
        return out.astype({c: "Int64" for c in _NAMES[:-1]})

    # called nondeterministic so that a filter on the result doesn't align once more, before the rows are dealt out
    return F.pandas_udf(align, FIELDS).asNondeterministic()(ref, read)


def local_score(ref: Column, read: Column, match: int = 2, mismatch: int = 2, gap_open: int = 3, gap_extend: int = 1, never: str = "") -> Column:
    """The score of local_alignment by itself, null where a sequence is: no alignment is traced."""
    scoring = Scoring(match, mismatch, gap_open, gap_extend, never)

    def score(refs: pd.Series, reads: pd.Series) -> pd.Series:
        there = (refs.notna() & reads.notna()).to_numpy()
        found = iter(best_ends(list(refs[there]), list(reads[there]), scoring))
        return pd.Series([next(found)[0] if x else None for x in there], dtype="Int64")

    return F.pandas_udf(score, "long").asNondeterministic()(ref, read)


def best_cigar_score(cigar: Column, match: int = 2, mismatch: int = -4, gap: int = -6) -> Column:
    """The highest sum of neighbouring operations: = and M by match, X by mismatch a base, each I or D by gap; never below 0."""
    worth = lambda x: F.when(x["op"].isin("=", "M"), x["len"] * match).when(x["op"] == "X", x["len"] * mismatch).when(x["op"].isin("I", "D"), gap).otherwise(0)
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        here = F.greatest(s["here"] + worth(x), F.lit(0))
        return F.struct(here.alias("here"), F.greatest(s["best"], here).alias("best"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["best"])
