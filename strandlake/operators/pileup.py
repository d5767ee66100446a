"""What alignments show at each place: bases, gaps and segment ends, and depths side by side.

Alignments are shuffled as runs, cut at tiles of places, and sorted by tile; bases are numpy arrays behind the shuffle, of one tile at a time, and never rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.storage import dealt_for_sorting

c = F.col
#: Places of a tile, and into how many parts a tile's runs are dealt for counting.
TILE, SALTS = 1 << 12, 8
#: Places of a tile whose runs are held together for their columns, places of a row of counts, and bases that are laid out at once.
COLUMN_TILE, ROW, AT_ONCE = 1 << 8, 1 << 6, 1 << 20
#: Code points of a deleted base, and of one beyond the end of its read.
_GAP, _BEYOND = ord("*"), 0x110000
_OPS = re.compile(r"(\d+)([MIDNSHP=X])", re.ASCII)


@lru_cache(1 << 16)
def _walked(cigar: str) -> tuple[tuple, ...]:
    """(is_match, len, ref, read, begins, ends, next, next_len) of a CIGAR's runs that lie on the reference, as alignment.walk has them."""
    ops = [(int(n), op) for n, op in _OPS.findall(cigar)]
    # what lies before the first and behind the last operation parts segments as clips do
    around = ["S", *(op for _, op in ops), "S", "S"]
    out, ref, read = [], 0, 0
    for k, (n, op) in enumerate(ops):
        match = op in "M=X"
        after, second = around[k + 2], around[k + 3]
        indel = after in "ID"
        if n > 0 and (match or op == "D"):
            ends = after in "SNH" or (indel and second in "SNH")
            out.append((match, n, ref, read, match and around[k] in "SNH", match and ends, after if match and indel else None, ops[k + 1][0] if match and indel else 0))
        ref += n * (match or op in "DN")
        read += n * (match or op in "IS")
    return tuple(out)


def _substrings(texts: pa.Array, row: np.ndarray, offset: np.ndarray, length: np.ndarray, given: np.ndarray) -> pa.Array:
    """The letters of texts[row] from offset on, at most length; null where not given or the text is."""
    given = given & texts.is_valid().to_numpy(zero_copy_only=False)[row]
    size = _numbers(pc.binary_length(texts)).astype(np.int64)
    if not np.array_equal(size, _numbers(pc.utf8_length(texts))):
        own = texts.to_pylist()
        return pa.array([own[r][o : o + n] if g else None for r, o, n, g in zip(row, offset, length, given, strict=True)], pa.string())
    n = np.where(given, np.clip(size[row] - offset, 0, length), 0)
    ends = np.cumsum(n)
    begins = (np.cumsum(size) - size)[row] + offset
    text = np.frombuffer("".join(pc.fill_null(texts, "").to_pylist()).encode(), np.uint8)
    values = text[np.arange(n.sum()) + np.repeat(begins - (ends - n), n)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(values), pa.py_buffer(np.packbits(given, bitorder="little")))


def runs(records: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, ref_id, tile, start, len, bases, begins, ends, next, next_len) of records (keys, ref_id, pos, cigar, seq): runs of bases, and of deletions
    with null bases, cut where a tile ends; what is said of a last base stays with the last piece. Each CIGAR of a batch is walked once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch["pos"].is_valid(), batch["cigar"].is_valid()))
            cigars = batch["cigar"].dictionary_encode()
            code, told = _numbers(cigars.indices).astype(np.int64), [_walked(x) for x in cigars.dictionary.to_pylist()]
            n_runs = np.array([len(x) for x in told], np.int64)
            parts = [x for runs_ in told for x in runs_]
            if not parts:
                continue
            match, length, ref, read, begins, ends, after, size = (np.array(x) for x in zip(*parts, strict=True))
            n = n_runs[code]
            row = np.repeat(np.arange(len(n)), n)
            run = np.arange(len(row)) + np.repeat((np.cumsum(n_runs) - n_runs)[code] - (np.cumsum(n) - n), n)
            first = _numbers(batch["pos"]).astype(np.int64)[row] + ref[run]
            last = first + length[run] - 1
            n = last // tile - first // tile + 1
            own = np.repeat(np.arange(len(row)), n)
            at = np.arange(len(own)) + np.repeat(first // tile - (np.cumsum(n) - n), n)
            row, run, first, last = row[own], run[own], first[own], last[own]
            start, end = np.maximum(first, at * tile), np.minimum(last, (at + 1) * tile - 1)
            whole = end == last
            bases = _substrings(batch["seq"], row, read[run] + start - first, end - start + 1, match[run])
            said = {
                "tile": at, "start": start, "len": (end - start + 1).astype(np.int32), "bases": bases, "begins": begins[run] & (start == first), "ends": ends[run] & whole,
                "next": pa.array(after[run], pa.string(), mask=~whole), "next_len": np.where(whole, size[run], 0).astype(np.int32),
            }
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch[x].take(taken) for x in kept], *[x if isinstance(x, pa.Array) else pa.array(x) for x in said.values()]], names=[*kept, *said])

    kept = [*keys, "ref_id"]
    more = T.StructType.fromDDL("tile long, start long, len int, bases string, begins boolean, ends boolean, next string, next_len int")
    return records.select(*kept, "pos", c("cigar").cast("string"), c("seq").cast("string")).mapInArrow(cut, T.StructType([*[records.schema[x] for x in kept], *more]))


def _numbers(column: pa.Array, null: int | bool = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before in some column; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        codes = pc.dictionary_encode(x, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of sorted batches, each of one (ref_id, tile), the first two columns, and whether a piece begins a tile."""
    own = None
    for batch in batches:
        if batch.num_rows:
            cuts = [*np.flatnonzero(_changes(batch.columns[:2])), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                piece = batch.slice(low, high - low)
                before, own = own, (piece.column(0)[0].as_py(), piece.column(1)[0].as_py())
                yield own != before, piece


class _Bases:
    """The bases of a piece's runs, by run and place."""

    def __init__(self, piece: pa.RecordBatch):
        bases = piece["bases"].cast(pa.large_string())
        self.start, self.length = _numbers(piece["start"]), _numbers(piece["len"])
        self.text = np.frombuffer("".join(pc.fill_null(bases, "").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.held = _numbers(pc.utf8_length(bases)).astype(np.int64)
        self.offset, self.given = np.cumsum(self.held) - self.held, bases.is_valid().to_numpy(zero_copy_only=False)

    def laid_out(self, runs: slice, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, place, letter, last) of each base of some runs from place low to high, exclusive, run by run; last tells a run's own last base."""
        start, length = self.start[runs], self.length[runs]
        first = np.maximum(start, low)
        n = np.maximum(np.minimum(start + length, high) - first, 0)
        run = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(run)) + np.repeat(first - (np.cumsum(n) - n), n)
        k = place - start[run]
        letter = np.where(self.given[runs], _BEYOND, _GAP).astype(np.uint32)[run]
        own = np.flatnonzero(k < self.held[runs][run])
        letter[own] = self.text[self.offset[runs][run[own]] + k[own]]
        return run + (runs.start or 0), place, letter, k == length[run] - 1


def base_counts(records: DataFrame, keys: list[str], letters: str = "ACGTN") -> DataFrame:
    """(ref_id, pos, depth, <letters>, deleted, begins, ends, insertions, deletions) of every covered place; depth counts bases, not deletions.

    A tile's runs are dealt into SALTS parts and counted there, so a place that everything covers is no single task's. A task holds the counts of one tile.
    """
    salt = F.pmod(F.xxhash64(*keys, "pos"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = runs(records.select(salt, "ref_id", "pos", "cigar", "seq"), ["salt"]).select("ref_id", "tile", "salt", "start", "len", "bases", "begins", "ends", "next").repartition("ref_id", "tile", "salt")
    names = [*letters, "deleted", "depth", "begins", "ends", "insertions", "deletions"]
    kinds = {ord(x): k for k, x in enumerate(letters)} | {_GAP: len(letters)}
    kind_of = np.full(max(kinds) + 2, len(kinds))
    kind_of[list(kinds)] = list(kinds.values())

    def add(counts: np.ndarray, piece: pa.RecordBatch, first: int) -> None:
        bases, n = _Bases(piece), len(kinds) + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(bases.length) // AT_ONCE, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], piece.num_rows], strict=True):
            _, place, letter, _ = bases.laid_out(slice(low, high), first, first + TILE)
            met = np.bincount(kind_of[np.minimum(letter, len(kind_of) - 1)] * TILE + (place - first), minlength=n * TILE).reshape(n, TILE)
            counts[: n - 1] += met[:-1]
            counts[n - 1] += met.sum(axis=0) - met[n - 2]
        last = bases.start + bases.length - 1
        gap = {x: _numbers(pc.equal(piece["next"], x), False) for x in "ID"}
        for k, places in enumerate([bases.start[_numbers(piece["begins"], False)], last[_numbers(piece["ends"], False)], last[gap["I"]], last[gap["D"]]], n):
            counts[k] += np.bincount(places - first, minlength=TILE)

    def told(ref: pa.Array, first: int, counts: np.ndarray) -> pa.RecordBatch:
        rows = counts.reshape(len(names), -1, ROW)
        some = np.flatnonzero(rows[len(letters) : len(letters) + 2].any(axis=(0, 2)))
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * ROW)
        held = [pa.ListArray.from_arrays(offsets, pa.array(own[some].reshape(-1))) for own in rows]
        return pa.RecordBatch.from_arrays([ref.take(pa.array(np.zeros(len(some), np.int64))), pa.array(first + some * ROW), *held], names=["ref_id", "first", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for begins, piece in _tiles(batches):
            if begins:
                if held:
                    yield told(*held)
                held = piece["ref_id"].slice(0, 1), piece["tile"][0].as_py() * TILE, np.zeros((len(names), TILE), np.int64)
            add(held[2], piece, held[1])
        if held:
            yield told(*held)

    schema = T.StructType([records.schema["ref_id"], T.StructField("first", T.LongType()), *[T.StructField(x, T.ArrayType(T.LongType())) for x in names]])
    rows = dealt.sortWithinPartitions("ref_id", "tile").mapInArrow(count, schema)
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("depth") - 1)).alias("i")).select("ref_id", (c("first") + c("i")).alias("pos"), *[F.get(x, c("i")).alias(x) for x in names])
    order = ["depth", *letters, "deleted", "begins", "ends", "insertions", "deletions"]
    return places.filter("depth + deleted > 0").groupBy("ref_id", "pos").agg(*[F.sum(x).alias(x) for x in order])


def _columns(piece: pa.RecordBatch, keys: list[str], first: int) -> Iterator[pa.RecordBatch]:
    """(ref_id, pos, depth, column) from a tile's runs in the order of keys; as many places are laid out together as AT_ONCE bases cover, one at least."""
    bases = _Bases(piece)
    steps = np.bincount(np.concatenate([bases.start, bases.start + bases.length]) - first, np.repeat([1, -1], piece.num_rows), COLUMN_TILE + 1)
    covered = np.cumsum(np.cumsum(steps)[:COLUMN_TILE])
    record = np.cumsum(_changes([piece[x] for x in keys]))
    begins, ends, size = _numbers(piece["begins"], False), _numbers(piece["ends"], False), _numbers(piece["next_len"]).astype(np.int64)
    gap = np.select([_numbers(pc.equal(piece["next"], x), False) for x in "ID"], [1, 2], 0)
    low = 0
    while low < COLUMN_TILE:
        high = max(low + 1, int(np.searchsorted(covered, (covered[low - 1] if low else 0) + AT_ONCE, "right")))
        run, place, letter, last = bases.laid_out(slice(None), first + low, first + high)
        # what a base shows goes into one number: its letter, whether it begins and ends a segment, the gap behind it and that gap's size
        after = np.where(last, gap[run], 0)
        shown = (((letter.astype(np.int64) * 2 + (begins[run] & (place == bases.start[run]))) * 2 + (ends[run] & last)) * 3 + after << 31) + np.where(after > 0, size[run], 0)
        code, kinds = pd.factorize(shown)
        texts = [_shown(int(x)) for x in kinds]
        at = (place - first - low).astype(np.uint16)
        by = np.argsort(at, kind="stable")
        if np.any((np.diff(at[by]) == 0) & (np.diff(record[run[by]]) == 0)):
            ranks = np.empty(len(texts), np.int64)
            ranks[sorted(range(len(texts)), key=lambda k: texts[k].encode())] = np.arange(len(texts))
            by = np.lexsort((ranks[code], record[run], at))
        depth = np.bincount(at, minlength=high - low)
        some = np.flatnonzero(depth)
        offsets = np.concatenate([[0], np.cumsum(depth[some])]).astype(np.int32)
        column = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(texts, pa.string()).take(pa.array(code[by]))), "")
        ref = piece["ref_id"].take(pa.array(np.zeros(len(some), np.int64)))
        yield pa.RecordBatch.from_arrays([ref, pa.array(first + low + some), pa.array(depth[some]), column], names=["ref_id", "pos", "depth", "column"])
        low = high


def _shown(x: int) -> str:
    x, size = x >> 31, x & (1 << 31) - 1
    x, after = divmod(x, 3)
    letter, ends = divmod(x, 2)
    letter, begins = divmod(letter, 2)
    return ("^" if begins else "") + ("" if letter == _BEYOND else chr(letter)) + ("", f"+{size}", f"-{size}")[after] + ("$" if ends else "")


def pileup(records: DataFrame, keys: list[str]) -> DataFrame:
    """(ref_id, pos, depth, column): the bases at each place in the order of keys, `*` for a deletion; `^` leads a segment's first base, `$` follows its last,
    `+n` and `-n` follow the last base before an insertion or a deletion of n bases. A place's column is as long as its depth; a task holds the runs of one tile."""
    # a record has some runs of its own
    dealt = dealt_for_sorting(runs(records, keys, COLUMN_TILE), 4 * records.count(), "ref_id", "tile").select("ref_id", "tile", *keys, "start", "len", "bases", "begins", "ends", "next", "next_len")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for begins, piece in _tiles(batches):
            if begins and held:
                yield from _columns(pa.concat_batches(held), keys, held[0]["tile"][0].as_py() * COLUMN_TILE)
                held = []
            held.append(piece)
        if held:
            yield from _columns(pa.concat_batches(held), keys, held[0]["tile"][0].as_py() * COLUMN_TILE)

    schema = T.StructType([records.schema["ref_id"], T.StructField("pos", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("column", T.StringType())])
    return dealt.sortWithinPartitions("ref_id", "tile", *keys).mapInArrow(show, schema)


def depths(intervals: DataFrame, key: str, start: str, end: str, sample: str, samples: list, tile: int = TILE) -> DataFrame:
    """(key, pos, depth_<sample>, ...) of every place that half-open intervals of some sample cover: changes are summed a place, run up inside tiles and
    spread over the places at the end."""
    cut = intervals.filter(c(start) < c(end)).withColumn("_tile", F.explode(F.sequence(F.floor(c(start) / tile), F.floor((c(end) - 1) / tile))))
    low, high = F.greatest(c(start), c("_tile") * tile), F.least(c(end), (c("_tile") + 1) * tile)
    steps = cut.select(key, "_tile", sample, F.explode(F.array(F.struct(low.alias("pos"), F.lit(1).alias("d")), F.struct(high.alias("pos"), F.lit(-1).alias("d")))).alias("_step")).select(key, "_tile", sample, "_step.*")
    change = [F.sum(F.when(c(sample) == x, c("d")).otherwise(0)).alias(f"depth_{x}") for x in samples]
    summed = steps.groupBy(key, "_tile", "pos").agg(*change)
    order = Window.partitionBy(key, "_tile").orderBy("pos")
    names = [f"depth_{x}" for x in samples]
    run: dict[str, Column] = {n: F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) for n in names}
    held = summed.withColumns(run | {"_next": F.lead("pos").over(order)}).filter(sum((c(n) for n in names), F.lit(0)) > 0)
    return held.select(key, F.explode(F.sequence("pos", c("_next") - 1)).alias("pos"), *names)
