"""Operator 7, suffix-array dedup: bytes covered by a MATCH-byte string that starts anywhere else are removed.

Suffixes of all texts are sorted where it matters. Every MATCH-byte string picks an anchor from its own content (the
smallest hash of its GRAM-byte pieces, the first of equals), so equal strings pick equal anchors at equal distances and
only strings of one anchor need to be compared; a text falls into one segment of string starts for each anchor.

1. Anchors that occur once are done: nothing there repeats.
2. Copies are thinned out, never decided: of rows of equal text, two whole copies go on; of equal segments, two from different
   places. What is found for them holds for all.
3. The segments of an anchor go to one task, many anchors at a time, which builds their suffix array in two stages
   (suffixes smaller than their successors are sorted directly, the rest is induced by bucket scans) and compares neighbours;
   a common prefix of MATCH bytes marks both. Every byte removed comes from such neighbours, compared byte by byte.
4. An anchor whose segments exceed ARRAY_BYTES is cut further: its strings are dealt by ranges of their distance to the anchor
   and, within a range, by the bytes that all strings of the range would share, so that equal strings stay together; what then
   stands alone is done, copies are thinned out again, and ranges narrow down to single distances where need be.

Defined cases: a null text is empty; texts below MATCH bytes lose nothing; equal rows lose everything from MATCH bytes on;
long texts are walked in blocks; runs of equal bytes repeat themselves at the next byte; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small_batches, table

MATCH, GRAM = 400, 32
BLOCK, WHOLE, ARRAY_BYTES, TASK_BYTES, ROWS = 1 << 18, 1 << 17, 1 << 19, 8 << 20, 10_000
#: Distances to the anchor in a range, from one cut of a large anchor to the next.
WIDTHS = (46, 6, 1)
#: Suffixes still equal after two rounds of eight bytes are sorted as texts, so many at most.
TEXT_SORT = 50_000
SEPARATOR = b"\xff"  # no byte of UTF-8
_INDEX = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 32 bytes from each place on."""
    x = _mix(_eights(raw), 0x9E3779B97F4A7C15)
    for width, k in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        x = _mix(x[:-width] + (x[width:] ^ (x[width:] << np.uint64(7))), k)
    return x


def segments(raw: np.ndarray, match: int = MATCH) -> Iterator[tuple[int, int, int, int]]:
    """(start, count, place of the anchor, its hash): count strings from start on pick that anchor."""
    width = match - GRAM + 1
    for base in range(0, len(raw) - match + 1, BLOCK):
        own = raw[base : base + BLOCK + match - 1]
        n = len(own) - match + 1
        hashes = gram_hashes(own)
        marked = (hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64)
        # smallest of each `width` neighbours: of a block's tail and the next block's head
        padded = np.full(-(-len(marked) // width) * width, ~np.uint64(0))
        padded[: len(marked)] = marked
        grid = padded.reshape(-1, width)
        head = np.minimum.accumulate(grid, axis=1).ravel()
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & _INDEX).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        counts = np.diff(np.concatenate([starts, [n]]))
        for s, c, p, h in zip(starts.tolist(), counts.tolist(), place[starts].tolist(), hashes[place[starts]].view(np.int64).tolist(), strict=True):
            yield base + s, c, base + p, h


#: A number for each byte value, and an odd base.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9)
_BASE = 0xD1342543DE82EF95


def string_hashes(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each place up to its end: a difference of two sums, moved back by the place."""
    n = len(t)
    up = np.full(n + 1, _BASE, dtype=np.uint64)
    up[0] = 1
    up = np.cumprod(up)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[t] * up[:n], out=total[1:])
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[:1] = 1
    return _mix((total[ends] - total[:n]) * np.cumprod(down), 0x94D049BB133111EB)


def _edges(changed: np.ndarray) -> np.ndarray:
    """Where runs begin, from whether each element but the first differs from the one before."""
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def sort_directly(data: bytes, places: np.ndarray, eights: np.ndarray, hashes: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of the depth bytes from them on. Equal strings are sorted once, by one of them."""
    if not len(places):
        return places
    first, whole = eights[places], hashes[places]
    by = np.lexsort((whole, first))
    places, first, whole = places[by], first[by], whole[by]
    new = first[1:] != first[:-1]
    start = _edges(new | (whole[1:] != whole[:-1]))
    size = np.diff(np.append(start, len(places)))
    group = np.concatenate([[0], np.cumsum(new)])[start]
    del first, whole, by
    place, turn = places[start], np.arange(len(start))
    at, active = 8, np.arange(len(start))
    while True:
        own = group[active]
        tied = np.zeros(len(own), dtype=bool)
        same = own[1:] == own[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        active = active[tied]
        if not len(active) or at >= depth:
            break
        own, here = group[active], place[turn[active]]
        if at >= 24 and len(active) <= TEXT_SORT:
            # one sort for all groups: the group's number leads
            keys = [int(g).to_bytes(5, "big") + data[p + at : p + depth] for g, p in zip(own.tolist(), here.tolist(), strict=True)]
            turn[active] = turn[active][sorted(range(len(keys)), key=keys.__getitem__)]
            break
        key = eights[here + at]
        by = np.lexsort((key, own))
        key, turn[active] = key[by], turn[active][by]
        # groups fall apart, their numbers stay in order
        apart = np.concatenate([[False], (key[1:] != key[:-1]) & (own[1:] == own[:-1])])
        group = group + np.cumsum(np.bincount(active[apart], minlength=len(group)))
        at += 8
    before = np.cumsum(size[turn]) - size[turn]
    return places[np.repeat(start[turn] - before, size[turn]) + np.arange(len(places))]


def suffix_array(data: bytes, depth: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Places in the order of their suffixes, exact up to depth bytes, by two-stage sorting.

    Suffixes of equal hashes count as equal: hashes may end where nothing behind matters any more.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    padded = np.frombuffer(data + bytes(depth + 8), dtype=np.uint8)
    t, eights = padded[:n], _eights(padded)
    if hashes is None:
        hashes = string_hashes(t, np.minimum(np.arange(n) + depth, n))
    # a suffix is smaller than its successor if the next differing byte is larger; the last one is larger than the empty suffix
    step = np.diff(t.astype(np.int16))
    differs = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    following = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.zeros(n, dtype=bool)
    small[:-1] = np.append(step, np.int16(-1))[following] > 0
    del step, differs, following
    # first stage: the smaller ones
    direct = sort_directly(data, np.flatnonzero(small), eights, hashes, depth)
    del eights
    bounds = np.searchsorted(t[direct], np.arange(257))
    # second stage: a scan over the buckets puts the larger suffixes before each sorted one in place
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[-1]].append(np.array([n - 1]))
    out = []

    def before(x: np.ndarray) -> np.ndarray:
        x = x[x > 0] - 1
        return x[~small[x]]

    for c in range(256):
        fresh = np.concatenate(induced[c]) if induced[c] else np.empty(0, dtype=np.int64)
        induced[c] = []
        bucket = [fresh]
        while len(fresh):
            fresh = before(fresh)
            fresh = fresh[t[fresh] == c]
            bucket.append(fresh)
        whole = np.concatenate([*bucket, direct[bounds[c] : bounds[c + 1]]])
        if not len(whole):
            continue
        out.append(whole)
        ahead = before(whole)
        heads = t[ahead]
        ahead, heads = ahead[heads > c], heads[heads > c]
        by = np.argsort(heads, kind="stable")
        ahead, heads = ahead[by], heads[by]
        edges = np.append(_edges(heads[1:] != heads[:-1]), len(heads)) if len(heads) else np.zeros(1, dtype=np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            induced[heads[a]].append(ahead[a:b])
    return np.concatenate(out)


def common_prefixes(data: bytes, p: np.ndarray, q: np.ndarray, match: int) -> np.ndarray:
    """Whether the strings at p and q share match bytes, compared byte by byte, but once where pairs follow each other."""
    if not len(p):
        return np.zeros(0, dtype=bool)
    t = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eights = _eights(t)

    def full(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        left = np.arange(len(p))
        for k in [*range(0, match - 7, 8), match - 8]:
            left = left[eights[p[left] + k] == eights[q[left] + k]]
        out = np.zeros(len(p), dtype=bool)
        out[left] = True
        return out

    by = np.argsort(p)
    x, y = p[by], q[by]
    head = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])
    # a pair behind an equal one is equal if its last byte is; where one isn't, all are compared in full
    shared = full(x[head], y[head])[np.cumsum(head) - 1]
    if not (t[x[shared] + match - 1] == t[y[shared] + match - 1]).all():
        shared = full(x, y)
    out = np.zeros(len(p), dtype=bool)
    out[by] = shared
    return out


def repeated(pieces: list[bytes], counts: list[int], match: int = MATCH) -> list[np.ndarray]:
    """For each piece which of its first `count` places start a string of match bytes that starts elsewhere in the pieces."""
    data = SEPARATOR.join(pieces) + SEPARATOR
    lengths = np.array([len(p) + 1 for p in pieces])
    begins = np.cumsum(lengths) - lengths
    start = np.zeros(len(data), dtype=bool)
    for b, c in zip(begins.tolist(), counts, strict=True):
        start[b : b + c] = True
    # what stands behind a piece doesn't matter for it
    ends = np.minimum(np.arange(len(data)) + match, np.repeat(begins + lengths, lengths))
    hashes = string_hashes(np.frombuffer(data, dtype=np.uint8), ends)
    del ends
    order = suffix_array(data, match, hashes)
    order = order[start[order]]
    p, q = order[:-1], order[1:]
    alike = hashes[p] == hashes[q]
    p, q = p[alike], q[alike]
    shared = common_prefixes(data, p, q, match)
    marks = np.zeros(len(data), dtype=bool)
    marks[p[shared]] = True
    marks[q[shared]] = True
    return [np.flatnonzero(marks[b : b + c]) for b, c in zip(begins.tolist(), counts, strict=True)]


def spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring places as (first, count)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    first = places[np.concatenate([[0], cut])]
    last = places[np.concatenate([cut - 1, [len(places) - 1]])]
    return list(zip(first.tolist(), (last - first + 1).tolist(), strict=True))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges [a, b) joined where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key")


SPANS = "array<struct<first:long,count:long>>"
#: A segment: its place in what it is cut from, its anchor, a digest, the anchor's distance, its strings, and how many copies it stands for.
SEGMENT = "first long, anchor long, content long, lead int, count int, copies int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _columns(batch: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch[c].tolist() for c in names), strict=True)


def _expand(rows: DataFrame, read: list[str], made, schema: str, limit: int = ROWS) -> DataFrame:
    """The rows that made(row of read) yields for each row, handed on in frames of bounded length."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for row in _columns(batch, read):
                held.extend(made(*row))
                if len(held) >= limit:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        yield pd.DataFrame(held, columns=names)

    return rows.mapInPandas(run, schema)


def _digest(own: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(own, seed=seed & (1 << 64) - 1) - (1 << 63)


def repeated_runs(docs: DataFrame, match: int = MATCH, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(text_key, runs) of the texts of docs that lose bytes: runs are the byte ranges to remove."""
    keyed = small_batches(docs).select(_key(), "text").filter(F.octet_length("text") >= match)
    copied = materialize(keyed.groupBy("text_key").count().filter("count > 1").select("text_key"), "copied")
    known = broadcast_if_small(copied)
    once = materialize(keyed.join(known, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "copied-texts")
    texts = keyed.join(known, "text_key", "left_anti").unionByName(once)

    def cut(key: bytes, text: str) -> Iterator[tuple]:
        raw = _raw(text)
        for start, count, place, anchor in segments(np.frombuffer(raw, dtype=np.uint8), match):
            yield key, start, anchor, _digest(raw[start : start + count + match - 1], place - start), place - start, count, 1

    def whole(key: bytes, text: str) -> Iterator[tuple]:
        n = len(_raw(text)) - match + 1
        for start in range(0, n, WHOLE):
            yield key, start, _digest(key, start), 0, 0, min(WHOLE, n - start), 2

    keyed_segment = f"text_key binary, {SEGMENT}"
    found = _expand(texts, ["text_key", "text"], cut, keyed_segment).unionByName(_expand(once, ["text_key", "text"], whole, keyed_segment))
    sources = texts.select("text_key", F.col("text").cast("binary").alias("raw"))
    marked = _resolve(materialize(found, "segments"), sources, ["text_key"], match, array_bytes, WIDTHS)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [merged([(x["first"], x["first"] + x["count"] + match - 1) for x in s]) for s in batch["spans"]]
            yield pd.DataFrame({"text_key": batch["text_key"], "runs": [[{"a": a, "b": b} for a, b in r] for r in own]})

    return materialize(marked.mapInPandas(runs, "text_key binary, runs array<struct<a:long,b:long>>"), "runs")


def _spans(places: np.ndarray) -> list[dict]:
    return [{"first": a, "count": c} for a, c in spans(places)]


def _resolve(found: DataFrame, sources: DataFrame, keys: list[str], match: int, array_bytes: int, widths: tuple[int, ...]) -> DataFrame:
    """(keys, spans): the places of each source (keys, raw) where a repeated string of match bytes starts.

    found are the stored segments (keys, SEGMENT) of the sources. Large anchors are resolved by cutting their pieces by widths.
    """
    spark = found.sparkSession
    again = materialize(found.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = found.join(broadcast_if_small(again), "anchor", "left_semi")
    place = F.struct(*keys, "first")
    contents = found.groupBy("anchor", "content").agg(F.sum("copies").alias("n"), F.first("lead").alias("lead"), F.first("count").alias("count"), F.min(place).alias("low"), F.max(place).alias("high"))
    contents = materialize(contents, "contents")
    size = F.when(F.col("n") > 1, 2).otherwise(1) * (F.col("count") + match)
    large = contents.groupBy("anchor").agg(F.sum(size).alias("size")).filter(F.col("size") > (array_bytes if widths else 1 << 62))
    large = materialize(large.select("anchor", F.lit(True).alias("many")), "large")
    both = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
    wanted = contents.join(broadcast_if_small(large), "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    wanted = wanted.select("anchor", "content", "lead", "count", "many", F.posexplode(both).alias("copy", "at")).select("anchor", "content", "copy", "lead", "count", "many", "at.*")

    # the pieces are cut where the sources are
    asked = materialize(wanted.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "content", "copy", "lead", "first", "count", "many")).alias("asked")), "asked")
    # sources without any are left out before the others move
    known = sources.join(broadcast_if_small(asked.select(*keys)), keys, "left_semi").join(asked, keys)

    def fetch(raw: bytes, asked: list) -> Iterator[tuple]:
        for x in asked:
            yield x["anchor"], x["content"], x["copy"], x["lead"], x["count"], x["many"], raw[x["first"] : x["first"] + x["count"] + match - 1]

    pieces = materialize(_expand(known, ["raw", "asked"], fetch, "anchor long, content long, copy int, lead int, count int, many boolean, piece binary", ROWS // 8), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    marks = _sorted(pieces.filter("NOT many"), match, array_bytes, parts)
    many = pieces.filter("many")
    if widths and not large.isEmpty():
        width = widths[0]

        def cut(anchor: int, content: int, copy: int, lead: int, count: int, piece: bytes) -> Iterator[tuple]:
            i = 0
            while i < count:
                r = (lead - i) // width
                n = min(count - i, lead - i - r * width + 1)
                # what all strings of this range, here or elsewhere, have in common
                core = piece[lead - r * width : lead - (r + 1) * width + 1 + match]
                own = _digest(core, anchor * 31 + r)
                yield anchor, content, copy, i, own, _digest(piece[i : i + n + match - 1], own + lead - i), lead - i, n, 1
                i += n

        parents = ["anchor", "content", "copy"]
        renamed = many.withColumnsRenamed({k: f"{k}_0" for k in parents})
        smaller = _expand(renamed, ["anchor_0", "content_0", "copy_0", "lead", "count", "piece"], cut, f"anchor_0 long, content_0 long, copy_0 int, {SEGMENT}")
        inner = _resolve(materialize(smaller, "segments"), renamed.select("anchor_0", "content_0", "copy_0", F.col("piece").alias("raw")), [f"{k}_0" for k in parents], match, array_bytes, widths[1:])
        marks = marks.unionByName(inner.filter("copy_0 = 0").select(F.col("anchor_0").alias("anchor"), F.col("content_0").alias("content"), "spans"))
    marks = materialize(marks, "marks")
    placed = found.select(*keys, "first", "anchor", "content").join(broadcast_if_small(marks), ["anchor", "content"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [merged([(s["first"] + x["first"], s["first"] + x["first"] + x["count"]) for s in rows for x in s["spans"]]) for rows in batch["own"]]
            out = batch[keys].copy()
            out["spans"] = [[{"first": a, "count": b - a} for a, b in r] for r in own]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*keys).schema)
    return placed.groupBy(*keys).agg(F.collect_list(F.struct("first", "spans")).alias("own")).mapInPandas(join, f"{schema}, spans {SPANS}")


def _sorted(pieces: DataFrame, match: int, array_bytes: int, parts: int) -> DataFrame:
    """(anchor, content, spans) of the contents that share strings with another, or their other copy, of their anchor."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        total = 0

        def flush() -> pd.DataFrame:
            marks = repeated([h[4] for h in held], [h[3] for h in held], match)
            # two copies of a content have equal marks
            rows = [(h[0], h[1], _spans(m)) for h, m in zip(held, marks, strict=True) if len(m) and not h[2]]
            return pd.DataFrame(rows, columns=["anchor", "content", "spans"])

        for batch in batches:
            for row in _columns(batch, ["anchor", "content", "copy", "count", "piece"]):
                if total > array_bytes // 2 and row[0] != held[-1][0]:
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += len(row[4])
        if held:
            yield flush()

    dealt = pieces.select("anchor", "content", "copy", "count", "piece").repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "copy")
    return dealt.mapInPandas(sort, f"anchor long, content long, spans {SPANS}")


def remove_repeats(docs: DataFrame, match: int = MATCH, array_bytes: int = ARRAY_BYTES, with_text: bool = True) -> DataFrame:
    """(doc_id, text_left binary, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    Without with_text the bytes left are only counted and digested.
    """
    runs = repeated_runs(docs, match, array_bytes)
    rows = docs.select("doc_id", "text", _key()).join(broadcast_if_small(runs), "text_key", "left")

    def made(ids: list, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["text_left", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
        return frame

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out, size = [], [], 0
            for doc_id, text, own in zip(batch["doc_id"].array, batch["text"].array, batch["runs"].array, strict=True):
                raw, at, left = _raw(text), 0, []
                own = own if own is not None else []
                for x in own:
                    left.append(raw[at : x["a"]])
                    at = x["b"]
                kept = b"".join(left) + raw[at:]
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                out.append((kept if with_text else None, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
                size += len(kept)
                if size > TASK_BYTES:
                    yield made(ids, out)
                    ids, out, size = [], [], 0
            yield made(ids, out)

    return rows.select("doc_id", "text", "runs").mapInPandas(finish, "doc_id long, text_left binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).drop("text_left")


# Bytes as characters of Latin-1's range would need a second text; hex digits, two a byte, are cut and joined instead.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT row_id, i, md5(substr(h, 2 * i + 1, {2 * MATCH})) AS s FROM (SELECT row_id, h, unnest(range(0, length(h) // 2 - {MATCH - 1})) AS i FROM docs WHERE length(h) >= {2 * MATCH})),
again AS (SELECT row_id, i, i - lag(i) OVER (PARTITION BY row_id ORDER BY i) AS gap FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
numbered AS (SELECT row_id, i, sum(CASE WHEN gap <= {MATCH} THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY i) AS run FROM again),
runs AS (SELECT row_id, run, min(i) AS a, max(i) + {MATCH} AS b FROM numbered GROUP BY row_id, run),
kept AS (SELECT row_id, run, coalesce(lag(b) OVER w, 0) AS a, a AS b, b AS after, b - a AS gone FROM runs WINDOW w AS (PARTITION BY row_id ORDER BY run)),
joined AS (
  SELECT row_id, sum(gone)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY run) || substr(any_value(h), 2 * max(after) + 1) AS rest
  FROM kept JOIN docs USING (row_id) GROUP BY row_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN joined USING (row_id)
"""
