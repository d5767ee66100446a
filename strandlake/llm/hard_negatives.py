"""Operator 12, hard negatives of anchors among all vectors, by exact products of tiles.

Anchors and candidates are dealt into tiles by hashes of their ids; every tile of anchors meets every tile of candidates in one
group of bounded size, whatever the table's. A tile's scores are one product of int64 matrices by Strassen's recursion
(padded with zeros, seven products instead of eight a level); sums and differences of whole numbers are exact, and even an
intermediate sum that wraps at 64 bits comes back right. A tile keeps the best few of each anchor; these merge by rank, in the
first pass into positives, in the second, once these are known, into each positive's window of scores.

Work is anchors times rows, which the question asks for. Each row goes to as many groups as there are tiles of anchors.

Defined cases: a row takes no part if its id, label or vector is null, if a component is null or not finite, or if a component
reaches COMPONENT_LIMIT once multiplied (products of such could leave 64 bits); of rows that share an id the smallest by label
and vector counts; vectors of unequal lengths are padded with zeros; equal scores are ordered by id; a positive without
a negative in its window, and an anchor without a positive, have no rows; no table, no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: anchors' ids, how labels are changed and where, and what a component is multiplied with.
ANCHOR_STEP, CHANGED_STEP, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 5, 10, 30, 90
COMPONENT_LIMIT = 1 << 28
#: Rows of a tile, about, and how many columns of scores are held at once.
ANCHOR_TILE, ROW_TILE, COLUMNS = 4096, 2048, 1024
#: Sides up to this long are multiplied as they are.
LEAF = 16
_NONE = np.iinfo(np.int64).min

c = F.col


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64, by Strassen's recursion while all three sides are longer than leaf."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    (h, i), j = (x // 2 for x in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest allowed scores of each row, the largest first; of equal ones the smaller column first."""
    held = np.where(allowed, scores, _NONE)
    n = held.shape[1]
    least = np.partition(held, n - k, axis=1)[:, n - k] if n > k else np.full(len(held), _NONE)
    rows, columns = np.nonzero(allowed & (held >= least[:, None]))
    order = np.lexsort((columns, -held[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, rows)  # where each one's row begins
    first = np.arange(len(rows)) - starts < k
    return rows[first], columns[first]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of int64, padded with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, ids, labels) of the rows by ascending id, so many columns at once."""
    rows = rows.sort_by("vec_id")
    width = max((max(t["v"].combine_chunks().value_lengths().to_pylist(), default=0) for t in (anchors, rows)), default=0)
    a, b = _matrix(anchors["v"], width), _matrix(rows["v"], width).T
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    for at in range(0, len(ids), COLUMNS):
        part = slice(at, at + COLUMNS)
        yield product(a, np.ascontiguousarray(b[:, part])), ids[part], labels[part]


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([*_POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Of one tile: the best rows of each anchor's own label."""
    out = [_POSITIVE.empty_table()]
    if anchors.num_rows and rows.num_rows:
        own, own_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        for scores, ids, labels in _tiles(anchors, rows):
            at, to = best(scores, (own_labels[:, None] == labels) & (own[:, None] != ids), POSITIVES)
            out.append(pa.table([own[at], ids[to], scores[at, to]], schema=_POSITIVE))
    return pa.concat_tables(out)


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Of one tile: for each positive of each anchor, the best rows of other labels within the positive's window."""
    out = [_NEGATIVE.empty_table()]
    if anchors.num_rows and rows.num_rows:
        own, own_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        found = anchors["positives"].to_pylist()
        for scores, ids, labels in _tiles(anchors, rows):
            other = own_labels[:, None] != labels
            for k in range(POSITIVES):
                with_k = np.array([i for i, x in enumerate(found) if len(x) > k], np.int64)
                if not len(with_k):
                    continue
                positive = np.array([found[i][k]["positive_id"] for i in with_k], np.int64)
                score = np.array([found[i][k]["positive_score"] for i in with_k], np.int64)
                low, high = -((-LOW_PERCENT * score) // 100), (HIGH_PERCENT * score) // 100
                mine = scores[with_k]
                at, to = best(mine, other[with_k] & (mine >= low[:, None]) & (mine <= high[:, None]), NEGATIVES)
                out.append(pa.table([own[with_k[at]], positive[at], score[at], ids[to], mine[at, to]], schema=_NEGATIVE))
    return pa.concat_tables(out)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, labels changed where asked for, components as whole numbers."""
    own = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < COMPONENT_LIMIT, F.lit(False)))
    rows = embeddings.filter(c("vec_id").isNotNull() & c("label").isNotNull() & c("embedding").isNotNull()).filter(fits)
    label = F.when(c("vec_id") % CHANGED_STEP == 0, (c("label") + 1) % LABELS).otherwise(c("label"))
    rows = rows.select("vec_id", label.cast("bigint").alias("label"), own.cast("array<int>").alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")


def _dealt(df: DataFrame, own: str, own_tiles: int, other: str, other_tiles: int) -> DataFrame:
    """df with its own tile and a copy for every tile of the other side."""
    tile = F.pmod(F.xxhash64("vec_id"), F.lit(own_tiles)).cast("int")
    return df.withColumn(own, tile).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_tiles - 1))))


def _met(anchors: DataFrame, rows: DataFrame, tiles: tuple[int, int], job, schema: str) -> DataFrame:
    a = _dealt(anchors, "a", tiles[0], "b", tiles[1]).groupBy("a", "b")
    b = _dealt(rows, "b", tiles[1], "a", tiles[0]).groupBy("a", "b")
    return a.cogroup(b).applyInArrow(job, schema)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding)."""
    rows = materialize(vectors(embeddings), "vectors")
    anchors = rows.filter(c("vec_id") % ANCHOR_STEP == 0)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if(c("vec_id") % ANCHOR_STEP == 0)).first()
    tiles = max(1, -(-n_anchors // ANCHOR_TILE)), max(1, -(-n_rows // ROW_TILE))
    positive = "anchor_id bigint, positive_id bigint, positive_score bigint"
    near = _met(anchors, rows, tiles, _positives, positive)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("rank", rank).filter(c("rank") <= POSITIVES)
    kept = near.groupBy(c("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    known = materialize(anchors.join(kept, "vec_id"), "positives")
    found = _met(known, rows, tiles, _negatives, positive + ", negative_id bigint, negative_score bigint")
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", order).filter(c("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


ORACLE_SQL = f"""
WITH scaled AS (
  SELECT vec_id, (CASE WHEN vec_id % {CHANGED_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x) AND abs({SCALE} * x::DOUBLE) < {COMPONENT_LIMIT}, false))) = len(embedding)),
kept AS (SELECT * FROM scaled QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT, 0) AS score
  FROM kept a JOIN kept b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER negatives)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH_PERCENT} * positive_score
WINDOW negatives AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER negatives <= {NEGATIVES}"""
