"""Bases and gaps at each place, and reads against special references by their seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import annotation, pileup
from strandlake.storage import materialize

from .catalogue import query
from .event_queries import _HITS, _regions
from .mapping_queries import _PLACE, _library, _orphans, _references
from .pair_queries import _P
from .views import pairs

c = F.col
#: A read's bases go round A, C, G and T from its name on; its length follows from its CIGAR.
_LENGTH = "lead_clip + frag_len + 9 + trail_clip"
_RUNS = f"""{_P}, s AS (SELECT *, substr(repeat('ACGT', 60), CAST(name % 4 AS INT) + 1, {_LENGTH}) AS seq FROM p),
runs AS (SELECT name, line, ref_id, pos AS first, frag_len AS len, lead_clip AS off, true AS begins, false AS ends, CASE WHEN n_del > 0 THEN 'D' ELSE 'I' END AS next, CASE WHEN n_del > 0 THEN n_del ELSE 2 END AS n, seq FROM s
  UNION ALL SELECT name, line, ref_id, pos + frag_len, n_del, NULL, false, false, NULL, 0, NULL FROM s
  UNION ALL SELECT name, line, ref_id, pos + frag_len + n_del, 7, lead_clip + frag_len + 2, false, true, NULL, 0, seq FROM s),
places AS (SELECT *, first + i AS pos, coalesce(substr(seq, off + i + 1, 1), '*') AS base, i = len - 1 AS at_end, i = 0 AS at_begin FROM (SELECT *, unnest(range(0, len)) AS i FROM runs))"""


def _records(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("seq", F.expr(f"substr(repeat('ACGT', 60), CAST(name % 4 AS INT) + 1, {_LENGTH})"))


@query(f"""WITH {_RUNS} SELECT ref_id, pos, count(*) FILTER (base = 'A') AS "A", count(*) FILTER (base = 'C') AS "C", count(*) FILTER (base = 'G') AS "G", count(*) FILTER (base = 'T') AS "T", count(*) FILTER (base <> '*') AS depth,
  count(*) FILTER (base = '*') AS deleted, count(*) FILTER (begins AND at_begin) AS begins, count(*) FILTER (ends AND at_end) AS ends, count(*) FILTER (next = 'I' AND at_end) AS insertions, count(*) FILTER (next = 'D' AND at_end) AS deletions
FROM places GROUP BY ref_id, pos""")
def b17_pileup(spark, sf_dir):
    return pileup.base_counts(_records(spark, sf_dir), ["name", "line"], "ACGT")


@query(f"""WITH {_RUNS}, shown AS (SELECT ref_id, pos, name, line, CASE WHEN begins AND at_begin THEN '^' ELSE '' END || base || CASE WHEN at_end AND next = 'I' THEN '+' || n WHEN at_end AND next = 'D' THEN '-' || n ELSE '' END
  || CASE WHEN ends AND at_end THEN '$' ELSE '' END AS shown FROM places)
SELECT ref_id, pos, count(*) AS depth, string_agg(shown, '' ORDER BY name, line, shown) AS "column" FROM shown GROUP BY ref_id, pos""")
def v06_pileup_columns(spark, sf_dir):
    return pileup.pileup(_records(spark, sf_dir), ["name", "line"])


@query(f"""WITH {_HITS}, o AS (SELECT ref AS query, ref_begin AS begin, length, row_number() OVER (PARTITION BY ref ORDER BY ref_begin, length) AS k FROM regions),
m AS (SELECT a.query, a.begin, a.length, b.begin AS other_begin, b.length AS other_length, least(a.length + b.length, b.begin + b.length - a.begin) AS cover, a.k, b.k AS other FROM o a JOIN o b ON a.query = b.query AND a.k < b.k)
SELECT query, begin, length, other_begin, other_length, cover FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY cover DESC, k, other DESC) = 1""")
def c11_cover_pairs(spark, sf_dir):
    # of each item, the two regions that documents share with it and that cover most of it
    return annotation.best_cover_pairs(_regions(spark, sf_dir).select(c("ref").alias("query"), c("ref_begin").alias("begin"), "length"))


@query()
def u05_special_hits(spark, sf_dir):
    library = _library(spark, sf_dir)
    # reads are taken from a reference's first bases
    refs = materialize(_references(spark, sf_dir).withColumn("seq", F.substring("seq", 1, 2 * _PLACE)), "references")
    return annotation.special_hits(_orphans(refs, library).select("id", "read"), library.select("ref_id", "seq"), required=30)
