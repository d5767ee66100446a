"""Split mapping over documents as references and benchmark items as special references: alignments, which SQL can't express, are tested against plain versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement
from strandlake.operators import mates
from strandlake.operators import split_mapping as M
from strandlake.storage import materialize

from .catalogue import query
from .pair_queries import _REFS, _refs
from .views import SEQUENCES, bases, sequences, table

c = F.col
#: Where reads are taken from a reference, how many bases of it and of a special reference they hold, and the longest fragment.
_PLACE, _HALF, _HIGH = 200, 40, 150


def _library(spark, sf_dir) -> DataFrame:
    """Benchmark items as special references of four families in turn."""
    items = mates.numbered(table(spark, sf_dir, "benchmark").select("item_id", bases(c("text")).alias("seq")), ["item_id"], "ref_id")
    family = F.element_at(F.array(*map(F.lit, ("ALU", "L1", "SVA", "HERV"))), (c("ref_id") % 4 + 1).cast("int"))
    return items.select("ref_id", F.concat(family, F.lit("_"), c("item_id").cast("string")).alias("name"), "seq")


def _chimera(own: Column, special: Column) -> Column:
    """Bases of a reference, for every third read a tail, and bases of a special reference, for every fifth on its other strand with its tail of T."""
    part = F.substring(special, (c("ref_id") % 60 + 1).cast("int"), F.lit(_HALF))
    part = F.when(c("ref_id") % 5 == 0, reverse_complement(part)).otherwise(part)
    return F.concat(F.substring(own, F.lit(_PLACE + 1), F.lit(_HALF)), F.when(c("ref_id") % 3 == 0, F.repeat(F.when(c("ref_id") % 5 == 0, "T").otherwise("A"), F.lit(9))).otherwise(F.lit("")), part)


def _references(spark, sf_dir) -> DataFrame:
    return sequences(spark, sf_dir).select(c("doc_id").alias("ref_id"), "seq")


def _orphans(refs: DataFrame, library: DataFrame) -> DataFrame:
    """Of each reference long enough one read across an insertion, its anchor before or behind it in turn."""
    n = max(1, library.count())
    special = library.select(c("ref_id").alias("special"), c("seq").alias("special_seq"))
    reads = refs.filter(F.length("seq") >= 2 * _PLACE).withColumn("special", c("ref_id") % n).join(special, "special")
    read = _chimera(c("seq"), c("special_seq"))
    forward = c("ref_id") % 2 == 1
    place = F.when(forward, _PLACE - 3 * _HALF).otherwise(_PLACE + 2 * _HALF)
    return materialize(reads.select(
        c("ref_id").alias("id"), "ref_id", place.cast("long").alias("pos"), (place + _HALF - 1).cast("long").alias("end"), forward.alias("forward"),
        F.lit(_HIGH).alias("high"), F.when(forward, reverse_complement(read)).otherwise(read).alias("read"),
    ), "orphans")


@query()
def u02_first_mapping(spark, sf_dir):
    refs = materialize(_references(spark, sf_dir), "references")
    orphans = _orphans(refs, _library(spark, sf_dir))
    return M.first_partials(orphans, refs).select("id", "ref_pos", "ref_end", "read_pos", "read_end", "score", "cigar", "side", "reversed", "rescued")


@query()
def u03_second_mapping(spark, sf_dir):
    refs = materialize(_references(spark, sf_dir), "references")
    orphans = _orphans(refs, _library(spark, sf_dir))
    firsts = materialize(M.first_partials(orphans, refs), "first-partials")
    events = firsts.withColumn("event", F.floor(c("id") / 10)).select("id", "event", "read", "read_pos", "read_end", "side")
    return M.second_partials(events, _library(spark, sf_dir))


@query(f"""WITH {_REFS}, j AS (SELECT ref_id, name, sum(length + 300) OVER (ORDER BY ref_id) - length - 300 AS begins, sum(length + 300) OVER (ORDER BY ref_id) - 300 AS ends FROM refs),
p AS (SELECT l_orderkey AS id, l_linenumber AS line, (l_partkey * 97 + l_suppkey) % (SELECT max(ends) FROM j) AS place FROM lineitem)
SELECT p.id, p.line, j.ref_id, j.name, (p.place - j.begins)::BIGINT AS "offset" FROM p JOIN j ON j.begins <= p.place AND p.place < j.ends""")
def p18_located_places(spark, sf_dir):
    joined = mates.concatenated(_refs(spark, sf_dir), "ref_id", "length", M.PAD)
    last = joined.agg(F.max("ends")).first()[0]
    places = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), ((c("l_partkey") * 97 + c("l_suppkey")) % last).alias("place"))
    return M.locate(places, "place", joined, ["ref_id", "name"]).select("id", "line", "ref_id", "name", "offset")


#: One read a document from its bases at 31, with a deletion, an insertion and some bases of its end.
_READ = """substr(seq, 31, 20) || CASE WHEN doc_id % 3 = 0 THEN 'N' ELSE 'A' END || substr(seq, 52, 9) || substr(seq, 63, 15) || 'GT' || substr(seq, 78, 10) || substr(seq, length(seq) - 5, 6)"""
_PIECES = [("M", 0, 0, 30), ("D", None, 30, 2), ("M", 30, 32, 15), ("M", 47, 47, 10), ("M", 57, 57, 6)]
_MARKS = " || ".join(
    f"'^' || substr(seq, {31 + ref}, {n})" if op == "D" else f"array_to_string(list_transform(range(0, {n}), lambda i: CASE WHEN substr(read, {read + 1} + i, 1) = substr(seq, {31 + ref} + i, 1) THEN '=' ELSE substr(seq, {31 + ref} + i, 1) END), '')"
    for op, read, ref, n in _PIECES
)


@query(f"""WITH s AS (SELECT doc_id, seq, {_READ} AS read FROM ({SEQUENCES}) WHERE length(seq) >= 120), m AS (SELECT doc_id, regexp_extract_all({_MARKS}, '=+|\\^[A-Z]+|[A-Z]') AS ps FROM s),
t AS (SELECT doc_id, ps, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN starts_with(ps[i], '=') THEN length(ps[i])::VARCHAR WHEN i > 1 AND starts_with(ps[i - 1], '=') THEN ps[i] ELSE '0' || ps[i] END) AS shown FROM m)
SELECT doc_id, array_to_string(shown, '') || CASE WHEN starts_with(ps[len(ps)], '=') THEN '' ELSE '0' END AS md, (2 + list_sum(list_transform(ps, lambda x: CASE WHEN starts_with(x, '=') THEN 0 ELSE length(replace(x, '^', '')) END)))::INTEGER AS nm FROM t""")
def v10_difference_tags(spark, sf_dir):
    refs = sequences(spark, sf_dir).filter(F.length("seq") >= 120)
    records = refs.select("doc_id", c("doc_id").alias("ref_id"), F.lit(30).cast("long").alias("pos"), F.lit("30M2D15M2I16M").alias("cigar"), F.expr(_READ).alias("seq"))
    return M.with_difference_tags(records, refs.select(c("doc_id").alias("ref_id"), "seq")).select("doc_id", "md", "nm")
