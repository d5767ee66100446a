"""Queries over variant calls, read from orders, and k-mer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import calls

from .catalogue import query
from .views import SEQUENCES, sequences, table

c = F.col
#: Columns of calls over orders, in SQL that both engines read alike.
_COLUMNS = {
    "chrom": "'chr' || CAST(o_custkey % 5 AS STRING)",
    "pos": "o_orderkey",
    "ref": "substr('ACGTN', CAST(o_orderkey % 5 AS INT) + 1, 1)",
    "alt": "substr('ACGT', CAST(o_custkey % 4 AS INT) + 1, 1) || CASE WHEN o_custkey % 7 = 0 THEN 'GA' ELSE '' END",
    "qual": "CAST(floor(o_totalprice) AS BIGINT) % 100",
    "depth": "o_custkey % 31",
    "dp_alt": "o_custkey % 9",
    "mq": "o_orderkey % 61",
    "r": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
}
_CALLS = "v AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM orders)"
_KNOWN = "known AS (SELECT DISTINCT 'chr' || CAST(l_suppkey % 5 AS STRING) AS chrom, l_orderkey AS pos FROM lineitem WHERE l_returnflag = 'R')"


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _COLUMNS.items()])


def _known(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").selectExpr("'chr' || CAST(l_suppkey % 5 AS STRING) AS chrom", "l_orderkey AS pos")


@query(f"WITH {_CALLS}, {_KNOWN} SELECT chrom, pos, ref, alt FROM v SEMI JOIN known USING (chrom, pos) WHERE ref <> 'N'")
def x01_view_sites(spark, sf_dir):
    return calls.plain_sites(_calls(spark, sf_dir), _known(spark, sf_dir)).select("chrom", "pos", "ref", "alt")


@query(f"""WITH {_CALLS}, p AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS previous FROM v)
SELECT chrom, count(*) FILTER (r > 0.9::DOUBLE AND pos > previous) AS strong, round(count(*) FILTER (r > 0.9::DOUBLE AND pos > previous) / count(r), 6) AS fraction, coalesce(sum(pos - previous) FILTER (r > 0.9::DOUBLE AND pos > previous), 0)::BIGINT AS length FROM p GROUP BY chrom""")
def x09_linkage_statistics(spark, sf_dir):
    return calls.linkage_statistics(_calls(spark, sf_dir), c("r")).withColumn("fraction", F.round("fraction", 6))


@query(f"""WITH {_CALLS}, {_KNOWN}, s AS (SELECT v.*, known.pos IS NOT NULL AS joint FROM v LEFT JOIN known USING (chrom, pos) WHERE ref <> 'N' AND length(alt) = 1),
q AS (SELECT qual, count(*) AS n, count(*) FILTER (alt <> ref) AS snps, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER (joint) AS joint FROM s GROUP BY qual),
w AS (SELECT qual, sum(n) OVER o AS n, sum(snps) OVER o AS snps, sum(transitions) OVER o AS transitions, sum(joint) OVER o AS joint FROM q WINDOW o AS (ORDER BY qual DESC))
SELECT qual, n::BIGINT AS n, snps::BIGINT AS snps, transitions::BIGINT AS transitions, joint::BIGINT AS joint, round(CASE WHEN snps = transitions THEN 100 ELSE transitions / (snps - transitions) END, 4) AS ts_tv FROM w""")
def x10_transitions(spark, sf_dir):
    found = calls.quality_classes(_calls(spark, sf_dir), _known(spark, sf_dir))
    return found.withColumn("ts_tv", F.round(calls.transition_ratio(c("snps"), c("transitions")), 4))


@query(f"""WITH {_CALLS}, t AS (SELECT chrom, pos, length(ref) - 1 AS span, length(alt) <> length(ref) AS gap, qual * 100 + dp_alt AS score, CASE WHEN dp_alt < 2 THEN 4 WHEN depth < 2 THEN 2 WHEN mq < 10 THEN 1 ELSE 0 END AS code FROM v WHERE ref <> 'N'),
m AS (SELECT a.chrom, a.pos AS a, b.pos AS b, a.pos + a.span + 3 >= b.pos AS close, a.gap AS ga, b.gap AS gb, a.code AS ca, b.code AS cb, a.score AS sa, b.score AS sb FROM t a JOIN t b ON a.chrom = b.chrom AND b.pos > a.pos AND b.pos <= a.pos + a.span + 10 WHERE a.gap OR b.gap),
hit AS (SELECT chrom, a AS pos FROM m WHERE (NOT ga AND cb = 0 AND close) OR (ga AND gb AND ca = 0 AND cb = 0 AND sa < sb) UNION SELECT chrom, b FROM m WHERE (NOT gb AND close) OR (ga AND gb AND ca = 0 AND cb = 0 AND sa >= sb))
SELECT t.chrom, t.pos, CASE WHEN code = 0 AND hit.pos IS NOT NULL THEN CASE WHEN gap THEN 6 ELSE 5 END ELSE code END AS code FROM t LEFT JOIN hit USING (chrom, pos)""")
def x11_variant_filter(spark, sf_dir):
    scored = calls.plain_sites(_calls(spark, sf_dir)).withColumns({"score": c("qual") * 100 + c("dp_alt"), "code": calls.filter_codes(c("depth"), c("dp_alt"), c("mq"))})
    return calls.near_gaps(scored.select("chrom", "pos", "ref", "alt", "score", "code")).select("chrom", "pos", "code")


_KEY = " + ".join(f"(instr('ACGT', substr(seq, i + {j}, 1)) - 1) * {4 ** (6 - j)}" for j in range(7))


@query(f"SELECT key::BIGINT AS key, count(*) AS n FROM (SELECT {_KEY} AS key FROM (SELECT seq, unnest(range(1, length(seq) - 5)) AS i FROM ({SEQUENCES}))) GROUP BY key")
def p25_two_bit_keys(spark, sf_dir):
    return S.kmer_counts(sequences(spark, sf_dir), "seq", 7).select(c("kmer").alias("key"), "n")
