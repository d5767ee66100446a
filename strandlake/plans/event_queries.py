"""Queries from evidence to calls: locus joins, clusters in two dimensions, split events, seed regions and call lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions import pairs as P
from strandlake.functions import sequence as S
from strandlake.operators import cluster, evidence, genotype, mates
from strandlake.sources import formats
from strandlake.storage import broadcast_if_small, materialize

from .catalogue import _GENOTYPE, SECOND, _evidence, query
from .pair_queries import _P, _TYPE
from .views import INTERVALS, SEQUENCES, bases, intervals, pairs, sequences, table

c = F.col
_SITES = "sites AS (SELECT p_partkey AS site, p_partkey % 5 AS ref_id, p_partkey AS pos, p_size % 7 AS uncertainty, p_size % 2 = 0 AS precise FROM part)"
_FRAGS = """frags AS (SELECT ref_id, read_group % 3 AS sample, pos AS start, pos + frag_len AS read_end, pos + 5 AS near_end, pos + frag_len AS far_start, pos + frag_len + 5 AS fragment_end, ref_id = mate_ref AS same_ref, map_qual, lead_clip >= 6 AS soft, flag & 64 <> 0 AS upstream,
  CASE WHEN frag_len < 10 THEN 'SHORT' WHEN frag_len <= 40 THEN 'NORMAL' ELSE 'LONG' END AS kind, mate_code IS NOT NULL AND code IS NULL AS special, flag & 16 <> 0 AS reverse FROM p)"""
_COUNTS = f"""{_P}, {_SITES}, {_FRAGS}, m AS (SELECT *, pos - CASE WHEN precise THEN 0 ELSE uncertainty // 2 END AS low, pos + CASE WHEN precise THEN 0 ELSE uncertainty // 2 END AS high FROM sites JOIN frags USING (ref_id) WHERE start BETWEEN pos - 50 AND pos + 5),
e AS (SELECT *, same_ref AND fragment_end >= high AND precise AND map_qual >= 2 AND NOT soft AND pos - start > 4 AND read_end - pos > 4 AS across, same_ref AND fragment_end >= high AND upstream AND near_end <= high AND far_start >= low AS over, abs(start - pos) <= 4 AS near FROM m),
counts AS (SELECT site, sample, count(*) FILTER (across) + count(*) FILTER (over AND kind = 'NORMAL') AS non_support, count(*) FILTER (special AND near AND NOT reverse) AS rp3, count(*) FILTER (special AND near AND reverse) AS rp5, count(*) FILTER (soft AND near AND NOT reverse) AS sr3, count(*) FILTER (soft AND near AND reverse) AS sr5,
  count(*) FILTER (over AND kind = 'SHORT') + rp3 + rp5 + sr3 + sr5 AS support FROM e GROUP BY site, sample)"""


def _site_counts(spark, sf_dir) -> DataFrame:
    sites = table(spark, sf_dir, "part").select(c("p_partkey").alias("site"), (c("p_partkey") % 5).alias("ref_id"), c("p_partkey").alias("pos"), (c("p_size") % 7).alias("uncertainty"), (c("p_size") % 2 == 0).alias("precise"))
    end = c("pos") + c("frag_len")
    kind = F.when(c("frag_len") < 10, "SHORT").when(c("frag_len") <= 40, "NORMAL").otherwise("LONG")
    frags = pairs(spark, sf_dir).select(
        "ref_id", (c("read_group") % 3).alias("sample"), c("pos").alias("start"), end.alias("read_end"), (c("pos") + 5).alias("near_end"), end.alias("far_start"), (end + 5).alias("fragment_end"), (c("ref_id") == c("mate_ref")).alias("same_ref"),
        "map_qual", (c("lead_clip") >= 6).alias("soft"), A.has(c("flag"), A.FIRST).alias("upstream"), kind.alias("kind"), (c("mate_code").isNotNull() & c("code").isNull()).alias("special"), A.has(c("flag"), A.REVERSE).alias("reverse"),
    )
    return evidence.evidence(evidence.locus_fragments(sites, frags, 50, 5), ["site", "sample"], 2, 4)


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def a12_sample_evidence(spark, sf_dir):
    return _site_counts(spark, sf_dir)


@query(f"WITH {_COUNTS} SELECT site FROM counts GROUP BY site HAVING (sum(rp3) >= 2 AND sum(rp5) >= 2) OR sum(sr3) + sum(sr5) >= 5")
def f10_supported_sites(spark, sf_dir):
    return evidence.supported(_site_counts(spark, sf_dir), ["site"])


_CALLED = f"""{_COUNTS}, fit AS (SELECT site FROM counts GROUP BY site HAVING (sum(rp3) >= 2 AND sum(rp5) >= 2) OR sum(sr3) + sum(sr5) >= 5),
l AS (SELECT *, (lgamma(non_support + support + 1) - lgamma(non_support + 1) - lgamma(support + 1)) / ln(10) AS ch FROM counts SEMI JOIN fit USING (site)),
g AS (SELECT *, ch + non_support * log10(0.999) + support * log10(0.001) AS a, ch + (non_support + support) * log10(0.5) AS b, ch + non_support * log10(0.001) + support * log10(0.999) AS d FROM l)"""


@query(f"WITH {_CALLED} SELECT site, sample, non_support, support, CASE WHEN non_support + support = 0 THEN '.' WHEN a >= b AND a >= d THEN '0/0' WHEN b >= d THEN '0/1' ELSE '1/1' END AS gt FROM g")
def j11_locus_genotypes(spark, sf_dir):
    # stored, as they are both genotyped and summed over samples
    counts = materialize(_site_counts(spark, sf_dir), "site-counts")
    called = genotype.genotype(counts.join(evidence.supported(counts, ["site"]), "site", "left_semi").withColumns({"n_ref": c("non_support"), "n_alt": c("support")}))
    return called.select("site", "sample", "non_support", "support", "gt")


_WIDE = f"iv AS (SELECT *, end_us - start_us AS lasting, (300 + sample_id % 3 * 150) * {SECOND} AS b1, (20 + sample_id % 2 * 20) * {SECOND} AS b2 FROM ({INTERVALS}))"
_MOUNTAIN = f"""{_WIDE}, near AS (SELECT a.family, a.event_id, b.event_id AS other FROM iv a JOIN iv b ON a.family = b.family AND abs(a.start_us - b.start_us) <= a.b1 AND abs(a.lasting - b.lasting) <= a.b2),
dens AS (SELECT family, event_id, count(*) AS density FROM near GROUP BY ALL), ranked AS (SELECT d.*, start_us, lasting FROM dens d JOIN iv USING (family, event_id)),
best AS (SELECT n.family, n.event_id, arg_min(n.other, (-r.density, r.start_us, r.lasting, r.event_id)) AS centre FROM near n JOIN ranked r ON r.family = n.family AND r.event_id = n.other GROUP BY ALL)"""


def _mountain(spark, sf_dir) -> DataFrame:
    lasting = (300 + c("sample_id") % 3 * 150) * SECOND, (20 + c("sample_id") % 2 * 20) * SECOND
    points = intervals(spark, sf_dir).withColumns({"lasting": c("end_us") - c("start_us"), "b1": lasting[0], "b2": lasting[1]})
    return cluster.mountain(points, "family", "event_id", "start_us", "lasting", "b1", "b2")


@query(f"WITH {_MOUNTAIN} SELECT family, event_id, density, centre FROM best JOIN dens USING (family, event_id)")
def c02_mountain(spark, sf_dir):
    return _mountain(spark, sf_dir)


@query(f"""WITH RECURSIVE {_MOUNTAIN}, walk AS (SELECT family, event_id, centre FROM best UNION SELECT w.family, w.event_id, b.centre FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre),
roots AS (SELECT w.* FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre AND b.centre = b.event_id),
kept AS (SELECT r.family, r.centre, max(d.density) AS root_density, count(*) AS members FROM roots r JOIN dens d ON d.family = r.family AND d.event_id = r.centre GROUP BY ALL HAVING max(d.density) >= 3)
SELECT *, row_number() OVER (ORDER BY family, centre) - 1 AS id FROM kept""")
def c03_finalized(spark, sf_dir):
    return mates.numbered(cluster.finalized(_mountain(spark, sf_dir), "family", "event_id", 3), ["family", "centre"], "id")


_MED = "med AS (SELECT read_group, floor(median(frag_len))::INT AS med FROM p WHERE frag_len > 0 GROUP BY read_group)"


@query(f"WITH {_P}, {_MED} SELECT read_group, sum(pos + frag_len // 2)::BIGINT AS first, sum(frag_len - med)::BIGINT AS second, round(max(1.25::DOUBLE * med), 6) AS bound, count(*) AS n FROM p JOIN med USING (read_group) WHERE {_TYPE} IN ('INVERTED3', 'INVERTED5') GROUP BY read_group")
def c01_pair_attributes(spark, sf_dir):
    own = pairs(spark, sf_dir)
    med = own.filter("frag_len > 0").groupBy("read_group").agg(F.expr("CAST(floor(percentile(frag_len, 0.5)) AS INT)").alias("med"))
    inverted = own.filter(P.pair_type(A.orientation(c("flag"))).isin("INVERTED3", "INVERTED5")).join(med, "read_group")
    return inverted.groupBy("read_group").agg(F.sum(c("pos") + F.floor(c("frag_len") / 2)).alias("first"), F.sum((c("frag_len") - c("med")).cast("long")).alias("second"), F.round(F.max(1.25 * c("med")), 6).alias("bound"), F.count("*").alias("n"))


@query(f"""WITH {_P}, parts AS (SELECT ref_id * 1000 + read_group AS ref_id, pos, pos + frag_len // 8 AS stop, coalesce(code, '-') AS family, flag & 16 <> 0 AS reverse, unnest([5, 3]) AS side, unnest([lead_clip, trail_clip]) AS clip FROM p),
kept AS (SELECT * FROM parts WHERE clip >= 6), o AS (SELECT *, max(stop) OVER (PARTITION BY ref_id ORDER BY pos, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY ref_id ORDER BY pos, stop) AS k FROM kept),
n AS (SELECT *, sum(CASE WHEN pos <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY ref_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS event FROM o),
v AS (SELECT ref_id, event, family, reverse, count(*) AS n, min(pos) AS a, max(stop) AS b, count(*) FILTER (side = 3) AS n3, count(*) FILTER (side = 5) AS n5, count(*) FILTER (clip >= 8) AS major, max(clip) AS clip FROM n GROUP BY ALL)
SELECT ref_id, min(a) AS start, max(b) AS stop, sum(n3)::BIGINT AS n3, sum(n5)::BIGINT AS n5, sum(major)::BIGINT AS major, max(clip) AS longest_clip, arg_min(family, (-n, family, reverse)) AS family, arg_min(reverse, (-n, family, reverse)) AS reverse, max(n)::DOUBLE / sum(n) AS agree FROM v GROUP BY ref_id, event""")
def c08_split_events(spark, sf_dir):
    records = pairs(spark, sf_dir).select(
        (c("ref_id") * 1000 + c("read_group")).alias("ref_id"), "pos", (c("pos") + F.floor(c("frag_len") / 8)).alias("end"), c("lead_clip").alias("lead"), c("trail_clip").alias("trail"),
        F.coalesce("code", F.lit("-")).alias("family"), A.has(c("flag"), A.REVERSE).alias("reverse"),
    )
    return evidence.split_events(evidence.partials(records, 6), 8)


_HITS = f"""r AS ({SEQUENCES.replace("doc_id,", "item_id,").replace("documents", "benchmark")}), k AS (SELECT item_id, i, substr(seq, i + 1, 16) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 15)) AS i FROM r)),
d AS (SELECT doc_id, i, substr(seq, i + 1, 16) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 15)) AS i FROM ({SEQUENCES}))),
h AS (SELECT DISTINCT doc_id AS query, item_id AS ref, d.i AS query_pos, k.i AS ref_pos FROM d JOIN k USING (kmer)),
g AS (SELECT *, query_pos - row_number() OVER (PARTITION BY query, ref, ref_pos - query_pos ORDER BY query_pos) AS run FROM h),
regions AS (SELECT query, ref, min(query_pos) AS begin, min(ref_pos) AS ref_begin, count(*) + 15 AS length FROM g GROUP BY query, ref, ref_pos - query_pos, run HAVING count(*) + 15 >= 20)"""


def _regions(spark, sf_dir) -> DataFrame:
    refs = S.kmer_rows(table(spark, sf_dir, "benchmark").select(c("item_id").alias("ref"), bases(c("text")).alias("seq")), "seq", 16).withColumnRenamed("pos", "ref_pos")
    reads = S.kmer_rows(sequences(spark, sf_dir).withColumnRenamed("doc_id", "query"), "seq", 16).withColumnRenamed("pos", "query_pos")
    return evidence.seed_regions(reads.join(broadcast_if_small(materialize(refs, "seeds")), "kmer").select("query", "ref", "query_pos", "ref_pos"), 16, 20)


@query(f"WITH {_HITS} SELECT * FROM regions")
def c10_seed_regions(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(f"""WITH {_HITS} SELECT query, begin + length - 1 AS "end", arg_min(ref, (-length, ref, ref_begin, begin)) AS ref, arg_min(ref_begin, (-length, ref, ref_begin, begin)) AS ref_begin, arg_min(begin, (-length, ref, ref_begin, begin)) AS begin, max(length) AS length FROM regions GROUP BY query, begin + length - 1""")
def c12_longest_by_end(spark, sf_dir):
    return evidence.longest_by_end(_regions(spark, sf_dir))


@query("""SELECT p_partkey, 'chr' || (p_partkey % 5) || chr(9) || (p_partkey + 1) || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<INS:ME:' || p_type || '>' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) ||
  CASE WHEN p_size % 2 = 0 THEN '' ELSE 'IMPRECISE;CIPOS=' || (-(p_size % 7)) || ',' || p_size || ';' END || 'TYPE=' || p_type || ';MEILEN=' || p_size AS line FROM part""")
def k02_call_lines(spark, sf_dir):
    calls = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("chr"), (c("p_partkey") % 5).cast("string")).alias("chrom"), c("p_partkey").alias("pos"), c("p_type").alias("family"), c("p_size").alias("length"),
        F.when(c("p_size") % 2 != 0, F.struct((-(c("p_size") % 7)).alias("low"), c("p_size").alias("high"))).alias("interval"),
    )
    return calls.select("p_partkey", formats.insertion_line(c("chrom"), c("pos"), c("family"), c("interval"), c("length")).alias("line"))


@query(f"""{_GENOTYPE} SELECT site, sample, gt || ':' || CASE WHEN gt = '.' THEN '0.00,0.00,0.00' ELSE printf('%.2f', gl_0) || ',' || printf('%.2f', gl_1) || ',' || printf('%.2f', gl_2) END || ':' || n_ref || ':' || n_alt AS fields FROM gt""")
def k03_genotype_fields(spark, sf_dir):
    called = genotype.genotype(_evidence(spark, sf_dir)).withColumns({f"gl_{i}": F.round(f"gl_{i}", 6) for i in range(3)})
    return called.select("site", "sample", formats.genotype_fields(c("gt"), [c(f"gl_{i}") for i in range(3)], [c("n_ref"), c("n_alt")]).alias("fields"))


@query(f"""WITH {_P}, u AS (SELECT read_group, frag_len, (CASE WHEN flag & 64 <> 0 THEN 0 ELSE 4 END + CASE WHEN flag & 16 <> 0 THEN 2 ELSE 0 END + CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END) AS model FROM p WHERE map_qual >= 1 AND mate_qual >= 1),
t AS (SELECT *, row_number() OVER (PARTITION BY read_group ORDER BY n DESC, model) AS rank, sum(n) OVER (PARTITION BY read_group) AS total FROM (SELECT read_group, model, count(*) AS n FROM u GROUP BY ALL)),
top AS (SELECT read_group, model FROM t WHERE rank <= 2), am AS (SELECT read_group, (max(total) - sum(n))::DOUBLE / sum(n) > 0.1::DOUBLE AS ambiguous FROM t WHERE rank <= 2 GROUP BY read_group),
s AS (SELECT read_group, frag_len, row_number() OVER (PARTITION BY read_group ORDER BY frag_len) AS k, count(*) OVER (PARTITION BY read_group) AS n FROM u SEMI JOIN top USING (read_group, model))
SELECT read_group, ambiguous, max(n) AS n, min(frag_len) FILTER (k = least(floor(n * 0.05::DOUBLE) + 1, n)) AS low, min(frag_len) FILTER (k = least(floor(n * 0.5::DOUBLE) + 1, n)) AS median, min(frag_len) FILTER (k = least(floor(n * 0.95::DOUBLE) + 1, n)) AS high FROM s JOIN am USING (read_group) GROUP BY ALL""")
def b08_resolve(spark, sf_dir):
    sure = pairs(spark, sf_dir).filter("map_qual >= 1 AND mate_qual >= 1").select("read_group", "frag_len", A.orientation(c("flag")).alias("model"))
    by = Window.partitionBy("read_group").orderBy(F.desc("n"), "model")
    counted = sure.groupBy("read_group", "model").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(by))
    top = counted.filter("rank <= 2").select("read_group", "model")
    two = F.sum(F.when(c("rank") <= 2, c("n")))
    ambiguous = counted.groupBy("read_group").agg(((F.sum("n") - two) / two > 0.1).alias("ambiguous"))
    # places in the sorted lengths come from counts a length, not from sorted records
    up = Window.partitionBy("read_group").orderBy("frag_len")
    lengths = sure.join(top, ["read_group", "model"], "left_semi").groupBy("read_group", "frag_len").agg(F.count("*").alias("k"))
    lengths = lengths.withColumns({"upto": F.sum("k").over(up), "n": F.sum("k").over(Window.partitionBy("read_group"))})
    at = lambda share: F.min(F.when(c("upto") >= evidence.percentile_index(share, c("n")), c("frag_len")))
    found = lengths.groupBy("read_group").agg(F.max("n").alias("n"), at(0.05).alias("low"), at(0.5).alias("median"), at(0.95).alias("high"))
    return found.join(ambiguous, "read_group")
