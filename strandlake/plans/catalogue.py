"""The registered queries of the engine's own operators, with SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions import pairwise
from strandlake.functions import sequence as S
from strandlake.operators import cluster, genotype, library, population, ranges, toolkit
from strandlake.storage import broadcast_if_small, dealt_by_work, materialize

from .views import ALIGNMENTS, INTERVALS, SEQUENCES, alignments, bases, intervals, sequences, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECOND = 1_000_000


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL it is held against."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_HIST = f"hist AS (SELECT read_group, frag_len, count(*) AS freq FROM ({ALIGNMENTS}) WHERE frag_len > 0 GROUP BY ALL)"
_CUM = f"""{_HIST}, cum AS (
  SELECT *, sum(freq) OVER (PARTITION BY read_group ORDER BY frag_len) AS cum_asc, sum(freq) OVER (PARTITION BY read_group ORDER BY frag_len DESC) AS cum_desc, sum(freq) OVER (PARTITION BY read_group) AS total FROM hist)"""


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.histogram(alignments(spark, sf_dir))


@query(f"WITH {_CUM} SELECT read_group, frag_len, freq, cum_asc::BIGINT AS cum_freq FROM cum")
def a01_frag_hist(spark, sf_dir):
    return library.cumulative(_hist(spark, sf_dir)).select("read_group", "frag_len", "freq", F.col("cum_asc").alias("cum_freq"))


@query(f"""SELECT read_group, count(*) AS n_pairs, round(avg(frag_len), 6) AS mean, quantile_disc(frag_len, 0.5) AS median, round(coalesce(stddev_samp(frag_len), 0), 6) AS stdev
FROM ({ALIGNMENTS}) WHERE frag_len > 0 GROUP BY read_group""")
def a02_frag_stats(spark, sf_dir):
    return library.statistics(_hist(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query(f"""WITH {_CUM}, cut AS (SELECT read_group, max(total)::BIGINT AS n_pairs, min(frag_len) FILTER (2 * cum_asc >= total) AS median,
  min(frag_len) FILTER ((cum_asc - 0.1::DOUBLE / 2 * total) / (total * (1 - 0.1::DOUBLE)) > 0.01::DOUBLE / 2) AS low, max(frag_len) FILTER ((cum_desc - 0.1::DOUBLE / 2 * total) / (total * (1 - 0.1::DOUBLE)) > 0.01::DOUBLE / 2) AS high FROM cum GROUP BY read_group)
SELECT read_group, n_pairs, CASE WHEN n_pairs >= 100 THEN median END AS median, CASE WHEN n_pairs >= 100 THEN low END AS low, CASE WHEN n_pairs >= 100 THEN high END AS high FROM cut""")
def a03_cutoffs(spark, sf_dir):
    return library.cutoffs(_hist(spark, sf_dir), trim=0.1, min_pairs=100)


@query(f"""WITH {_CUM}, med AS (SELECT read_group, min(frag_len) FILTER (2 * cum_asc >= total) AS median FROM cum GROUP BY read_group),
q AS (SELECT read_group, frag_len, CASE WHEN frag_len > median THEN 1 - cum_asc / total ELSE cum_asc / total END AS tail FROM cum JOIN med USING (read_group))
SELECT read_group, CASE WHEN tail > 0 THEN floor(-10 * log10(tail) + 0.5) ELSE 99 END::BIGINT AS frag_quality, count(*) AS n FROM ({ALIGNMENTS}) JOIN q USING (read_group, frag_len) GROUP BY ALL""")
def p19_frag_quality(spark, sf_dir):
    pairs = alignments(spark, sf_dir).filter("frag_len > 0")
    return library.length_quality(pairs, library.histogram(pairs)).groupBy("read_group", "frag_quality").agg(F.count("*").alias("n"))


@query(f"""SELECT (CASE WHEN flag & 64 <> 0 THEN 0 ELSE 4 END + CASE WHEN flag & 16 <> 0 THEN 2 ELSE 0 END + CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END) AS orientation, count(*) AS n
FROM ({ALIGNMENTS}) WHERE flag & 1 <> 0 AND flag & 12 <> 12 AND flag & 512 = 0 AND flag & 1024 = 0 GROUP BY 1""")
def p10_orientation(spark, sf_dir):
    kept = alignments(spark, sf_dir).filter(A.usable_pair(F.col("flag")))
    return kept.groupBy(A.orientation(F.col("flag")).alias("orientation")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({SEQUENCES}), c AS (SELECT doc_id, unnest(['A', 'C', 'G', 'T']) AS b, length(seq) AS n, seq FROM s), p AS (SELECT doc_id, (n - length(replace(seq, b, ''))) / nullif(n, 0) AS p FROM c)
SELECT doc_id, round(coalesce(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 0), 6) AS entropy FROM p GROUP BY doc_id""")
def p14_entropy(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(S.entropy(F.col("seq")), 6).alias("entropy"))


@query(f"SELECT doc_id, upper(md5(seq)) AS digest, upper(md5(reverse(translate(seq, 'ACGT', 'TGCA')))) AS reverse_digest, length(seq)::BIGINT AS n_bases FROM ({SEQUENCES})")
def p15_sequence_md5(spark, sf_dir):
    seq = F.col("seq")
    return sequences(spark, sf_dir).select("doc_id", S.sequence_md5(seq).alias("digest"), S.sequence_md5(S.reverse_complement(seq)).alias("reverse_digest"), F.length(seq).cast("long").alias("n_bases"))


@query("""WITH f AS (SELECT p_partkey, p_type || '_' || p_brand || '.x' AS name FROM part) SELECT regexp_extract(name, '^[^_]*_([^.]*)', 1) AS family, min(p_partkey) AS first_seen, count(*) AS n FROM f GROUP BY 1""")
def p16_family(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", S.family_name(F.concat_ws("_", "p_type", F.concat("p_brand", F.lit(".x")))).alias("family"))
    return parts.groupBy("family").agg(F.min("p_partkey").alias("first_seen"), F.count("*").alias("n"))


@query(f"""WITH r AS ({SEQUENCES.replace("doc_id,", "item_id,").replace("documents", "benchmark")}), k AS (SELECT item_id, substr(seq, i + 1, 12) AS kmer FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 11)) AS i FROM r)),
d AS (SELECT doc_id, substr(seq, i + 1, 12) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 11)) AS i FROM ({SEQUENCES})))
SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM d JOIN (SELECT DISTINCT item_id, kmer FROM k) USING (kmer) GROUP BY item_id""")
def j12_kmer_seeds(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select("item_id", bases(F.col("text")).alias("seq"))
    seeds = S.kmer_rows(bench, "seq", 12).select("item_id", "kmer").distinct()
    reads = S.kmer_rows(sequences(spark, sf_dir), "seq", 12).select("doc_id", "kmer")
    # hits are counted per read before they move on
    return reads.join(broadcast_if_small(materialize(seeds, "seeds")), "kmer").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))


@query("""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn // 2, b.turn // 2) AS pair, length(a.text) AS length_1, length(b.text) AS length_2
FROM (SELECT * FROM conversations WHERE turn % 2 = 0) a FULL JOIN (SELECT * FROM conversations WHERE turn % 2 = 1) b ON a.conv_id = b.conv_id AND a.turn // 2 = b.turn // 2""")
def j01_mate_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", F.floor(F.col("turn") / 2).alias("pair")).alias("name"), (F.col("turn") % 2).alias("half"), F.length("text").alias("length"))
    paired = toolkit.mates(turns, "name", F.col("half") == 0, F.col("half") == 1, ["length"])
    return paired.select("name.conv_id", "name.pair", "length_1", "length_2")


@query("""SELECT n_name, count(*) AS n, sum(CAST(floor(l_quantity) AS BIGINT))::BIGINT AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0 GROUP BY n_name""")
def j06_library_dims(spark, sf_dir):
    good = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_quantity").alias("q"))
    return lines.groupBy("l_suppkey").agg(F.count("*").alias("c"), F.sum("q").alias("q")).join(good, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.sum("c").alias("n"), F.sum("q").alias("total"))


_BOUND = 600 * SECOND
_NEAR = f"iv AS ({INTERVALS}), near AS (SELECT a.family, a.event_id, b.event_id AS other FROM iv a JOIN iv b ON a.family = b.family AND abs(a.start_us - b.start_us) <= {_BOUND})"


@query(f"WITH {_NEAR} SELECT family, event_id, count(*) AS density FROM near GROUP BY ALL")
def a15_density(spark, sf_dir):
    return cluster.densities(intervals(spark, sf_dir), "family", "event_id", "start_us", _BOUND)


_CENTRES = f"""{_NEAR}, dens AS (SELECT family, event_id, count(*) AS density FROM near GROUP BY ALL), ranked AS (SELECT d.*, start_us FROM dens d JOIN iv USING (family, event_id)),
best AS (SELECT n.family, n.event_id, arg_min(n.other, (-r.density, r.start_us, r.event_id)) AS centre FROM near n JOIN ranked r ON r.family = n.family AND r.event_id = n.other GROUP BY ALL)"""


@query(f"WITH {_CENTRES} SELECT family, event_id, density, centre FROM best JOIN dens USING (family, event_id)")
def c02_centres(spark, sf_dir):
    return cluster.centres(intervals(spark, sf_dir), "family", "event_id", "start_us", _BOUND)


@query(f"""WITH RECURSIVE {_CENTRES}, walk AS (SELECT family, event_id, centre FROM best UNION SELECT w.family, w.event_id, b.centre FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre),
roots AS (SELECT w.* FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre AND b.centre = b.event_id)
SELECT family, centre, count(*) AS members FROM roots GROUP BY ALL HAVING count(*) > 1""")
def c03_clusters(spark, sf_dir):
    linked = cluster.centres(intervals(spark, sf_dir), "family", "event_id", "start_us", _BOUND)
    found = cluster.clusters(linked, "family", "event_id")
    return found.groupBy("family", "centre").agg(F.count("*").alias("members")).filter("members > 1")


@query(f"""WITH RECURSIVE {_CENTRES}, walk AS (SELECT family, event_id, centre FROM best UNION SELECT w.family, w.event_id, b.centre FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre),
m AS (SELECT w.family, w.centre, (end_us - iv.start_us) // 1000 AS ms FROM walk w JOIN best b ON b.family = w.family AND b.event_id = w.centre AND b.centre = b.event_id JOIN iv ON iv.family = w.family AND iv.event_id = w.event_id)
SELECT family, centre, count(*) AS members, round(avg(ms), 3) AS mean, round(stddev_pop(ms), 3) AS std, min(ms) AS lowest, max(ms) AS highest FROM m GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(ms) > 50""")
def a07_cluster_statistics(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    found = cluster.clusters(cluster.centres(iv, "family", "event_id", "start_us", _BOUND), "family", "event_id")
    lasting = iv.select("family", "event_id", F.expr("(end_us - start_us) div 1000").alias("ms"))
    kept = cluster.statistics(found.join(lasting, ["family", "event_id"]), ["family", "centre"], "ms", min_members=3, min_std=50.0)
    return kept.withColumns({"mean": F.round("mean", 3), "std": F.round("std", 3)})


@query(f"""SELECT read_group, ref_id, sum(CASE WHEN (flag & 64 <> 0) = (flag & 32 <> 0) THEN 1 ELSE -1 END)::BIGINT AS sense FROM ({ALIGNMENTS}) GROUP BY ALL""")
def a09_strand_vote(spark, sf_dir):
    pairs = alignments(spark, sf_dir).withColumn("side", F.when(A.has(F.col("flag"), A.FIRST), 3).otherwise(5))
    return cluster.strand_vote(pairs, ["read_group", "ref_id"], "side", A.has(F.col("flag"), A.MATE_REVERSE))


_POINTS = f"pts AS (SELECT family, sample_id, start_us AS p, count(*) AS n FROM ({INTERVALS}) GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_POINTS}, nxt AS (SELECT *, min(p) OVER (PARTITION BY family, sample_id ORDER BY p RANGE BETWEEN {3600 * SECOND} FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM pts),
starts AS (SELECT family, sample_id, min(p) AS p FROM pts GROUP BY ALL UNION ALL SELECT n.family, n.sample_id, n.q FROM starts s JOIN nxt n ON n.family = s.family AND n.sample_id = s.sample_id AND n.p = s.p WHERE n.q IS NOT NULL),
own AS (SELECT a.*, s.p AS start FROM pts a ASOF JOIN starts s ON a.family = s.family AND a.sample_id = s.sample_id AND a.p >= s.p)
SELECT family, sample_id, start AS first, max(p) AS last, sum(n)::BIGINT AS members FROM own GROUP BY ALL""")
def c05_event_sweep(spark, sf_dir):
    return ranges.sweep_merge(intervals(spark, sf_dir), ["family", "sample_id"], "start_us", 3600 * SECOND)


@query(f"""WITH iv AS ({INTERVALS}), g AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER (PARTITION BY family, sample_id ORDER BY start_us) < {3600 * SECOND} THEN 0 ELSE 1 END AS new FROM iv),
r AS (SELECT *, sum(new) OVER (PARTITION BY family, sample_id ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT family, sample_id, min(start_us) AS first, max(start_us) AS last, count(*) AS members FROM r GROUP BY family, sample_id, run""")
def c06_gap_merge(spark, sf_dir):
    return ranges.gap_merge(intervals(spark, sf_dir), ["family", "sample_id"], "start_us", 3600 * SECOND)


@query(f"""WITH iv AS ({INTERVALS}), o AS (SELECT *, max(end_us) OVER (PARTITION BY sample_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
n AS (SELECT *, sum(CASE WHEN start_us <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT sample_id, min(start_us) AS island_start, max(end_us) AS island_end, count(*) AS members FROM n GROUP BY sample_id, island""")
def c07_islands(spark, sf_dir):
    return ranges.islands(intervals(spark, sf_dir), ["sample_id"], "start_us", "end_us")


_REACH = 7200 * SECOND


@query(f"""WITH iv AS ({INTERVALS}), near AS (SELECT a.sample_id, a.event_id AS click, b.event_id AS purchase, abs(a.start_us - b.start_us) AS distance FROM iv a JOIN iv b ON a.sample_id = b.sample_id AND a.family = 'click' AND b.family = 'purchase' AND abs(a.start_us - b.start_us) <= {_REACH}),
one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY sample_id, click ORDER BY distance, purchase) = 1)
SELECT sample_id, click, purchase, distance FROM one QUALIFY row_number() OVER (PARTITION BY sample_id, purchase ORDER BY distance, click) = 1""")
def j07_nearest(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    clicks = iv.filter("family = 'click'").select("sample_id", F.col("event_id").alias("click"), "start_us")
    purchases = iv.filter("family = 'purchase'").select("sample_id", F.col("event_id").alias("purchase"), "start_us")
    return ranges.nearest(clicks, purchases, "sample_id", "click", "purchase", "start_us", _REACH)


def _masked(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    masks = iv.filter("family = 'error'").select("sample_id", (F.col("start_us") - _REACH).alias("low"), (F.col("start_us") + _REACH).alias("high"))
    calls = iv.filter("family <> 'error'").select("event_id", "family", "sample_id", "start_us")
    return ranges.point_in_range(calls, masks, "sample_id", "start_us", "low", "high", 2 * _REACH, how)


_MASK = f"WITH iv AS ({INTERVALS}) SELECT event_id, family, sample_id, start_us FROM iv a WHERE family <> 'error' AND {{}} EXISTS (SELECT 1 FROM iv m WHERE m.family = 'error' AND m.sample_id = a.sample_id AND abs(m.start_us - a.start_us) <= {_REACH})"


@query(_MASK.format("NOT"))
def j09_mask(spark, sf_dir):
    return _masked("left_anti", spark, sf_dir)


@query(_MASK.format(""))
def j10_overlap_semi(spark, sf_dir):
    return _masked("left_semi", spark, sf_dir)


_EVIDENCE = "ev AS (SELECT l_suppkey AS site, l_linestatus AS sample, count(*) FILTER (l_returnflag = 'N') AS n_ref, count(*) FILTER (l_returnflag = 'R') AS n_alt FROM lineitem GROUP BY ALL)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is evidence."""
    lines = table(spark, sf_dir, "lineitem")
    count = lambda flag: F.count(F.when(F.col("l_returnflag") == flag, 1))
    return lines.groupBy(F.col("l_suppkey").alias("site"), F.col("l_linestatus").alias("sample")).agg(count("N").alias("n_ref"), count("R").alias("n_alt"))


_GENOTYPE = f"""WITH {_EVIDENCE}, l AS (SELECT ev.*, (lgamma(n_ref + n_alt + 1) - lgamma(n_ref + 1) - lgamma(n_alt + 1)) / ln(10) AS choose FROM ev),
g AS (SELECT *, n_ref + n_alt = 0 AS none, choose + n_ref * log10(0.999) + n_alt * log10(0.001) AS a, choose + (n_ref + n_alt) * log10(0.5) AS b, choose + n_ref * log10(0.001) + n_alt * log10(0.999) AS c FROM l),
gt AS (SELECT site, sample, n_ref, n_alt, CASE WHEN none THEN -0.48 ELSE round(a, 6) END AS gl_0, CASE WHEN none THEN -0.48 ELSE round(b, 6) END AS gl_1, CASE WHEN none THEN -0.48 ELSE round(c, 6) END AS gl_2,
  CASE WHEN none THEN '.' WHEN a >= b AND a >= c THEN '0/0' WHEN b >= c THEN '0/1' ELSE '1/1' END AS gt FROM g)"""


@query(f"{_GENOTYPE} SELECT * FROM gt")
def j11_genotype(spark, sf_dir):
    return genotype.genotype(_evidence(spark, sf_dir)).withColumns({f"gl_{i}": F.round(f"gl_{i}", 6) for i in range(3)})


@query(f"{_GENOTYPE} SELECT site, max(gt) FILTER (sample = 'F') AS gt_f, max(gt) FILTER (sample = 'O') AS gt_o FROM gt GROUP BY site")
def k03_pivot(spark, sf_dir):
    wide = genotype.genotype(_evidence(spark, sf_dir)).groupBy("site").pivot("sample", ["F", "O"]).agg(F.max("gt"))
    return wide.withColumnsRenamed({"F": "gt_f", "O": "gt_o"})


_SUPPORT = """s AS (SELECT l_partkey AS site, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS rp5, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS rp3,
  count(*) FILTER (l_returnflag = 'R' AND l_linenumber <= 1) AS sr5, count(*) FILTER (l_returnflag = 'R' AND l_linenumber >= 6) AS sr3 FROM lineitem GROUP BY l_partkey)"""


@query(f"""WITH {_SUPPORT} SELECT *, CASE WHEN sr5 > 0 OR sr3 > 0 THEN 2 ELSE 1 END AS call_class FROM s WHERE sr5 >= 5 OR sr3 >= 5 OR (rp5 >= 9 AND rp3 >= 9) OR ((rp5 >= 9 OR rp3 >= 9) AND (sr5 > 0 OR sr3 > 0))""")
def f11_call_filter(spark, sf_dir):
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    count = lambda c: F.count(F.when(c, 1))
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(
        count((flag == "A") & (status == "F")).alias("rp5"), count((flag == "N") & (status == "O")).alias("rp3"), count((flag == "R") & (line <= 1)).alias("sr5"), count((flag == "R") & (line >= 6)).alias("sr3")
    )
    return genotype.call_filter(calls, min_pairs=9)


@query(f"""WITH iv AS ({INTERVALS}), d AS (SELECT family, start_us AS pos, 1 AS d FROM iv UNION ALL SELECT family, end_us, -1 FROM iv), s AS (SELECT family, pos, sum(d) AS d FROM d GROUP BY ALL)
SELECT family, pos, (sum(d) OVER (PARTITION BY family ORDER BY pos))::BIGINT AS depth FROM s""")
def b02_depth(spark, sf_dir):
    return ranges.depth(intervals(spark, sf_dir), ["family"], "start_us", "end_us")


@query(f"WITH a AS ({ALIGNMENTS}) SELECT read_group, count(*) AS n FROM a WHERE (NOT (flag & 16 <> 0) OR map_qual >= 5) AND (frag_len > 25 OR flag & 1024 <> 0) AND ref_id <> 3 GROUP BY read_group")
def b03_filter_rules(spark, sf_dir):
    properties = {"reverse": A.has(F.col("flag"), A.REVERSE), "sure": F.col("map_qual") >= 5, "long": F.col("frag_len") > 25, "dup": A.has(F.col("flag"), A.DUPLICATE), "decoy": F.col("ref_id") == 3}
    kept = alignments(spark, sf_dir).filter(toolkit.compile_rule("(!reverse | sure) & (long | dup) & !decoy", properties))
    return kept.groupBy("read_group").agg(F.count("*").alias("n"))


@query(f"""WITH a AS ({ALIGNMENTS}) SELECT count(*) AS total, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1 <> 0) AS paired,
  count(*) FILTER (flag & 64 <> 0) AS first, count(*) FILTER (flag & 128 <> 0) AS second, count(*) FILTER (flag & 16 <> 0) AS reverse, count(*) FILTER (flag & 512 <> 0) AS failed FROM a""")
def v03_flag_statistics(spark, sf_dir):
    return toolkit.flag_statistics(alignments(spark, sf_dir))


@query(f"""SELECT read_group, orientation, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY read_group ORDER BY n DESC, orientation) AS rank FROM (
  SELECT read_group, (CASE WHEN flag & 64 <> 0 THEN 0 ELSE 4 END + CASE WHEN flag & 16 <> 0 THEN 2 ELSE 0 END + CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END) AS orientation, count(*) AS n FROM ({ALIGNMENTS}) GROUP BY ALL)) WHERE rank <= 2""")
def b08_top_models(spark, sf_dir):
    return toolkit.top_models(alignments(spark, sf_dir).withColumn("orientation", A.orientation(F.col("flag"))), "read_group", "orientation")


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_HASH} % 1024 < 256")
def v02_subsample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return toolkit.subsample(orders, F.col("o_orderkey").cast("string"), 0.25)


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n, count(c_custkey) FILTER (c_acctbal < 0) AS unmapped FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def v04_index_statistics(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("unmapped"))
    named = table(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return named.select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


@query("""SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, epoch_us(ts) // 60000000 ORDER BY value DESC, event_id) = 1""")
def v07_drop_duplicates(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("minute", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000))
    kept = toolkit.drop_duplicates(events, ["user_id", "event_type", "minute"], [-F.col("value"), F.col("event_id")])
    return kept.select("event_id", "user_id", "event_type", "value")


@query(f"""WITH a AS (SELECT name, line, read_group % 3 AS ref_id, pos, pos + frag_len AS e, flag, row_number() OVER (PARTITION BY name ORDER BY line, read_group % 3, pos, pos + frag_len, flag) - 1 AS k FROM ({ALIGNMENTS})),
p AS (SELECT a.*, b.ref_id AS mr, b.pos AS mp, b.flag AS mf, CASE WHEN b.flag & 16 <> 0 THEN b.e ELSE b.pos END AS m5, CASE WHEN a.flag & 16 <> 0 THEN a.e ELSE a.pos END AS o5 FROM a LEFT JOIN a b ON a.name = b.name AND b.k = xor(a.k, 1))
SELECT name, line, coalesce(mr, -1) AS mate_ref, coalesce(mp, -1) AS mate_pos, CASE WHEN mr = ref_id THEN m5 - o5 ELSE 0 END AS insert,
  CASE WHEN mf IS NULL THEN (flag & ~34) | 8 ELSE (flag & ~32) | CASE WHEN mf & 16 <> 0 THEN 32 ELSE 0 END END AS flag FROM p""")
def v09_fix_mates(spark, sf_dir):
    records = alignments(spark, sf_dir).select("name", "line", (F.col("read_group") % 3).alias("ref_id"), "pos", (F.col("pos") + F.col("frag_len")).alias("end"), "flag")
    return toolkit.fix_mates(records, "name", ["line", "ref_id", "pos", "end", "flag"]).select("name", "line", "mate_ref", "mate_pos", "insert", "flag")


@query(f"WITH t AS (SELECT family, unnest(range(start_us // {60 * SECOND}, (end_us - 1) // {60 * SECOND} + 1)) AS tile FROM ({INTERVALS}) WHERE end_us > start_us) SELECT family, tile, count(*) AS n FROM t GROUP BY ALL")
def x12_tiles(spark, sf_dir):
    covered = ranges.tiles(intervals(spark, sf_dir).filter("end_us > start_us"), "start_us", "end_us", 60 * SECOND)
    return covered.groupBy("family", "tile").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT map_qual, count(*) AS n FROM ({ALIGNMENTS}) GROUP BY map_qual) SELECT map_qual, n, round(sum(n) OVER (ORDER BY map_qual DESC) / sum(n) OVER (), 6) AS share FROM a""")
def x10_quality_statistics(spark, sf_dir):
    counts = alignments(spark, sf_dir).groupBy("map_qual").agg(F.count("*").alias("n"))
    # windows over the few distinct qualities, not over records
    return counts.select("map_qual", "n", F.round(F.sum("n").over(Window.orderBy(F.desc("map_qual"))) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(f"""WITH iv AS ({INTERVALS}) SELECT family, count(*) AS n, round(avg(start_us - p), 3) AS mean_gap, max(start_us - p) AS max_gap FROM (SELECT family, start_us, lag(start_us) OVER (PARTITION BY family, sample_id ORDER BY start_us, event_id) AS p FROM iv) GROUP BY family""")
def x09_gaps(spark, sf_dir):
    iv = intervals(spark, sf_dir).withColumn("gap", F.col("start_us") - F.lag("start_us").over(Window.partitionBy("family", "sample_id").orderBy("start_us", "event_id")))
    return iv.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("mean_gap"), F.max("gap").alias("max_gap"))


@query(f"SELECT family, sample_id, event_id, start_us FROM ({INTERVALS}) WHERE family IN ('click', 'purchase') UNION ALL SELECT 'late_' || family, sample_id, event_id, end_us FROM ({INTERVALS}) WHERE family = 'error'")
def k04_merge_streams(spark, sf_dir):
    iv = intervals(spark, sf_dir)
    late = iv.filter("family = 'error'").select(F.concat(F.lit("late_"), "family").alias("family"), "sample_id", "event_id", F.col("end_us").alias("start_us"))
    return iv.filter(F.col("family").isin("click", "purchase")).select("family", "sample_id", "event_id", "start_us").unionByName(late)


@query()
def u01_smith_waterman(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", F.floor(F.col("turn") / 2).alias("pair")).alias("name"), (F.col("turn") % 2).alias("half"), bases(F.col("text")).alias("seq"))
    paired = materialize(toolkit.mates(turns, "name", F.col("half") == 0, F.col("half") == 1, ["seq"]), "turns")
    cells = paired.agg(F.sum(F.length("seq_1").cast("long") * F.length("seq_2"))).first()[0]
    paired = dealt_by_work(paired, cells)
    return paired.select("name.conv_id", "name.pair", pairwise.local_alignment(F.col("seq_1"), F.col("seq_2")).alias("a")).select("conv_id", "pair", "a.*")


@query(f"""WITH s AS (SELECT sample_id, sum(CASE WHEN end_us - start_us >= {50 * SECOND} THEN 2 ELSE -4 END) OVER (PARTITION BY sample_id ORDER BY start_us, event_id ROWS UNBOUNDED PRECEDING) AS s, start_us, event_id FROM ({INTERVALS})),
r AS (SELECT sample_id, s - least(coalesce(min(s) OVER (PARTITION BY sample_id ORDER BY start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rise FROM s)
SELECT sample_id, max(greatest(rise, 0))::BIGINT AS best FROM r GROUP BY sample_id""")
def c09_best_run(spark, sf_dir):
    score = F.when(F.col("end_us") - F.col("start_us") >= 50 * SECOND, 2).otherwise(-4)
    return ranges.best_run(intervals(spark, sf_dir), "sample_id", ["start_us", "event_id"], score)


@query(f"""{_GENOTYPE} SELECT site, sum(length(gt) - length(replace(gt, '1', '')))::BIGINT AS ac, sum(CASE WHEN gt = '.' THEN 0 ELSE 2 END)::BIGINT AS an FROM gt GROUP BY site""")
def x08_allele_counts(spark, sf_dir):
    return population.allele_counts(genotype.genotype(_evidence(spark, sf_dir)), "site", "gt")


@query()
def x02_allele_frequency(spark, sf_dir):
    called = genotype.genotype(_evidence(spark, sf_dir)).filter("gt <> '.'")
    # a site has one row a sample, so its array is as long as the list of samples
    sites = called.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("sample", "gl_0", "gl_1", "gl_2"))).alias("gl"))
    return sites.select("site", F.round(population.allele_frequency(F.col("gl")), 6).alias("frequency"))


_CHANCE = "(lgamma(a + b + 1) - lgamma({k} + 1) - lgamma(a + b - {k} + 1) + lgamma(c + d + 1) - lgamma(a + c - {k} + 1) - lgamma(d - a + {k} + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))"


@query(f"""WITH t AS (SELECT l_suppkey AS site, l_returnflag = 'N' AS f, l_linenumber > 3 AS late FROM lineitem),
s AS (SELECT site, count(*) FILTER (f AND late) AS a, count(*) FILTER (f AND NOT late) AS b, count(*) FILTER (NOT f AND late) AS c, count(*) FILTER (NOT f AND NOT late) AS d FROM t GROUP BY site),
k AS (SELECT *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: {_CHANCE.format(k='k')}) AS chances, {_CHANCE.format(k='a')} AS own FROM s)
SELECT site, a, b, c, d, round(list_sum(list_transform(list_filter(chances, lambda x: x <= own + 1e-7), lambda x: exp(x))), 6) AS p FROM k""")
def x05_fisher(spark, sf_dir):
    flag, status = F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
    count = lambda c: F.count(F.when(c, 1))
    cells = table(spark, sf_dir, "lineitem").withColumn("late", F.col("l_linenumber") > 3).groupBy(F.col("l_suppkey").alias("site")).agg(
        count(flag & F.col("late")).alias("a"), count(flag & ~F.col("late")).alias("b"), count(~flag & F.col("late")).alias("c"), count(~flag & ~F.col("late")).alias("d")
    )
    return cells.withColumn("p", F.round(population.fisher_exact(*[F.col(x) for x in "abcd"]), 6))


@query(f"SELECT read_group, count(*) AS n FROM ({ALIGNMENTS}) WHERE ref_id = 2 AND pos < 900 AND pos + frag_len > 100 GROUP BY read_group")
def s02_region_scan(spark, sf_dir):
    inside = ranges.in_region("2:101-900", F.col("ref_id").cast("string"), F.col("pos"), F.col("pos") + F.col("frag_len"))
    return alignments(spark, sf_dir).filter(inside).groupBy("read_group").agg(F.count("*").alias("n"))
