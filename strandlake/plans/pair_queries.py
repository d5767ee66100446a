"""Queries over read pairs: filters, roles, derived values, mates and the small aggregations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions import pairs as P
from strandlake.operators import mates, pileup, toolkit

from .catalogue import query
from .views import CIGAR, PAIRS, pairs, table

c = F.col
_P = f"p AS (SELECT *, {CIGAR} AS cigar FROM ({PAIRS}))"
_BASIC = "flag & 1 <> 0 AND flag & 12 <> 12 AND flag & 512 = 0 AND flag & 1024 = 0 AND ref_id >= 0 AND mate_ref >= 0 AND CAST(name AS STRING) NOT IN ('0', '*')"
_ORIENT = "(CASE WHEN flag & 64 <> 0 THEN 0 ELSE 4 END + CASE WHEN flag & 16 <> 0 THEN 2 ELSE 0 END + CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END)"
_TYPE = f"CASE {_ORIENT} WHEN 0 THEN 'INVERTED3' WHEN 1 THEN 'NORMAL' WHEN 3 THEN 'INVERTED5' WHEN 4 THEN 'INVERTED3' WHEN 5 THEN 'NORMAL' WHEN 7 THEN 'INVERTED5' WHEN 2 THEN 'REVERSED' WHEN 6 THEN 'REVERSED' END"
_LIBS = """libs AS (SELECT read_group, floor(median(frag_len))::INT AS med, min(frag_len) AS low, max(frag_len) AS high FROM p WHERE frag_len > 0 GROUP BY read_group)"""


def _by_group(kept: DataFrame) -> DataFrame:
    return kept.groupBy("read_group").agg(F.count("*").alias("n"))


def _named() -> tuple:
    return c("flag"), c("ref_id"), c("mate_ref"), c("name").cast("string")


@query(f"WITH {_P} SELECT read_group, count(*) AS n FROM p WHERE {_BASIC} GROUP BY read_group")
def f01_basic_pairs(spark, sf_dir):
    return _by_group(pairs(spark, sf_dir).filter(P.basic_pair(*_named())))


@query(f"WITH {_P} SELECT read_group, count(*) AS n FROM p WHERE {_BASIC} AND flag & 268 = 0 GROUP BY read_group")
def f02_scan_pairs(spark, sf_dir):
    return _by_group(pairs(spark, sf_dir).filter(P.scan_pair(*_named())))


@query(f"""WITH {_P} SELECT CASE WHEN NOT ({_BASIC}) THEN 'none' WHEN code IS NULL AND mate_code IS NULL THEN 'untagged' WHEN lead_clip >= 6 OR trail_clip >= 6 THEN 'split' WHEN {_TYPE} = 'NORMAL' THEN 'normal' ELSE 'common' END AS variant, count(*) AS n FROM p GROUP BY 1""")
def f03_filter_variants(spark, sf_dir):
    clips = A.clips(A.cigar_sums(c("cigar")))
    variant = F.when(~P.basic_pair(*_named()), "none").when(c("code").isNull() & c("mate_code").isNull(), "untagged").when((clips["lead"] >= 6) | (clips["trail"] >= 6), "split")
    variant = variant.when(P.pair_type(A.orientation(c("flag"))) == "NORMAL", "normal").otherwise("common")
    return pairs(spark, sf_dir).groupBy(variant.alias("variant")).agg(F.count("*").alias("n"))


_REFS = "refs AS (SELECT p_partkey AS ref_id, CASE p_partkey % 5 WHEN 0 THEN 'GL0' WHEN 1 THEN 'NC_' WHEN 2 THEN 'hs' ELSE 'chr' END || CAST(p_partkey AS STRING) AS name, p_size AS length, p_brand AS brand FROM part)"


def _summed(spark, sf_dir) -> DataFrame:
    """Pairs with `sums`, what is summed over each CIGAR."""
    return pairs(spark, sf_dir).withColumn("sums", A.cigar_sums(c("cigar")))


def _refs(spark, sf_dir) -> DataFrame:
    lead = F.when(c("p_partkey") % 5 == 0, "GL0").when(c("p_partkey") % 5 == 1, "NC_").when(c("p_partkey") % 5 == 2, "hs").otherwise("chr")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("ref_id"), F.concat(lead, c("p_partkey").cast("string")).alias("name"), c("p_size").alias("length"), c("p_brand").alias("brand"))


@query(f"WITH {_REFS} SELECT ref_id, name, CASE WHEN name SIMILAR TO '(GL0|NC_|NT_|hs).*' THEN -1 ELSE length END AS length FROM refs")
def f04_unused_references(spark, sf_dir):
    return _refs(spark, sf_dir).select("ref_id", "name", F.when(P.unused_reference(c("name")), -1).otherwise(c("length")).alias("length"))


@query(f"WITH {_REFS} SELECT count(*) FILTER (length > 20 AND NOT name SIMILAR TO '(GL0|NC_|NT_|hs).*' AND brand <> 'Brand#1') AS usable, count(*) AS n FROM refs")
def a16_usable_references(spark, sf_dir):
    good = (c("length") > 20) & ~P.unused_reference(c("name")) & (c("brand") != "Brand#1")
    return _refs(spark, sf_dir).agg(F.count_if(good).alias("usable"), F.count("*").alias("n"))


@query(f"WITH {_P} SELECT read_group, count(*) AS n FROM p JOIN supplier ON s_suppkey = read_group AND s_acctbal >= 0 WHERE flag & 4 <> 0 AND flag & 8 = 0 AND mate_qual >= 3 GROUP BY read_group")
def f05_orphans(spark, sf_dir):
    good = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0").select(c("s_suppkey").alias("read_group"))
    return _by_group(pairs(spark, sf_dir).filter(P.orphan(c("flag"), c("mate_qual"), 3)).join(good, "read_group", "left_semi"))


def _libraries(spark, sf_dir) -> DataFrame:
    own = pairs(spark, sf_dir).filter("frag_len > 0").groupBy("read_group", "frag_len").agg(F.count("*").alias("n"))
    return own.groupBy("read_group").agg(F.expr("CAST(floor(percentile(frag_len, 0.5, n)) AS INT)").alias("med"), F.min("frag_len").alias("low"), F.max("frag_len").alias("high"))


@query(f"WITH {_P}, {_LIBS}, f AS (SELECT read_group, CASE WHEN high - low > 48 THEN 0 ELSE med END AS med, CASE WHEN high - low > 48 THEN 0 ELSE high END AS high FROM libs) SELECT read_group, med, high, max(high) OVER () AS longest FROM f")
def f07_library_quality(spark, sf_dir):
    wide = c("high") - c("low") > 48
    kept = _libraries(spark, sf_dir).select("read_group", F.when(wide, 0).otherwise(c("med")).alias("med"), F.when(wide, 0).otherwise(c("high")).alias("high"))
    return kept.withColumn("longest", F.lit(kept.agg(F.max("high")).first()[0]))


@query(f"WITH {_P} SELECT read_group, frag_len, count(*) AS n FROM p WHERE map_qual >= 2 AND mate_qual >= 2 AND {_TYPE} = 'NORMAL' AND ref_id = mate_ref GROUP BY ALL")
def f08_normal_pairs(spark, sf_dir):
    normal = P.normal_pair(A.orientation(c("flag")), c("map_qual"), c("mate_qual"), 2, c("ref_id") == c("mate_ref"))
    return pairs(spark, sf_dir).filter(normal).groupBy("read_group", "frag_len").agg(F.count("*").alias("n"))


@query(f"WITH {_P}, {_LIBS} SELECT read_group, count(*) AS n FROM p JOIN libs USING (read_group) WHERE (code IS NULL) <> (mate_code IS NULL) AND NOT (ref_id = mate_ref AND abs(mate_pos - pos) BETWEEN low - (med - low) AND high + (high - med)) GROUP BY read_group")
def f09_special_distance(spark, sf_dir):
    special = pairs(spark, sf_dir).filter(c("code").isNull() != c("mate_code").isNull()).join(_libraries(spark, sf_dir), "read_group")
    return _by_group(special.filter(~P.near_enough(c("ref_id") == c("mate_ref"), F.abs(c("mate_pos") - c("pos")), c("low"), c("med"), c("high"))))


@query(f"WITH {_P} SELECT {_TYPE} AS kind, count(*) AS n, count(*) FILTER (frag_len >= 30) AS significant FROM p WHERE {_TYPE} IN ('INVERTED3', 'INVERTED5') GROUP BY 1")
def f12_significant_inversions(spark, sf_dir):
    typed = pairs(spark, sf_dir).withColumn("kind", P.pair_type(A.orientation(c("flag")))).filter(c("kind").isin("INVERTED3", "INVERTED5"))
    return typed.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(c("frag_len") >= 30).alias("significant"))


@query(f"WITH {_P} SELECT read_group, count(*) AS n FROM p WHERE flag & 4 <> 0 OR ref_id <> mate_ref OR (lead_clip > 0)::INT + 1 + (n_del > 0)::INT + 2 + (trail_clip > 0)::INT > 5 OR lead_clip + trail_clip > 0.15::DOUBLE * (lead_clip + frag_len + 9 + trail_clip) GROUP BY read_group")
def f14_problematic(spark, sf_dir):
    # a filter would be pushed below `sums` and parse the CIGAR once for each value that it asks for
    found = P.problematic(c("flag"), c("ref_id"), c("mate_ref"), c("sums"))
    return _summed(spark, sf_dir).groupBy("read_group").agg(F.count_if(found).alias("n")).filter("n > 0")


@query(f"WITH {_P} SELECT {_TYPE} AS kind, count(*) AS n FROM p WHERE {_TYPE} IN ('INVERTED3', 'REVERSED') GROUP BY 1")
def f17_detection_set(spark, sf_dir):
    wanted = P.detection_set(0b101, ["INVERTED3", "INVERTED5", "REVERSED"])
    typed = pairs(spark, sf_dir).select(P.pair_type(A.orientation(c("flag"))).alias("kind"))
    return typed.filter(c("kind").isin(wanted)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_P} SELECT CASE WHEN flag & 4 <> 0 THEN 'orphan' WHEN map_qual >= 4 AND lead_clip < 6 AND trail_clip < 6 THEN 'anchor' WHEN (lead_clip >= 6)::INT + (trail_clip >= 6)::INT = 1 THEN 'soft'
  WHEN (n_del + 2 + lead_clip + trail_clip)::DOUBLE / (lead_clip + frag_len + 9 + trail_clip) <= 0.2::DOUBLE THEN 'multiple' ELSE 'none' END AS role, count(*) AS n FROM p GROUP BY 1""")
def f18_roles(spark, sf_dir):
    return _summed(spark, sf_dir).groupBy(P.role(c("flag"), c("map_qual"), c("sums"), 4, 6, 0.2).alias("role")).agg(F.count("*").alias("n"))


@query(f"""WITH {_P} SELECT name, line, '<@;' || map_qual || ';;' || coalesce(code, '') || ';1;' || cigar || ';>' || '<&;' || mate_qual || ';;' || coalesce(mate_code, '') || ';1;;>' AS tag, code, mate_code FROM p""")
def p02_mate_tags(spark, sf_dir):
    none = F.lit(None).cast("string")
    own = P.format_mate_tag(c("map_qual"), none, c("code"), F.lit(1), c("cigar"), none, F.lit(False))
    tag = F.concat(own, P.format_mate_tag(c("mate_qual"), none, c("mate_code"), F.lit(1), none, none, F.lit(True)))
    # the codes come back from the tag as it is parsed
    read = pairs(spark, sf_dir).select("name", "line", tag.alias("tag")).withColumn("halves", A.mate_tag(c("tag")))
    return read.select("name", "line", "tag", F.get("halves", F.lit(0))["special"].alias("code"), F.get("halves", F.lit(1))["special"].alias("mate_code"))


@query(f"""WITH {_P} SELECT read_group, sum(n_del + 2)::BIGINT AS mismatches, sum(frag_len + 7 + n_del)::BIGINT AS ref_bases, sum(lead_clip)::BIGINT AS lead, sum(trail_clip)::BIGINT AS trail, max(pos + frag_len + 7 + n_del)::BIGINT AS last_end,
  round(avg((n_del + 2 + lead_clip + trail_clip)::DOUBLE / (lead_clip + frag_len + 9 + trail_clip)), 6) AS rate FROM p GROUP BY read_group""")
def p03_cigar_values(spark, sf_dir):
    own = c("sums")
    total = lambda x: F.sum(x.cast("long"))
    return _summed(spark, sf_dir).groupBy("read_group").agg(
        total(A.mismatches(own, F.lit(""))).alias("mismatches"), total(A.sum_of(own, "DMN=X")).alias("ref_bases"), total(own["lead"]).alias("lead"), total(own["trail"]).alias("trail"),
        F.max(A.alignment_end(c("pos"), own)).alias("last_end"), F.round(F.avg(P.mismatch_rate(own)), 6).alias("rate"),
    )


@query(f"""WITH {_P} SELECT read_group, sum(CASE WHEN code IS NOT NULL THEN mate_pos + frag_len + 7 + n_del - 1 WHEN trail_clip > 0 THEN pos + frag_len - 1 ELSE mate_pos + 49 END)::BIGINT AS ends, count(*) FILTER (ref_id < mate_ref OR ref_id = mate_ref AND pos <= mate_pos) AS upstream,
  sum(CASE WHEN ref_id = mate_ref THEN abs(insert_size) ELSE -1 END)::BIGINT AS lengths FROM p GROUP BY read_group""")
def p05_mate_ends(spark, sf_dir):
    end = P.mate_end(c("mate_pos"), F.when(c("code").isNotNull(), c("cigar")), F.when(c("trail_clip") > 0, c("pos") + c("frag_len") - 1), F.lit(50))
    up = P.is_upstream(c("ref_id"), c("pos"), c("mate_ref"), c("mate_pos"))
    return pairs(spark, sf_dir).groupBy("read_group").agg(F.sum(end).alias("ends"), F.count_if(up).alias("upstream"), F.sum(A.fragment_length(c("ref_id"), c("mate_ref"), c("insert_size")).cast("long")).alias("lengths"))


@query(f"WITH {_P} SELECT name, line, (CASE WHEN lead_clip > 0 THEN lead_clip * 16 + 4 ELSE 0 END + frag_len * 16 + CASE WHEN n_del > 0 THEN n_del * 16 + 2 ELSE 0 END + 33 + 112 + CASE WHEN trail_clip > 0 THEN trail_clip * 16 + 4 ELSE 0 END)::BIGINT AS encoded FROM p")
def p08_encoded_cigars(spark, sf_dir):
    return pairs(spark, sf_dir).select("name", "line", F.aggregate(P.encode_cigar(c("cigar")), F.lit(0).cast("long"), lambda s, x: s + x).alias("encoded"))


@query("""WITH f AS (SELECT p_partkey, p_type AS family FROM part), z AS (SELECT DISTINCT s_nationkey AS id, substr(n_name, 1, 2) AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT family, min(p_partkey) AS first_seen, max(id) AS code_id FROM f LEFT JOIN z ON upper(substr(family, 1, 2)) = upper(code) GROUP BY family""")
def p17_family_codes(spark, sf_dir):
    families = table(spark, sf_dir, "part").groupBy(c("p_type").alias("family")).agg(F.min("p_partkey").alias("first_seen"))
    codes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("s_nationkey").alias("id"), F.substring("n_name", 1, 2).alias("code"))
    last = codes.groupBy(F.upper("code").alias("key")).agg(F.max("id").alias("code_id"))
    return families.join(last, F.upper(F.substring("family", 1, 2)) == c("key"), "left").select("family", "first_seen", "code_id")


@query(f"WITH {_REFS} SELECT ref_id, name, (sum(length + 300) OVER (ORDER BY ref_id) - length - 300)::BIGINT AS begins, (sum(length + 300) OVER (ORDER BY ref_id) - 300)::BIGINT AS ends FROM refs")
def p18_concatenated_coordinates(spark, sf_dir):
    return mates.concatenated(_refs(spark, sf_dir), "ref_id", "length", pad=300).select("ref_id", "name", "begins", "ends")


@query(f"WITH {_P}, r AS (SELECT read_group, map_qual, row_number() OVER (PARTITION BY read_group ORDER BY map_qual) AS k, count(*) OVER (PARTITION BY read_group) AS n FROM p) SELECT read_group, avg(map_qual) FILTER (k IN ((n + 1) // 2, n // 2 + 1)) AS median, min(map_qual) FILTER (k = (n + 9) // 10) AS tenth FROM r GROUP BY read_group")
def p23_medians(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("read_group").agg(F.expr("percentile(map_qual, 0.5)").alias("median"), F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY map_qual)").alias("tenth"))


@query(f"WITH {_P} SELECT CASE WHEN lead_clip < 5 THEN '3''' WHEN 50 - frag_len <= 5 THEN '5''' ELSE 'unknown' END AS side, count(*) AS n FROM p GROUP BY 1")
def p24_partial_types(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(A.partial_type(c("lead_clip"), c("frag_len"), F.lit(50)).alias("side")).agg(F.count("*").alias("n"))


@query(f"""WITH {_P}, w AS (SELECT read_group, greatest(CASE WHEN flag & 16 = 0 THEN pos + frag_len + 1 - 10 ELSE pos + frag_len - 40 - 20 END, 0) AS low, least(CASE WHEN flag & 16 = 0 THEN pos + 40 + 20 ELSE pos - 1 + 10 END, 999) AS high FROM p)
SELECT read_group, sum(low)::BIGINT AS lows, sum(high)::BIGINT AS highs, count(*) FILTER (high - low + 1 >= 10) AS holding FROM w GROUP BY read_group""")
def p26_search_windows(spark, sf_dir):
    window = P.split_window(~A.has(c("flag"), A.REVERSE), c("pos"), c("pos") + c("frag_len"), F.lit(10), F.lit(40), F.lit(1000))
    own = pairs(spark, sf_dir).select("read_group", window.alias("w"))
    return own.groupBy("read_group").agg(F.sum("w.low").alias("lows"), F.sum("w.high").alias("highs"), F.count_if(c("w.high") - c("w.low") + 1 >= 10).alias("holding"))


@query(f"WITH {_P} SELECT max(frag_len) AS longest, count(DISTINCT read_group) AS libraries FROM p WHERE frag_len > 0")
def a04_longest_fragment(spark, sf_dir):
    return _libraries(spark, sf_dir).agg(F.max("high").alias("longest"), F.count("*").alias("libraries"))


@query(f"WITH {_P}, o AS (SELECT coalesce(code, mate_code) AS code, name * 10 + line AS place FROM p WHERE (code IS NULL) <> (mate_code IS NULL)) SELECT code, min(place) AS first_seen, row_number() OVER (ORDER BY min(place), code) - 1 AS id FROM o GROUP BY code")
def a05_special_codes(spark, sf_dir):
    one = pairs(spark, sf_dir).filter(c("code").isNull() != c("mate_code").isNull()).select(F.coalesce("code", "mate_code").alias("code"), (c("name") * 10 + c("line")).alias("place"))
    return mates.numbered(one.groupBy("code").agg(F.min("place").alias("first_seen")), ["first_seen", "code"], "id")


@query(f"WITH {_P}, k AS (SELECT {_TYPE} AS kind, coalesce(code, '') AS family, count(*) AS n FROM p GROUP BY ALL) SELECT kind, family, n, (sum(n) OVER (PARTITION BY kind ORDER BY family) - n)::BIGINT AS before FROM k")
def a14_counts_before(spark, sf_dir):
    counts = pairs(spark, sf_dir).groupBy(P.pair_type(A.orientation(c("flag"))).alias("kind"), F.coalesce("code", F.lit("")).alias("family")).agg(F.count("*").alias("n"))
    return counts.withColumn("before", F.sum("n").over(Window.partitionBy("kind").orderBy("family")) - c("n"))


_EVENT = "name % 50 AS cluster, CASE WHEN flag & 16 = 0 THEN 3 ELSE 5 END AS side"


@query(f"""WITH {_P}, e AS (SELECT {_EVENT}, CASE WHEN flag & 16 = 0 THEN pos ELSE pos + frag_len + 1 - 30 END AS b5, CASE WHEN flag & 16 = 0 THEN pos + frag_len ELSE pos + frag_len + 12 + 1 - 30 END AS e5, CASE WHEN flag & 16 = 0 THEN pos + 30 - 12 ELSE pos END AS b3, CASE WHEN flag & 16 = 0 THEN pos + 29 ELSE pos + frag_len END AS e3 FROM p)
SELECT cluster, side, min(b5) AS start5, max(e5) AS end5, min(b3) AS start3, max(e3) AS end3, count(*) AS members, floor(sum((e5 - b5) + (e3 - b3))::DOUBLE / (2 * count(*)) + 0.5)::BIGINT AS uncertainty, CASE WHEN side = 3 THEN max(e5) ELSE min(b3) END AS pos FROM e GROUP BY cluster, side""")
def a08_event_extents(spark, sf_dir):
    rows = pairs(spark, sf_dir).select((c("name") % 50).alias("cluster"), F.when(~A.has(c("flag"), A.REVERSE), 3).otherwise(5).alias("side"), "pos", (c("pos") + c("frag_len")).alias("end"))
    return mates.event_extents(rows, ["cluster"], median=F.lit(30), mate_length=F.lit(12))


@query(f"WITH {_P}, o AS (SELECT name, line, ref_id, mate_ref, pos, flag, row_number() OVER (PARTITION BY name ORDER BY line, ref_id, pos, flag, mate_ref) AS k FROM p WHERE ref_id <> mate_ref) SELECT a.name, a.ref_id, b.ref_id AS other, count(*) AS n FROM o a JOIN o b ON a.name = b.name AND a.mate_ref = b.ref_id AND b.mate_ref = a.ref_id AND a.k < b.k GROUP BY ALL")
def j02_cross_mates(spark, sf_dir):
    w = Window.partitionBy("name").orderBy("line", "ref_id", "pos", "flag", "mate_ref")
    own = pairs(spark, sf_dir).filter("ref_id <> mate_ref").select("name", "line", "ref_id", "mate_ref", "pos", "flag").withColumn("k", F.row_number().over(w))
    return mates.cross_mates(own, "name", "k").groupBy("name", "ref_id", "other").agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT a.ref_id, count(*) AS n, sum(b.pos - a.pos)::BIGINT AS span FROM p a JOIN p b ON a.name = b.name AND a.ref_id = b.ref_id AND a.pos < b.pos GROUP BY a.ref_id")
def j03_upstream_probe(spark, sf_dir):
    own = pairs(spark, sf_dir).select("name", "ref_id", "pos")
    return mates.windowed_mates(own, ["name", "ref_id"], "pos").groupBy("ref_id").agg(F.count("*").alias("n"), F.sum("distance").alias("span"))


@query(f"WITH {_P} SELECT a.ref_id, count(*) AS n, sum(b.pos - a.pos)::BIGINT AS span FROM p a JOIN p b ON a.name = b.name AND a.ref_id = b.ref_id AND a.pos < b.pos AND b.pos - a.pos < 400 GROUP BY a.ref_id")
def j04_window_mates(spark, sf_dir):
    own = pairs(spark, sf_dir).select("name", "ref_id", "pos")
    return mates.windowed_mates(own, ["name", "ref_id"], "pos", reach=400).groupBy("ref_id").agg(F.count("*").alias("n"), F.sum("distance").alias("span"))


@query("SELECT name, count(DISTINCT v) AS n_values, min(v) AS low, max(v) AS high FROM (SELECT c_mktsegment AS name, c_nationkey AS v FROM customer UNION ALL SELECT p_type, p_size FROM part) GROUP BY name HAVING count(DISTINCT v) > 1")
def j13_key_conflicts(spark, sf_dir):
    one, two = table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("name"), c("c_nationkey").alias("v")), table(spark, sf_dir, "part").select(c("p_type").alias("name"), c("p_size").alias("v"))
    return mates.conflicts([one, two], "name", "v")


@query("WITH n AS (SELECT c_custkey, CASE WHEN c_nationkey < 23 THEN 'chr' || c_nationkey WHEN c_nationkey = 23 THEN 'chrX' ELSE 'chrUn' END AS chrom, floor(c_acctbal)::BIGINT AS pos FROM customer) SELECT c_custkey, chrom, pos, row_number() OVER (ORDER BY CASE WHEN chrom = 'chrX' THEN 23 WHEN chrom = 'chrUn' THEN 0 ELSE substr(chrom, 4)::INT END, pos, c_custkey) AS place FROM n")
def o02_call_order(spark, sf_dir):
    key = c("c_nationkey")
    chrom = F.when(key < 23, F.concat(F.lit("chr"), key.cast("string"))).when(key == 23, "chrX").otherwise("chrUn")
    calls = table(spark, sf_dir, "customer").select("c_custkey", chrom.alias("chrom"), F.floor("c_acctbal").alias("pos")).withColumn("rank", P.chromosome_rank(c("chrom")))
    return mates.placed(calls, ["rank", "pos", "c_custkey"], "place").select("c_custkey", "chrom", "pos", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS place FROM part")
def o04_natural_order(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", P.natural_key(F.concat(F.lit("r"), c("p_size").cast("string"), F.lit("."), F.lpad(c("p_partkey").cast("string"), 12, "0"))).alias("key"))
    return mates.placed(names, ["key"], "place").select("p_partkey", "place")


@query("SELECT o_orderkey FROM orders ORDER BY md5('pick:' || o_orderkey), o_orderkey LIMIT 100")
def o05_random_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("pick:"), c("o_orderkey").cast("string"))), "o_orderkey").limit(100)


@query("SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT c_mktsegment AS name FROM customer UNION SELECT p_type FROM part UNION SELECT o_orderpriority FROM orders)")
def o07_distinct_union(spark, sf_dir):
    names = [table(spark, sf_dir, t).select(c(k).alias("name")).distinct() for t, k in (("customer", "c_mktsegment"), ("part", "p_type"), ("orders", "o_orderpriority"))]
    return mates.numbered(names[0].union(names[1]).union(names[2]).distinct(), ["name"], "id")


@query(f"WITH {_P} SELECT ref_id, count(*) AS n FROM p WHERE pos < 900 AND pos + frag_len > 100 GROUP BY ref_id")
def b01_count(spark, sf_dir):
    return pairs(spark, sf_dir).filter("pos < 900 AND pos + frag_len > 100").groupBy("ref_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (p_name LIKE 'small%') AS starts, count(*) FILTER (p_name LIKE '%ring') AS ends, count(*) FILTER (contains(p_name, 'd w')) AS holds, count(*) FILTER (p_type <> 'ECONOMY') AS other, count(*) FILTER (p_size >= 20) AS large, count(*) FILTER (NOT p_size < 5) AS rest FROM part")
def b04_filter_tokens(spark, sf_dir):
    t = toolkit.token_condition
    tests = {"starts": ("p_name", "small*"), "ends": ("p_name", "*ring"), "holds": ("p_name", "*d w*"), "other": ("p_type", "!ECONOMY"), "large": ("p_size", ">=20"), "rest": ("p_size", "!<5")}
    return table(spark, sf_dir, "part").agg(*[F.count_if(t(c(k), token, k == "p_size")).alias(n) for n, (k, token) in tests.items()])


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(props->>'k' AS INT) > 50 GROUP BY event_type")
def b06_tag_filter(spark, sf_dir):
    tags = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").filter(toolkit.token_condition(F.try_element_at(tags, F.lit("k")), ">50", True)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_P} SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 16 = 0) AS forward, count(*) FILTER (flag & 16 <> 0) AS reverse, count(*) FILTER (flag & 512 <> 0) AS failed, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 1 <> 0) AS paired,
  count(*) FILTER (flag & 2 <> 0) AS proper, count(*) FILTER (flag & 12 = 0) AS both_mapped, count(*) FILTER (flag & 64 <> 0) AS read_1, count(*) FILTER (flag & 128 <> 0) AS read_2, count(*) FILTER (flag & 12 = 8) AS singletons, round(avg(abs(insert_size)) FILTER (flag & 64 <> 0 AND insert_size <> 0), 6) AS mean_insert, median(abs(insert_size)) FILTER (flag & 64 <> 0 AND insert_size <> 0) AS median_insert FROM p""")
def b07_stats(spark, sf_dir):
    return toolkit.statistics(pairs(spark, sf_dir)).withColumn("mean_insert", F.round("mean_insert", 6))


@query(f"WITH {_P} SELECT name, line, coalesce(code, 'none') AS quals, flag & ~1024 AS flag FROM p")
def b12_revert(spark, sf_dir):
    records = pairs(spark, sf_dir).select("name", "line", "flag", F.lit("none").alias("quals"), F.create_map(F.lit("OQ"), c("code")).alias("tags"))
    return toolkit.revert(records).select("name", "line", "quals", "flag")


@query(f"""WITH {_P} SELECT name, line, ref_id || chr(9) || pos || chr(9) || (pos + frag_len + 7 + n_del) || chr(9) || name || chr(9) || map_qual || chr(9) || CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS bed FROM p""")
def b16_convert_bed(spark, sf_dir):
    records = _summed(spark, sf_dir).withColumn("end", A.alignment_end(c("pos"), c("sums")))
    return records.select("name", "line", toolkit.bed_line(c("ref_id"), c("pos"), c("end"), c("name"), c("map_qual"), c("flag")).alias("bed"))


@query(f"WITH {_P} SELECT read_group, count(*) AS n FROM p JOIN supplier ON s_suppkey = read_group AND s_nationkey = 3 WHERE map_qual >= 3 AND flag & 64 <> 0 AND flag & 1028 = 0 AND ref_id = 2 GROUP BY read_group")
def v01_view(spark, sf_dir):
    library = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(c("s_suppkey").alias("read_group"))
    kept = toolkit.view(pairs(spark, sf_dir).filter("ref_id = 2"), min_qual=3, required=A.FIRST, forbidden=A.DUPLICATE | A.UNMAPPED)
    return _by_group(kept.join(library, "read_group", "left_semi"))


@query(f"""WITH {_P}, q AS (SELECT *, flag & 512 <> 0 AS bad FROM p) SELECT bad, count(*) AS total, count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 1024 <> 0) AS duplicates, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1 <> 0) AS paired, count(*) FILTER (flag & 64 <> 0) AS read_1,
  count(*) FILTER (flag & 128 <> 0) AS read_2, count(*) FILTER (flag & 2 <> 0 AND flag & 4 = 0) AS proper, count(*) FILTER (flag & 12 = 0) AS both_mapped, count(*) FILTER (flag & 12 = 8) AS singletons, count(*) FILTER (flag & 12 = 0 AND ref_id <> mate_ref) AS across, count(*) FILTER (flag & 12 = 0 AND ref_id <> mate_ref AND map_qual >= 5) AS across_sure FROM q GROUP BY bad""")
def v03_flagstat(spark, sf_dir):
    return toolkit.flagstat(pairs(spark, sf_dir))


@query(f"WITH {_P}, e AS (SELECT ref_id, read_group % 3 AS sample, unnest(range(pos, pos + frag_len)) AS pos FROM p WHERE map_qual >= 4 AND flag & 1796 = 0 AND frag_len > 0) SELECT ref_id, pos, count(*) FILTER (sample = 0) AS depth_0, count(*) FILTER (sample = 1) AS depth_1, count(*) FILTER (sample = 2) AS depth_2 FROM e GROUP BY ALL")
def v05_depth(spark, sf_dir):
    kept = toolkit.view(pairs(spark, sf_dir), min_qual=4, forbidden=1796).filter("frag_len > 0").withColumns({"sample": c("read_group") % 3, "end": c("pos") + c("frag_len")})
    return pileup.depths(kept, "ref_id", "pos", "end", "sample", [0, 1, 2])


@query(f"""WITH {_P}, l AS (SELECT *, first_value(name) OVER (PARTITION BY read_group, ref_id, pos, insert_size ORDER BY map_qual DESC, name, line) AS kept FROM p WHERE insert_size > 0)
SELECT name, line, read_group, ref_id, pos, flag FROM p ANTI JOIN (SELECT DISTINCT name FROM l WHERE name <> kept) USING (name)""")
def v07_drop_pairs(spark, sf_dir):
    place = ["read_group", "ref_id", "pos", "insert_size"]
    kept = toolkit.drop_duplicate_pairs(pairs(spark, sf_dir), place, "name", c("insert_size") > 0, [-c("map_qual"), c("name"), c("line")])
    return kept.select("name", "line", "read_group", "ref_id", "pos", "flag")


@query(f"WITH {_P} SELECT name, line, read_group, ref_id, pos, flag FROM (SELECT *, row_number() OVER (PARTITION BY read_group, ref_id, flag & 16, CASE WHEN flag & 16 <> 0 THEN pos + frag_len ELSE pos END ORDER BY map_qual DESC, name, line, pos, flag, frag_len) AS k FROM p) WHERE k = 1")
def v08_single_duplicates(spark, sf_dir):
    strand = c("flag").bitwiseAND(16)
    records = pairs(spark, sf_dir).withColumns({"_strand": strand, "_place": F.when(strand != 0, c("pos") + c("frag_len")).otherwise(c("pos"))})
    kept = toolkit.drop_duplicates(records, ["read_group", "ref_id", "_strand", "_place"], [-c("map_qual"), c("name"), c("line"), c("pos"), c("flag"), c("frag_len")])
    return kept.select("name", "line", "read_group", "ref_id", "pos", "flag")


@query(f"WITH {_P} SELECT n_name AS library, count(*) AS n FROM p LEFT JOIN supplier ON s_suppkey = read_group LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def v15_library_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("read_group"), c("n_name").alias("library"))
    return _by_group(pairs(spark, sf_dir)).join(names, "read_group", "left").groupBy("library").agg(F.sum("n").alias("n"))
