"""Likelihoods and linkage over lines as bases and evidence, and calls filtered and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import callset, genotype, likelihoods, ranges
from strandlake.sources import formats
from strandlake.storage import materialize

from .catalogue import SECOND, query
from .views import INTERVALS, SEQUENCES, intervals, sequences, table

c = F.col

_OTHERS = lambda *own: " + ".join(f"s{i}" for i in range(4) if i not in own) or "0"
_OWN = lambda j, k: f"- 4.343::DOUBLE * (lgamma(n{j} + n{k} + 1) - lgamma(n{k} + 1) - lgamma(n{j} + 1) - ln(2) * (n{j} + n{k}))"
_GL = ", ".join(f"""round(greatest(0, {_OTHERS(j, k)} {_OWN(j, k) if j != k else ''}), 3) AS "gl_{'ACGT'[j]}{'ACGT'[k]}\"""" for j, k in likelihoods.PAIRS)


@query(f"""WITH b AS (SELECT l_suppkey AS site, l_partkey % 4 AS b, (l_linestatus = 'O')::INT AS s, l_quantity::INT AS q, row_number() OVER () AS id FROM lineitem),
r AS (SELECT site, b, greatest(q, 4) AS q, row_number() OVER (PARTITION BY site, b, s ORDER BY q DESC, id) - 1 AS w, row_number() OVER (PARTITION BY site, b ORDER BY q DESC, s DESC, id) - 1 AS k, count(*) OVER (PARTITION BY site) AS n FROM b),
t AS (SELECT DISTINCT n, q, k FROM r),
o AS (SELECT n, q, k, ln(pow(10, -q / 10.0::DOUBLE) / (1 - pow(10, -q / 10.0::DOUBLE))) AS odds FROM t),
x AS (SELECT n, q, k, list_sum(list_transform(range(k + 1, n + 1), lambda i: exp(lgamma(k + 1) + lgamma(n - k + 1) - lgamma(i + 1) - lgamma(n - i + 1) + (i - k) * odds))) AS beyond FROM o),
f AS (SELECT site, b, count(*) AS n, sum((0.97::DOUBLE * pow(0.83::DOUBLE, w) + 0.03::DOUBLE) * (-10 * log10(beyond / (1 + beyond)))) AS s FROM r JOIN x USING (n, q, k) GROUP BY site, b),
p AS (SELECT site, sum(n)::BIGINT AS depth, {", ".join(f"coalesce(sum(n) FILTER (b = {i}), 0) AS n{i}, coalesce(sum(s) FILTER (b = {i}), 0) AS s{i}" for i in range(4))} FROM f GROUP BY site)
SELECT site, depth, {_GL} FROM p""")
def v13_base_likelihoods(spark, sf_dir):
    base = F.expr("substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)")
    bases = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("site"), base.alias("base"), (c("l_linestatus") == "O").alias("reverse"), c("l_quantity").cast("int").alias("qual"))
    found = likelihoods.base_likelihoods(bases, ["site"])
    return found.select("site", "depth", *[F.round(x, 3).alias(x) for x in found.columns[2:]])


def _likelihoods(spark, sf_dir) -> DataFrame:
    """(pos, g0, g1, g2 of samples 1 to 7): parts as sites, line numbers as samples; a sample without evidence says nothing."""
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("pos"), c("l_linenumber").alias("sample"))
    called = genotype.genotype(lines.agg(F.count_if(c("l_returnflag") == "N").alias("n_ref"), F.count_if(c("l_returnflag") == "R").alias("n_alt")))
    p = F.struct(*[F.pow(F.lit(10.0), f"gl_{k}").alias(f"g{k}") for k in range(3)])
    none = F.struct(*[F.lit(1.0).alias(f"g{k}") for k in range(3)])
    own = [F.coalesce(F.max(F.when((c("sample") == s) & (c("gt") != "."), p)), none) for s in range(1, 8)]
    return called.groupBy("pos").agg(F.array(*own).alias("gl"))


@query()
def x03_site_linkage(spark, sf_dir):
    flat = F.flatten(F.transform("gl", lambda p: F.array(p["g0"], p["g1"], p["g2"])))
    sites = materialize(_likelihoods(spark, sf_dir).select(F.lit("1").alias("chrom"), "pos", flat.alias("gl")), "site-likelihoods")
    return likelihoods.site_linkage(sites, 5).select("chrom", "pos", "other", F.round("r2", 5).alias("r2"))


@query()
def x04_site_calls(spark, sf_dir):
    found = likelihoods.site_calls(_likelihoods(spark, sf_dir), ["pos"])
    return found.select("pos", F.round("p_variant", 6).alias("p_variant"), F.round("qual", 3).alias("qual"), F.round("mean_count", 5).alias("mean_count"), "best_count")


@query()
def x02_site_tests(spark, sf_dir):
    flat = F.flatten(F.transform("gl", lambda p: F.array(p["g0"], p["g1"], p["g2"])))
    found = likelihoods.site_tests(_likelihoods(spark, sf_dir).select("pos", flat.alias("gl")), ["pos"], 3)
    return found.select("pos", *[F.round(x, 5).alias(x) for x in found.columns[1:]])


_EVENTS = f"""iv AS ({INTERVALS}), s AS (SELECT family, event_id AS split_id, start_us AS pos FROM iv WHERE sample_id % 2 = 0),
r AS (SELECT family, event_id AS pair_id, start_us AS begins, start_us AS pos3, end_us AS pos5, (1 + sample_id % 4) * {600 * SECOND} AS reach FROM iv WHERE sample_id % 2 = 1),
m AS (SELECT split_id, pair_id, least(abs(pos - pos3), abs(pos - pos5)) AS distance FROM s JOIN r USING (family) WHERE least(abs(pos - pos3), abs(pos - pos5)) <= reach
  QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY distance, begins > pos, abs(begins - pos), pair_id) = 1)"""


def _events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events of even samples as split events, of odd ones as pair events with their own reach."""
    iv = intervals(spark, sf_dir)
    splits = iv.filter("sample_id % 2 = 0").select("family", c("event_id").alias("split_id"), c("start_us").alias("pos"))
    reach = (1 + c("sample_id") % 4) * 600 * SECOND
    return splits, iv.filter("sample_id % 2 = 1").select("family", c("event_id").alias("pair_id"), c("start_us").alias("at"), c("start_us").alias("pos3"), c("end_us").alias("pos5"), reach.alias("reach"))


@query(f"WITH {_EVENTS} SELECT split_id, pair_id, distance FROM m")
def j07_nearest_pair_events(spark, sf_dir):
    return callset.nearest_pair_events(*_events(spark, sf_dir), 2400 * SECOND)


@query(f"""WITH {_EVENTS}, u AS (SELECT family, pos, split_id, pair_id FROM s LEFT JOIN m USING (split_id) UNION ALL SELECT family, begins, NULL, pair_id FROM r ANTI JOIN m USING (pair_id))
SELECT row_number() OVER (ORDER BY pos, family, split_id IS NOT NULL, coalesce(split_id, pair_id)) AS place, family, pos, coalesce(split_id, -1) AS split_id, coalesce(pair_id, -1) AS pair_id FROM u""")
def k04_merged_events(spark, sf_dir):
    splits, pairs = _events(spark, sf_dir)
    absorbed = materialize(callset.nearest_pair_events(splits, pairs, 2400 * SECOND), "absorbed")
    none = F.lit(-1)
    return callset.merged_events(splits, pairs, absorbed).withColumns({x: F.coalesce(x, none) for x in ("split_id", "pair_id")})


#: Calls over orders and masks over lines, in SQL that both engines read alike.
_CALLS = """SELECT o_orderkey AS id, 'chr' || CAST(o_custkey % 5 AS STRING) AS chrom, o_orderkey AS pos, o_orderkey + 1 AS `end`, substr('ALL1SVPO', CAST(o_custkey % 4 AS INT) * 2 + 1, 2) AS family,
  o_custkey % 5 AS rp5, o_orderkey % 4 AS rp3, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 8 ELSE 0 END AS sr5, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 7 ELSE 0 END AS sr3, CASE WHEN o_orderkey % 9 = 0 THEN '.:.' ELSE '0/1:3' END AS gt FROM orders"""
_MASKS = """SELECT CASE l_suppkey % 4 WHEN 0 THEN 'AL' WHEN 1 THEN 'L1' WHEN 2 THEN 'LOW' ELSE 'SIM' END AS type, l_suppkey % 2 AS `window`, 'chr' || CAST(l_linenumber % 5 AS STRING) AS chrom, l_orderkey + l_partkey % 50 AS start,
  l_orderkey + l_partkey % 50 + 1 + l_linenumber % 2 AS stop FROM lineitem"""
_KEPT = f"""v AS ({_CALLS.replace('`', '"')}), k AS (SELECT *, CASE WHEN sr5 > 0 OR sr3 > 0 THEN 2 ELSE 1 END AS call_class FROM v
  WHERE (sr5 >= 5 OR sr3 >= 5 OR (rp5 >= 2 AND rp3 >= 2) OR ((rp5 >= 2 OR rp3 >= 2) AND (sr5 > 0 OR sr3 > 0))) AND family <> 'PO' AND NOT starts_with(gt, '.'))"""


def _supported(spark, sf_dir) -> DataFrame:
    return callset.supported_calls(spark.sql(_CALLS.replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders")), first_genotype="gt")


@query(f"WITH {_KEPT} SELECT id, family, call_class FROM k")
def f11_supported_calls(spark, sf_dir):
    return _supported(spark, sf_dir).select("id", "family", "call_class")


@query(f"""WITH {_KEPT}, mask AS ({_MASKS.replace('`', '"')}), f AS (SELECT DISTINCT family FROM k),
hit AS (SELECT DISTINCT k.id FROM k JOIN mask ON k.chrom = mask.chrom AND k.pos < mask.stop + mask."window" AND k."end" > mask.start - mask."window" WHERE mask.type NOT IN (FROM f) OR (mask.type = k.family AND k.call_class = 1))
SELECT id, family, call_class FROM k ANTI JOIN hit USING (id)""")
def j09_family_masks(spark, sf_dir):
    masks = spark.sql(_MASKS.replace("FROM lineitem", "FROM {t}"), t=table(spark, sf_dir, "lineitem"))
    return callset.unmasked_calls(_supported(spark, sf_dir), masks, "id", 64).select("id", "family", "call_class")


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, length(seq)::BIGINT AS n FROM ({SEQUENCES}) WHERE length(seq) > 0),
t AS (SELECT doc_id, n, 0::BIGINT AS start, CASE WHEN 10 * n < 11 * 300 THEN n ELSE 300 END AS stop FROM r UNION ALL SELECT doc_id, n, stop, CASE WHEN 10 * (n - stop) < 11 * 300 THEN n ELSE stop + 300 END FROM t WHERE stop < n)
SELECT doc_id, start, stop FROM t""")
def x12_region_tiles(spark, sf_dir):
    refs = sequences(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("n"))
    return ranges.region_tiles(refs, "n", 300).select("doc_id", "start", "stop")


_INNER = "least(pos + id % 7, pos + id % 5)"


@query(f"""WITH v AS ({_CALLS.replace('`', '"')}), f AS (SELECT *, substr('ACGT', CAST(id % 4 AS INT) + 1, 1) AS base, {_INNER} AS near FROM v)
SELECT id, chrom || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || base || chr(9) || CASE WHEN id % 5 = 0 THEN base || 'ACGT' ELSE '<INS:ME:' || family || '>' END || chr(9) || '.' || chr(9) || '.' || chr(9)
  || CASE WHEN sr5 + sr3 > 0 THEN '' ELSE 'IMPRECISE;CIPOS=' || (pos - 10 - near) || ',' || (pos + 20 - near) || ';' END || 'TYPE=' || family || ';RP5=' || rp5 || ';RP3=' || rp3 || ';SR5=' || sr5 || ';SR3=' || sr3
  || ';STRAND=' || CASE id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '/' END || ';MEILEN=' || CASE WHEN id % 5 = 0 THEN 4 ELSE -1 END AS line FROM f""")
def k02_special_calls(spark, sf_dir):
    calls = spark.sql(_CALLS.replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders"))
    base = F.expr("substr('ACGT', CAST(id % 4 AS INT) + 1, 1)")
    interval = formats.place_interval((c("pos") - 10, c("pos") + c("id") % 7), (c("pos") + c("id") % 5, c("pos") + 20))
    known, strand = c("id") % 5 == 0, F.when(c("id") % 3 == 0, "+").when(c("id") % 3 == 1, "-")
    evidence = {x: c(x) for x in ("rp5", "rp3", "sr5", "sr3")}
    return calls.select("id", formats.special_call(c("chrom"), c("pos"), base, F.when(known, "ACGT"), c("family"), interval, evidence, strand, F.when(known, 4)).alias("line"))


_SIDES = {"rp5": 1, "rp3": 2, "sr5": 3, "sr3": 4}


@query(f"""WITH e AS (SELECT l_suppkey AS site, l_linestatus AS sample, count(*) FILTER (l_returnflag = 'N') AS n_ref, count(*) FILTER (l_returnflag = 'R') AS n_alt,
  {", ".join(f"count(*) FILTER (l_returnflag = 'R' AND l_linenumber = {k}) AS {x}" for x, k in _SIDES.items())} FROM lineitem GROUP BY ALL),
g AS (SELECT *, (lgamma(n_ref + n_alt + 1) - lgamma(n_ref + 1) - lgamma(n_alt + 1)) / ln(10) AS choose FROM e),
l AS (SELECT *, choose + n_ref * log10(0.999) + n_alt * log10(0.001) AS a, choose + (n_ref + n_alt) * log10(0.5) AS b, choose + n_ref * log10(0.001) + n_alt * log10(0.999) AS d FROM g)
SELECT site, sample, CASE WHEN n_ref + n_alt = 0 THEN '.:0.00,0.00,0.00' ELSE CASE WHEN a >= b AND a >= d THEN '0/0' WHEN b >= d THEN '0/1' ELSE '1/1' END || ':' || printf('%.2f', round(a, 6)) || ',' || printf('%.2f', round(b, 6)) || ',' || printf('%.2f', round(d, 6)) END
  || ':' || n_ref || ':' || rp3 || ':' || rp5 || ':' || sr3 || ':' || sr5 || ':' || (n_alt - rp3 - rp5 - sr3 - sr5) AS field FROM l""")
def k03_sample_fields(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("site"), c("l_linestatus").alias("sample"))
    alt = c("l_returnflag") == "R"
    counted = lines.agg(F.count_if(c("l_returnflag") == "N").alias("n_ref"), F.count_if(alt).alias("n_alt"), *[F.count_if(alt & (c("l_linenumber") == k)).alias(x) for x, k in _SIDES.items()])
    called = genotype.genotype(counted).withColumns({f"gl_{i}": F.round(f"gl_{i}", 6) for i in range(3)})
    return called.select("site", "sample", formats.sample_field(c("gt"), [c(f"gl_{i}") for i in range(3)], c("n_ref"), {x: c(x) for x in _SIDES}, c("n_alt")).alias("field"))
