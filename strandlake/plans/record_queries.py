"""Filters by property, text formats and proper pairs over lineitem's pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions import families
from strandlake.operators import records as R

from .catalogue import query
from .pair_queries import _P
from .views import pairs, table

c = F.col
#: Names, bases and qualities of pairs, in SQL that both engines read alike.
_COLUMNS = {
    "read": "'r' || CAST(name AS STRING)",
    "ref_name": "CASE WHEN ref_id >= 0 THEN 'chr' || CAST(ref_id AS STRING) END",
    "mate_name": "'chr' || CAST(mate_ref AS STRING)",
    "bases": "substr(repeat('ACGT', 60), CAST(name % 4 AS INT) + 1, lead_clip + frag_len + 9 + trail_clip)",
    "quals": "substr(repeat('IHG#', 60), CAST(line % 4 AS INT) + 1, lead_clip + frag_len + 9 + trail_clip)",
    "filename": "'f' || CAST(read_group % 3 AS STRING)",
}
_R = f"{_P}, r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _COLUMNS.items())} FROM p)"
_BACK = "CASE WHEN flag & 16 <> 0 THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END"


def _records(spark, sf_dir) -> DataFrame:
    return pairs(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in _COLUMNS.items()])


@query(f"""WITH {_R} SELECT read_group, count(*) AS n FROM r WHERE ((flag & 4 = 0 AND flag & 8 = 0 AND map_qual >= 3 AND insert_size > 10) OR (flag & 1 <> 0 AND flag & 4 = 0 AND flag & 8 <> 0)
  OR (length(bases) < 40 AND ref_name = 'chr2' AND mate_name <> 'chr2' AND cigar LIKE '%S' AND coalesce(code = 'AL', false))) AND NOT (flag & 1024 <> 0 AND read NOT LIKE 'r1%') GROUP BY read_group""")
def b03_property_filters(spark, sf_dir):
    filters = {
        "both": {"isMapped": "true", "isMateMapped": "true", "mapQuality": ">=3", "insertSize": ">10"},
        "single": {"isSingleton": "true"},
        "short": {"length": "<40", "reference": "chr2", "mateReference": "!chr2", "cigar": "*S", "tag": "ZC:AL"},
        "copy": {"isDuplicate": "true", "name": "!r1*"},
    }
    own = _records(spark, sf_dir).drop("name").withColumn("name", c("read")).withColumn("tags", F.create_map(F.lit("ZC"), c("code")))
    kept = own.filter(R.compile_filters(filters, "(both | single | short) & !copy"))
    return kept.groupBy("read_group").agg(F.count("*").alias("n"))


@query(f"""WITH {_R} SELECT name, line, '>' || read || chr(10) || regexp_replace({_BACK}, '(.{{50}})(.)', '\\1' || chr(10) || '\\2', 'g') AS fasta,
  '@' || read || CASE WHEN flag & 64 <> 0 THEN '/1' ELSE '/2' END || chr(10) || {_BACK} || chr(10) || '+' || chr(10) || CASE WHEN flag & 16 <> 0 THEN reverse(quals) ELSE quals END AS fastq FROM r""")
def b16_convert_reads(spark, sf_dir):
    return _records(spark, sf_dir).select("name", "line", R.fasta_text(c("read"), c("flag"), c("bases")).alias("fasta"), R.fastq_text(c("read"), c("flag"), c("bases"), c("quals")).alias("fastq"))


_YAML = " || ".join(f"chr(10) || '   {name}: ' || coalesce(CAST({'read' if col == 'name' else 'length(bases)' if col == 'length' else col} AS STRING), '')" for name, col in R.YAML_MEMBERS.items())


@query(f"""WITH {_R} SELECT name, line, '{{"name":"' || read || '","alignmentFlag":"' || flag || '",' || CASE WHEN ref_name IS NULL THEN '' ELSE '"reference":"' || ref_name || '",' END || '"position":' || (pos + 1) || ',"mapQuality":' || map_qual
  || ',"cigar":["' || array_to_string(regexp_extract_all(cigar, '[0-9]+[A-Z]'), '","') || '"],"mate":{{"reference":"' || mate_name || '","position":' || (mate_pos + 1) || ',"insertSize":' || insert_size || '}},"queryBases":"' || bases
  || '","qualities":[' || array_to_string(list_transform(string_split(quals, ''), lambda x: ascii(x) - 33), ',') || '],"filename":"' || filename || '"}}' AS json, '---' || chr(10) || read || ':' || {_YAML} AS yaml FROM r""")
def b16_convert_documents(spark, sf_dir):
    own = _records(spark, sf_dir)
    record = {x: c(x) for x in own.columns} | {"name": c("read"), "length": F.length("bases")}
    return own.select("name", "line", R.json_text(record).alias("json"), R.yaml_text(record).alias("yaml"))


@query(f"""WITH {_P}, u AS (SELECT *, (CASE WHEN flag & 64 <> 0 THEN 0 ELSE 4 END + CASE WHEN flag & 16 <> 0 THEN 2 ELSE 0 END + CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END) AS model FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY read_group ORDER BY n DESC, model) AS rank FROM (SELECT read_group, model, count(*) AS n FROM u WHERE map_qual >= 1 AND mate_qual >= 1 GROUP BY ALL)),
a AS (SELECT read_group, (sum(n) - sum(n) FILTER (rank <= 2))::DOUBLE / sum(n) FILTER (rank <= 2) > 5::DOUBLE AS ambiguous FROM t GROUP BY read_group),
s AS (SELECT read_group, frag_len, row_number() OVER (PARTITION BY read_group ORDER BY frag_len) AS k, count(*) OVER (PARTITION BY read_group) AS n FROM u SEMI JOIN (FROM t WHERE rank <= 2) USING (read_group, model) WHERE map_qual >= 1 AND mate_qual >= 1),
l AS (SELECT read_group, min(frag_len) FILTER (k = least(floor(n * 0.05::DOUBLE) + 1, n)) AS low, min(frag_len) FILTER (k = least(floor(n * 0.95::DOUBLE) + 1, n)) AS high FROM s GROUP BY read_group),
h AS (SELECT read_group, name, count(*) AS halves FROM p WHERE flag & 13 = 1 GROUP BY ALL)
SELECT u.read_group, count(*) AS n, count(*) FILTER (flag & 13 = 1 AND ref_id = mate_ref AND map_qual >= 1 AND NOT ambiguous AND t.rank <= 2 AND frag_len BETWEEN low AND high AND halves = 1) AS proper
FROM u LEFT JOIN l USING (read_group) LEFT JOIN a USING (read_group) LEFT JOIN t ON t.read_group = u.read_group AND t.model = u.model LEFT JOIN h ON h.read_group = u.read_group AND h.name = u.name GROUP BY u.read_group""")
def b09_mark_proper(spark, sf_dir):
    own = pairs(spark, sf_dir)
    sure = own.filter("map_qual >= 1 AND mate_qual >= 1").select("read_group", "frag_len", A.orientation(c("flag")).alias("model"))
    marked = R.mark_proper(own, R.library_models(sure, ambiguous=5.0), "name", halves=1)
    return marked.groupBy("read_group").agg(F.count("*").alias("n"), F.count_if(A.has(c("flag"), A.PROPER)).alias("proper"))


@query(f"""WITH {_P}, k AS (SELECT name, line, lead_clip AS size, lead_clip AS read, pos AS genome FROM p WHERE lead_clip > 0
  UNION ALL SELECT name, line, trail_clip, lead_clip + frag_len + n_del + 2 + 7, pos + frag_len + n_del + 7 FROM p WHERE trail_clip > 0)
SELECT name, line, size::INTEGER AS size, read::BIGINT AS read, genome::BIGINT AS genome FROM k""")
def p07_soft_clips(spark, sf_dir):
    return pairs(spark, sf_dir).select("name", "line", F.explode(A.soft_clips(c("pos"), c("cigar"))).alias("k")).select("name", "line", "k.*")


_WHO = {"child": "(l_partkey * (k + 3) + l_suppkey * k * k) % 50", "father": "(l_orderkey * (k + 2) + l_linenumber) % 60", "mother": "(l_partkey + l_orderkey * (k * k + 1)) % 40"}
_TRIOS = ", ".join(f"({k}, {f}, {m})" for k, f, m in families.trios())
_NAMES = "[" + ", ".join(f"'{g}'" for g in families.GENOTYPES) + "]"
_FREE = " || ',' || ".join(f"{_NAMES}[list_position({who}, list_min({who}))]" for who in _WHO)


@query(f"""WITH g AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, {", ".join(f"list_transform(range(0, 10), lambda k: {e}) AS {who}" for who, e in _WHO.items())} FROM lineitem),
d AS (SELECT DISTINCT child, father, mother FROM g), t(c, f, m) AS (VALUES {_TRIOS}),
b AS (SELECT child, father, mother, min(child[c + 1] + father[f + 1] + mother[m + 1]) AS cost, arg_min((c, f, m), (child[c + 1] + father[f + 1] + mother[m + 1], m, f, c)) AS best FROM d, t GROUP BY ALL)
SELECT id, line, part, supp, (cost - list_min(child) - list_min(father) - list_min(mother))::BIGINT AS llr, {_NAMES}[best[1] + 1] || ',' || {_NAMES}[best[2] + 1] || ',' || {_NAMES}[best[3] + 1] AS called, {_FREE} AS free,
  (list_min(list_transform(list_zip(father, mother), lambda x: x[1] + x[2])) - list_min(father) - list_min(mother))::BIGINT AS pair, list_min([list_sort(x)[2] - list_sort(x)[1] for x in [child, father, mother]])::BIGINT AS difference
FROM g JOIN b USING (child, father, mother)""")
def x06_trio_calls(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), *[F.expr(f"transform(sequence(0, 9), k -> {e})").alias(who) for who, e in _WHO.items()])
    trio = [c(who) for who in _WHO]
    called = lines.withColumn("t", families.trio_call(*trio))
    return called.select(
        "id", "line", "part", "supp", "t.llr", F.concat_ws(",", "t.child", "t.father", "t.mother").alias("called"), "t.free", families.pair_call(c("father"), c("mother")).alias("pair"),
        families.least_difference(F.array(*trio)).alias("difference"),
    )
