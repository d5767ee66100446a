"""Text formats as DataFrames, on Spark's own readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.pairs import chromosome_rank

SAM_COLUMNS = (("name", "string"), ("flag", "int"), ("ref", "string"), ("pos", "long"), ("map_qual", "int"), ("cigar", "string"), ("mate_ref", "string"), ("mate_pos", "long"), ("insert_size", "long"), ("seq", "string"), ("quals", "string"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines (header lines are left out); tags as a map of name to `type:value`."""
    fields = F.split("value", "\t")
    tags = F.transform(F.slice(fields, 12, F.greatest(F.size(fields) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substr(t, F.lit(4), F.length(t)).alias("value")))
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(fields) >= 11))
    return lines.select(*[F.get(fields, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(SAM_COLUMNS)], F.map_from_entries(tags).alias("tags"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, name string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq): records are split at lines that begin with `>` by the reader, so long files need no single task a file."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substr(F.col("value"), F.length(head) + 1, F.length("value")), r"\s", "")
    return records.select(F.substring_index(head, " ", 1).alias("name"), F.trim(F.substr(head, F.length(F.substring_index(head, " ", 1)) + 1, F.length(head))).alias("description"), body.alias("seq"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Call lines with INFO as a map; flags map to an empty text, and a key that is repeated has its first value."""
    fields = F.split("value", "\t")
    pairs = F.transform(F.split(F.get(fields, F.lit(7)), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.contains(x, F.lit("=")), F.substr(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value")))
    keys = F.transform(pairs, lambda x: x["key"])
    pairs = F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return lines.select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)], F.map_from_entries(pairs).alias("info")).withColumn("pos", F.col("pos").cast("long"))


def write_vcf(calls: DataFrame, path: str) -> None:
    """Calls (chrom, pos, id, ref, alt, qual, filter, info map) as sorted text parts; ranges keep parts in order."""
    info = F.array_join(F.array_sort(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.when(e["value"] == "", "").otherwise(F.concat(F.lit("="), e["value"]))))), ";")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", info)
    calls.orderBy(chromosome_rank(F.col("chrom")), "chrom", "pos", "id").select(line.alias("value")).write.text(path)


# Ids, numbers and types of a call file's fields, in the order of its header.
VCF_HEADER = (
    "##fileformat=VCFv4.1",
    '##ALT=<ID=INS:ME:AL,Description="Inserted ALU element">',
    '##ALT=<ID=INS:ME:L1,Description="Inserted L1 element">',
    '##ALT=<ID=INS:ME:SV,Description="Inserted SVA element">',
    '##ALT=<ID=INS:ME:HE,Description="Inserted HERVK element">',
    '##INFO=<ID=TYPE,Number=A,Type=String,Description="Family of the inserted element">',
    '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="The place is not known to the base">',
    '##INFO=<ID=STRAND,Number=1,Type=String,Description="Strand of the inserted element, / where it is unknown">',
    '##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="Interval around POS of an imprecise call">',
    '##INFO=<ID=MEILEN,Number=1,Type=Integer,Description="Inserted length, -1 where it is unknown">',
    '##INFO=<ID=RP5,Number=1,Type=Integer,Description="Pairs that support the 5-prime side">',
    '##INFO=<ID=RP3,Number=1,Type=Integer,Description="Pairs that support the 3-prime side">',
    '##INFO=<ID=SR5,Number=1,Type=Integer,Description="Split reads that support the 5-prime side">',
    '##INFO=<ID=SR3,Number=1,Type=Integer,Description="Split reads that support the 3-prime side">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GL,Number=3,Type=Float,Description="Genotype likelihoods">',
    '##FORMAT=<ID=RO,Number=1,Type=Integer,Description="Fragments of the reference allele">',
    '##FORMAT=<ID=R5,Number=1,Type=Integer,Description="Pairs that support the 5-prime side">',
    '##FORMAT=<ID=R3,Number=1,Type=Integer,Description="Pairs that support the 3-prime side">',
    '##FORMAT=<ID=S5,Number=1,Type=Integer,Description="Split reads that support the 5-prime side">',
    '##FORMAT=<ID=S3,Number=1,Type=Integer,Description="Split reads that support the 3-prime side">',
    '##FORMAT=<ID=SF,Number=1,Type=Integer,Description="Supporting fragments that are short">',
)
#: Fixed value: the fields of a sample's column.
SAMPLE_FORMAT = "GT:GL:RO:R5:R3:S5:S3:SF"


def vcf_header(samples: list[str]) -> list[str]:
    """The lines before the calls, with a column for each sample."""
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [*VCF_HEADER, "\t".join(columns)]


def insertion_line(chrom: Column, pos: Column, family: Column, interval: Column, length: Column) -> Column:
    """A call of an inserted element, its place counted from 1; interval is null for a precise one."""
    around = F.when(interval.isNull(), "").otherwise(F.concat(F.lit("IMPRECISE;CIPOS="), interval["low"].cast("string"), F.lit(","), interval["high"].cast("string"), F.lit(";")))
    info = F.concat(around, F.lit("TYPE="), family, F.lit(";MEILEN="), length.cast("string"))
    return F.concat_ws("\t", chrom, (pos + 1).cast("string"), F.lit("."), F.lit("N"), F.concat(F.lit("<INS:ME:"), family, F.lit(">")), F.lit("."), F.lit("PASS"), info)


def place_interval(pos5: tuple[Column, Column], pos3: tuple[Column, Column]) -> Column:
    """(low, high) around the place of a call without split reads: from the 5' side's begin to the 3' side's end, as seen from the nearer of its inner ends."""
    inner = F.least(pos5[1], pos3[0])
    return F.struct((pos5[0] - inner).alias("low"), (pos3[1] - inner).alias("high"))


def special_call(chrom: Column, pos: Column, base: Column, inserted: Column, family: Column, interval: Column, evidence: dict[str, Column], strand: Column, length: Column) -> Column:
    """A call of an inserted element up to its INFO, its place counted from 1, after the reference's base there.

    inserted are its bases, empty or null where they aren't known; evidence holds rp5, rp3, sr5 and sr3. Without split reads the call is imprecise and names the
    interval. A null family names no TYPE, a null length is -1, a null strand /.
    """
    text = lambda x: x.cast("string")
    known = F.coalesce(F.length(inserted), F.lit(0)) > 0
    alt = F.when(known, F.concat(base, inserted)).otherwise(F.concat(F.lit("<INS:ME:"), family, F.lit(">")))
    vague = F.when(evidence["sr5"] + evidence["sr3"] > 0, "").otherwise(F.concat(F.lit("IMPRECISE;CIPOS="), text(interval["low"]), F.lit(","), text(interval["high"]), F.lit(";")))
    kind = F.when(family.isNull(), "").otherwise(F.concat(F.lit("TYPE="), family, F.lit(";")))
    counts = [F.concat(F.lit(f"{name.upper()}="), text(evidence[name]), F.lit(";")) for name in ("rp5", "rp3", "sr5", "sr3")]
    info = F.concat(vague, kind, *counts, F.lit("STRAND="), F.coalesce(strand, F.lit("/")), F.lit(";MEILEN="), text(F.coalesce(length, F.lit(-1))))
    return F.concat_ws("\t", chrom, text(pos + 1), F.lit("."), base, alt, F.lit("."), F.lit("."), info)


def sample_field(gt: Column, likelihoods: list[Column], reference: Column, evidence: dict[str, Column], support: Column) -> Column:
    """A sample's column in the order of SAMPLE_FORMAT's values: pairs and split reads with the 3' side first, as call files list them, and last
    the support beyond these."""
    sides = [evidence[x] for x in ("rp3", "rp5", "sr3", "sr5")]
    return genotype_fields(gt, likelihoods, [reference, *sides, support - sum(sides[1:], sides[0])])


def two_decimals(x: Column) -> Column:
    """A double to two decimals as C prints it: rounded by its exact binary value, a tie to the even digit. Java rounds its shortest decimal, so 2.675 (a little
    less in binary) would become 2.68."""
    size = F.abs(x)
    whole = F.floor(size)
    # what is behind the point is a whole number of 2 ** -60 (smaller bits decide nothing), held in halves of 30 bits so that a hundredfold fits
    part, low = ((size - whole) * float(1 << 60)).cast("long"), (1 << 30) - 1
    right = part.bitwiseAND(F.lit(low)) * 100
    left = F.shiftright(part, 30) * 100 + F.shiftright(right, 30)
    cents, rest = F.shiftright(left, 30), left.bitwiseAND(F.lit(low)) * (1 << 30) + right.bitwiseAND(F.lit(low))
    up = (rest > 1 << 59) | ((rest == 1 << 59) & (cents % 2 == 1))
    shown = (whole * 100 + cents + F.when(up, 1).otherwise(0)) / 100.0
    return F.format_string("%.2f", F.when(size >= 1e13, x).when(x < 0, -shown).otherwise(shown))


def genotype_fields(gt: Column, likelihoods: list[Column], counts: list[Column]) -> Column:
    """A sample's column: genotype, likelihoods of two decimals and counts; without a call the likelihoods are 0."""
    gl = F.when(gt == ".", "0.00,0.00,0.00").otherwise(F.concat_ws(",", *[two_decimals(x) for x in likelihoods]))
    return F.concat_ws(":", gt, gl, *[x.cast("string") for x in counts])


def output_path(prefix: str | None) -> str | None:
    """Where calls of a prefix go; without one there is no file."""
    return f"{prefix}.mei.vcf" if prefix else None


def read_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read groups (id, sample, platform), references (ref_id, name, length, md5) and the sort order of a SAM text's header.

    A read group without id, sample or platform is an error.
    """
    lines = spark.read.text(path).filter(F.col("value").startswith("@"))
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"(?:^|\t){name}:([^\t]*)", 1), F.lit(""))
    needed = lambda name: F.coalesce(tag(name), F.raise_error(F.concat(F.lit(f"no {name} in "), F.col("value"))))
    groups = lines.filter(F.col("value").startswith("@RG\t")).select(needed("ID").alias("id"), needed("SM").alias("sample"), needed("PL").alias("platform"))
    refs = lines.filter(F.col("value").startswith("@SQ\t")).select(tag("SN").alias("name"), tag("LN").cast("long").alias("length"), tag("M5").alias("md5"))
    order = lines.filter(F.col("value").startswith("@HD")).select(F.coalesce(tag("SO"), F.lit("unknown")).alias("order"))
    return groups, refs, order.withColumn("order", F.when(F.col("order").isin("coordinate", "queryname", "unsorted"), F.col("order")).otherwise("unknown"))


def rewritten_header(lines: list[str], program: str) -> list[str]:
    """A header for records that lost their order, with one program more."""
    out = [x.replace("SO:queryname", "SO:unsorted").replace("SO:coordinate", "SO:unsorted") if x.startswith("@HD") else x for x in lines]
    return [*out, f"@PG\tID:{program}"]


def read_many_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several files with equal reference lists, in the order of references and places."""
    lists = [tuple(map(tuple, read_header(spark, p)[1].collect())) for p in paths]
    if len(set(lists)) > 1:
        raise ValueError("the files name different references")
    place = F.create_map(*[F.lit(x) for i, (name, *_) in enumerate(lists[0]) for x in (name, i)]) if lists[0] else F.create_map()
    rows = reduce(DataFrame.unionByName, [read_sam(spark, p) for p in paths])
    return rows.withColumn("ref_id", F.try_element_at(place, F.col("ref")) if lists[0] else F.lit(None).cast("int")).orderBy("ref_id", "pos")


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(type, window, chrom, start, end) of all the BED files that a list of `type window file` names; # starts a comment."""
    found = []
    for line in read_list(spark, path):
        if line.startswith("#"):
            continue
        fields = line.split()
        if len(fields) < 3 or not fields[1].isdigit():
            raise ValueError(f"no mask: {line!r}")
        found.append(read_bed(spark, fields[2]).select(F.lit(fields[0]).alias("type"), F.lit(int(fields[1])).alias("window"), "chrom", "start", "end"))
    if not found:
        raise ValueError(f"no masks in {path}")
    return reduce(DataFrame.unionByName, found)


def write_sam(records: DataFrame, path: str) -> None:
    """Records of read_sam's columns as text parts; tags in the order of their names."""
    tags = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    records.select(F.concat_ws("\t", *[F.col(n).cast("string") for n, _ in SAM_COLUMNS], tags).alias("value")).write.text(path)
