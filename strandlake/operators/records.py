"""Alignment records by property: filters, text formats, files by value, and proper pairs by what their libraries show."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alignment as A
from strandlake.functions.sequence import reverse_complement
from strandlake.operators.evidence import percentile_index
from strandlake.operators.toolkit import compile_rule, token_condition

c = F.col

#: The properties of a filter with the flag's bit, and whether the bit must be unset.
FLAG_PROPERTIES = {
    "isDuplicate": (A.DUPLICATE, False), "isFailedQC": (A.QC_FAIL, False), "isFirstMate": (A.FIRST, False), "isMapped": (A.UNMAPPED, True), "isMateMapped": (A.MATE_UNMAPPED, True),
    "isMateReverseStrand": (A.MATE_REVERSE, False), "isPaired": (A.PAIRED, False), "isPrimaryAlignment": (A.SECONDARY, True), "isProperPair": (A.PROPER, False), "isReverseStrand": (A.REVERSE, False),
    "isSecondMate": (A.SECOND, False),
}
#: The other properties with the column they ask of and whether it is a number.
VALUE_PROPERTIES = {
    "alignmentFlag": ("flag", True), "cigar": ("cigar", False), "insertSize": ("insert_size", True), "mapQuality": ("map_qual", True), "matePosition": ("mate_pos", True), "mateReference": ("mate_name", False),
    "name": ("name", False), "position": ("pos", True), "queryBases": ("bases", False), "reference": ("ref_name", False),
}
#: Fixed value: letters of a line of bases.
LINE = 50


def property_condition(name: str, token: str) -> Column:
    """One property of a filter as a condition: flags by `true` and `false`, `length` of the bases, `tag` as `XX:token` of the map tags, others by token."""
    if name in FLAG_PROPERTIES or name == "isSingleton":
        if token not in ("true", "false"):
            raise ValueError(f"{name} is true or false, not {token!r}")
        f = c("flag")
        held = A.has(f, A.PAIRED) & ~A.has(f, A.UNMAPPED) & A.has(f, A.MATE_UNMAPPED)
        if name != "isSingleton":
            bit, unset = FLAG_PROPERTIES[name]
            held = ~A.has(f, bit) if unset else A.has(f, bit)
        return held if token == "true" else ~held
    if name == "length":
        return token_condition(F.length("bases"), token, True)
    if name == "tag":
        key, own = token.split(":", 1)
        value = F.try_element_at(c("tags"), F.lit(key))
        plain = own.lstrip("!<>=").replace(".", "", 1).lstrip("-").isdigit()
        return F.coalesce(token_condition(value, own, plain), F.lit(False))
    if name not in VALUE_PROPERTIES:
        raise ValueError(f"no property {name!r}")
    column, numeric = VALUE_PROPERTIES[name]
    return token_condition(c(column), token, numeric)


def compile_filters(filters: dict[str, dict[str, str]], rule: str | None = None) -> Column:
    """Named filters, each of properties that must all hold, joined by a rule; without one a record must pass any of them."""
    conditions = {}
    for name, properties in filters.items():
        held = F.lit(True)
        for key, token in properties.items():
            held = held & property_condition(key, token)
        conditions[name] = held
    return compile_rule(rule or " | ".join(conditions), conditions)


def _on_strand(flag: Column, bases: Column, quals: Column) -> tuple[Column, Column]:
    """Bases and qualities as they were read."""
    back = A.has(flag, A.REVERSE)
    return F.when(back, reverse_complement(bases)).otherwise(bases), F.when(back, F.reverse(quals)).otherwise(quals)


def fasta_text(name: Column, flag: Column, bases: Column) -> Column:
    """A record in lines of LINE bases, as read."""
    read = _on_strand(flag, bases, bases)[0]
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(read, rf"(.{{{LINE}}})(?=.)", "$1\n"))


def fastq_text(name: Column, flag: Column, bases: Column, quals: Column) -> Column:
    """A record of four lines, as read; halves of pairs are told by /1 and /2."""
    read, scores = _on_strand(flag, bases, quals)
    half = F.when(~A.has(flag, A.PAIRED), "").when(A.has(flag, A.FIRST), "/1").otherwise("/2")
    return F.concat(F.lit("@"), name, half, F.lit("\n"), read, F.lit("\n+\n"), scores)


class _Numbers(dict):
    """Numbers of qualities by their code points, as texts."""

    def __missing__(self, code: int) -> str:
        self[code] = n = str(code - 33)
        return n


_numbers = _Numbers()


def _scores(quals: Column) -> Column:
    """Qualities as numbers with commas between them."""

    def shown(batches: pd.Series) -> pd.Series:
        return batches.map(lambda x: ",".join(map(_numbers.__getitem__, map(ord, x))), na_action="ignore")

    return F.pandas_udf(shown, "string")(quals)


def json_text(record: dict[str, Column]) -> Column:
    """A record as a line of JSON; a reference or mate that isn't known, no CIGAR and no bases have no member. Places count from 1.

    record: name, flag, ref_name, pos, map_qual, cigar, mate_name, mate_pos, insert_size, bases, quals, filename.
    """
    r = record
    text = lambda x: x.cast("string")
    written = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    # most texts have nothing to escape
    quoted = lambda x: F.when(text(x).isNull() | text(x).rlike(r'[\x00-\x1f"\\]'), written(text(x))).otherwise(F.concat(F.lit('"'), text(x), F.lit('"')))
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    some = lambda x: F.coalesce(F.length(x), F.lit(0)) > 0
    # numbers lose leading zeros
    found = F.array_join(F.regexp_extract_all(r["cigar"], F.lit(r"0*(\d+[MIDNSHP=X])"), F.lit(1)), '","')
    ops = F.when(found == "", "").otherwise(F.concat(F.lit('"'), found, F.lit('"')))
    mate = F.concat(F.lit("{"), member("reference", quoted(r["mate_name"])), F.lit(","), member("position", text(r["mate_pos"] + 1)), F.lit(","), member("insertSize", text(r["insert_size"])), F.lit("}"))
    parts = [
        member("name", quoted(r["name"])), member("alignmentFlag", quoted(r["flag"])), F.when(r["ref_name"].isNotNull(), member("reference", quoted(r["ref_name"]))), member("position", text(r["pos"] + 1)),
        member("mapQuality", text(r["map_qual"])), F.when(some(r["cigar"]), member("cigar", F.concat(F.lit("["), ops, F.lit("]")))),
        F.when(A.has(r["flag"], A.PAIRED) & r["mate_name"].isNotNull(), member("mate", mate)), F.when(some(r["bases"]), member("queryBases", quoted(r["bases"]))),
        F.when(some(r["quals"]), member("qualities", F.concat(F.lit("["), _scores(r["quals"]), F.lit("]")))), member("filename", quoted(r["filename"])),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: The members of a YAML record in their order, with the columns they show.
YAML_MEMBERS = {
    "Qualities": "quals", "Name": "name", "Length": "length", "RefID": "ref_id", "RefName": "ref_name", "Position": "pos", "MapQuality": "map_qual", "AlignmentFlag": "flag", "MateRefID": "mate_ref", "MatePosition": "mate_pos",
    "InsertSize": "insert_size", "Filename": "filename",
}


def yaml_text(record: dict[str, Column]) -> Column:
    """A record as a document of YAML; what is null is left empty."""
    lines = [F.concat(F.lit(f"   {name}: "), F.coalesce(record[column].cast("string"), F.lit(""))) for name, column in YAML_MEMBERS.items()]
    return F.concat_ws("\n", F.lit("---"), F.concat(record["name"], F.lit(":")), *lines)


#: How records are told apart for files of their own.
SPLITS = {
    "mapped": lambda: F.when(A.has(c("flag"), A.UNMAPPED), "UNMAPPED").otherwise("MAPPED"),
    "paired": lambda: F.when(A.has(c("flag"), A.PAIRED), "PAIRED_END").otherwise("SINGLE_END"),
    "reference": lambda: F.coalesce("ref_name", F.lit("unmapped")),
}


def write_split(records: DataFrame, path: str, by: str) -> None:
    """records in a folder for each value of a property: mapped, paired, reference, or tag:XX for a tag's value (none where it is missing).

    Files are written where records lie, without a shuffle; a value's folder holds the parts of all tasks.
    """
    value = F.coalesce(F.try_element_at(c("tags"), F.lit(by[4:])).cast("string"), F.lit("none")) if by.startswith("tag:") else SPLITS[by]()
    records.withColumn("split", value).write.partitionBy("split").mode("errorifexists").parquet(path)


def library_models(pairs: DataFrame, share: float = 0.05, ambiguous: float = 0.1) -> DataFrame:
    """(read_group, models, ambiguous, n, low, median, high) of sure pairs (read_group, frag_len, model): the two commonest models, whether the others are
    a greater share of them than `ambiguous`, and the middle lengths of pairs of these two. Lengths are counted before they meet."""
    by = Window.partitionBy("read_group").orderBy(F.desc("n"), "model")
    counted = pairs.groupBy("read_group", "model").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(by))
    two = F.sum(F.when(c("rank") <= 2, c("n")))
    top = counted.groupBy("read_group").agg(F.collect_list(F.when(c("rank") <= 2, c("model"))).alias("models"), ((F.sum("n") - two) / two > ambiguous).alias("ambiguous"))
    up = Window.partitionBy("read_group").orderBy("frag_len")
    lengths = pairs.groupBy("read_group", "model", "frag_len").agg(F.count("*").alias("k")).join(top.select("read_group", "models"), "read_group").filter(F.array_contains("models", c("model")))
    lengths = lengths.groupBy("read_group", "frag_len").agg(F.sum("k").alias("k"))
    lengths = lengths.withColumns({"upto": F.sum("k").over(up), "n": F.sum("k").over(Window.partitionBy("read_group"))})
    at = lambda s: F.min(F.when(c("upto") >= percentile_index(s, c("n")), c("frag_len")))
    found = lengths.groupBy("read_group").agg(F.max("n").alias("n"), at(share).alias("low"), at(0.5).alias("median"), at(1 - share).alias("high"))
    return found.join(top, "read_group")


def mark_proper(records: DataFrame, libraries: DataFrame, name: str, least_quality: int = 1, halves: int = 2) -> DataFrame:
    """records (read_group, flag, ref_id, mate_ref, map_qual, frag_len, name, ...) with the proper bit set anew from libraries (library_models): the second pass.

    It is set on both halves' records where both are mapped, on one reference, sure enough, of one of the library's models and within its lengths, in a
    library that isn't ambiguous, if just `halves` mapped records of the read group bear the name; else it is cleared.
    """
    f = c("flag")
    model = A.orientation(f)
    candidates = records.filter(A.has(f, A.PAIRED) & ~A.has(f, A.UNMAPPED) & ~A.has(f, A.MATE_UNMAPPED)).groupBy("read_group", name).agg(F.count("*").alias("_halves"))
    met = records.join(libraries.select("read_group", "models", "ambiguous", "low", "high"), "read_group", "left").join(candidates, ["read_group", name], "left")
    good = A.has(f, A.PAIRED) & ~A.has(f, A.UNMAPPED) & ~A.has(f, A.MATE_UNMAPPED) & (c("ref_id") == c("mate_ref")) & (c("map_qual") >= least_quality) & ~c("ambiguous")
    good = good & F.array_contains("models", model) & c("frag_len").between(c("low"), c("high")) & (c("_halves") == halves)
    bit = F.when(F.coalesce(good, F.lit(False)), f.bitwiseOR(A.PROPER)).otherwise(f.bitwiseAND(~A.PROPER))
    return met.withColumn("flag", bit).select(*records.columns)
