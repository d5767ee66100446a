"""Alignment utilities: statistics, duplicate removal, mates, sampling and filter rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import alignment as A


def flag_statistics(records: DataFrame) -> DataFrame:
    """One row of counts over all records, in one pass."""
    count = lambda c: F.count(F.when(c, 1))
    f = F.col("flag")
    return records.agg(
        F.count("*").alias("total"), count(A.has(f, A.DUPLICATE)).alias("duplicates"), count(~A.has(f, A.UNMAPPED)).alias("mapped"), count(A.has(f, A.PAIRED)).alias("paired"),
        count(A.has(f, A.FIRST)).alias("first"), count(A.has(f, A.SECOND)).alias("second"), count(A.has(f, A.REVERSE)).alias("reverse"), count(A.has(f, A.QC_FAIL)).alias("failed"),
    )


def drop_duplicates(records: DataFrame, place: list[str], best: list[Column]) -> DataFrame:
    """The best record of each place. Candidates are reduced map-side, so a hot place doesn't gather in one task."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(best)])
    row = F.struct(*records.columns)
    return records.groupBy(*place).agg(F.min_by(row, rank).alias("row")).select("row.*")


def drop_duplicate_pairs(records: DataFrame, place: list[str], name: str, leading: Column, best: list[Column]) -> DataFrame:
    """records without the pairs that lie where a better one does: of the leading records of each place all but the best go, and with them all of their names."""
    led = records.filter(leading)
    kept = drop_duplicates(led, place, best).select(*place, F.col(name).alias("_kept"))
    lost = led.join(kept, place).filter(F.col(name) != F.col("_kept")).select(name).distinct()
    return records.join(lost, name, "left_anti")


def mates(records: DataFrame, name: str, first: Column, second: Column, carried: list[str]) -> DataFrame:
    """Pairs of a first and a second record of one name, full outer, so singletons stay with nulls."""
    left = records.filter(first).select(name, *[F.col(c).alias(f"{c}_1") for c in carried])
    right = records.filter(second).select(name, *[F.col(c).alias(f"{c}_2") for c in carried])
    return left.join(right, name, "full_outer")


def fix_mates(records: DataFrame, name: str, order: list[str]) -> DataFrame:
    """records (ref_id, pos, half-open end, flag) with mate_ref, mate_pos, insert and a flag that follow from the mate.

    Of a name's records in order (which should leave no ties), the first two are mates, then the next two. insert leads from a record's 5' end to its mate's, 0 across
    references or where one half is unmapped. A record left alone has mate_ref and mate_pos -1; if it is paired, its mate counts as unmapped.
    """
    w = Window.partitionBy(name).orderBy(*order)
    row = F.struct("ref_id", "pos", "end", "flag")
    mate = F.when(F.row_number().over(w) % 2 == 1, F.lead(row).over(w)).otherwise(F.lag(row).over(w))
    known = records.withColumn("_mate", mate)
    flag, other = F.col("flag"), F.col("_mate.flag")
    five = lambda place, bits: F.when(A.has(bits, A.REVERSE), place("end")).otherwise(place("pos"))
    unmapped = A.UNMAPPED | A.MATE_UNMAPPED
    near = (F.col("ref_id") == F.col("_mate.ref_id")) & ~A.has(flag, unmapped) & ~A.has(other, unmapped)
    without = lambda f, bits: f.bitwiseAND(F.lit(~bits))
    follows = without(flag, A.MATE_REVERSE).bitwiseOR(F.when(A.has(other, A.REVERSE), A.MATE_REVERSE).otherwise(0))
    follows = F.when(A.has(other, A.UNMAPPED), without(follows, A.PROPER).bitwiseOR(F.lit(A.MATE_UNMAPPED))).otherwise(follows)
    alone = F.when(A.has(flag, A.PAIRED), without(flag, A.MATE_REVERSE | A.PROPER).bitwiseOR(F.lit(A.MATE_UNMAPPED))).otherwise(flag)
    insert = five(lambda c: F.col(f"_mate.{c}"), other) - five(F.col, flag)
    return known.withColumns({
        "mate_ref": F.coalesce("_mate.ref_id", F.lit(-1)), "mate_pos": F.coalesce("_mate.pos", F.lit(-1)), "insert": F.when(near, insert).otherwise(0),
        "flag": F.when(F.col("_mate").isNull(), alone).otherwise(follows),
    }).drop("_mate")


def text_hash(text: Column) -> Column:
    """The rolling hash h = 31 h + c over a text's characters, modulo 2**32."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))


def subsample(records: DataFrame, name: Column, share: float) -> DataFrame:
    """A share of the names, the same ones in every run."""
    return records.filter(text_hash(name) % 1024 < int(share * 1024))


_RULE = re.compile(r"\s*([!&|()]|\w+)")


def compile_rule(rule: str, properties: dict[str, Column]) -> Column:
    """A filter rule of names, !, &, | and parentheses as one Column; & binds closer than |."""
    tokens, at = _RULE.findall(rule), 0

    def take() -> str | None:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else None

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def either() -> Column:
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while peek() == "&":
            take()
            out = out & single()
        return out

    def single() -> Column:
        token = take()
        if token == "!":
            return ~single()
        if token == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"a parenthesis isn't closed in {rule!r}")
            return out
        if token not in properties:
            raise ValueError(f"no property {token!r} for {rule!r}")
        return properties[token]

    out = either()
    if peek() is not None:
        raise ValueError(f"{peek()!r} is left over in {rule!r}")
    return out


def top_models(records: DataFrame, key: str, model: str, k: int = 2) -> DataFrame:
    """The k most frequent models of each key with their ranks; equal counts in the order of the model."""
    counted = records.groupBy(key, model).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), model)
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_condition(value: Column, token: str, numeric: bool) -> Column:
    """A filter token as a condition: ! not, > >= < <=, *x ends with, x* starts with, *x* holds, else equal."""
    if token.startswith("!"):
        return ~token_condition(value, token[1:], numeric)
    sign = next((s for s in (">=", "<=", ">", "<") if token.startswith(s)), "")
    own = token[len(sign) :]
    if numeric:
        number = value.try_cast("double")
        return {">=": number >= float(own), "<=": number <= float(own), ">": number > float(own), "<": number < float(own)}.get(sign, number == float(own or "nan"))
    if sign:
        return {">=": value >= own, "<=": value <= own, ">": value > own, "<": value < own}[sign]
    left, right, bare = own.startswith("*"), own.endswith("*"), own.strip("*")
    return value.contains(bare) if left and right else value.endswith(bare) if left else value.startswith(bare) if right else value == own


def statistics(records: DataFrame) -> DataFrame:
    """One row of counts, and the mean and median insert of first mates with one."""
    f, count = F.col("flag"), F.count_if
    mapped, mate = ~A.has(f, A.UNMAPPED), ~A.has(f, A.MATE_UNMAPPED)
    insert = F.when(A.has(f, A.FIRST) & (F.col("insert_size") != 0), F.abs("insert_size"))
    return records.agg(
        F.count("*").alias("total"), count(mapped).alias("mapped"), count(~A.has(f, A.REVERSE)).alias("forward"), count(A.has(f, A.REVERSE)).alias("reverse"), count(A.has(f, A.QC_FAIL)).alias("failed"),
        count(A.has(f, A.DUPLICATE)).alias("duplicates"), count(A.has(f, A.PAIRED)).alias("paired"), count(A.has(f, A.PROPER)).alias("proper"), count(mapped & mate).alias("both_mapped"),
        count(A.has(f, A.FIRST)).alias("read_1"), count(A.has(f, A.SECOND)).alias("read_2"), count(mapped & ~mate).alias("singletons"), F.avg(insert).alias("mean_insert"), F.percentile(insert, 0.5).alias("median_insert"),
    )


def flagstat(records: DataFrame) -> DataFrame:
    """The counters of flags, apart for records that failed checks (bad) and others."""
    f, count = F.col("flag"), F.count_if
    mapped, mate = ~A.has(f, A.UNMAPPED), ~A.has(f, A.MATE_UNMAPPED)
    across = mapped & mate & (F.col("ref_id") != F.col("mate_ref"))
    return records.groupBy(A.has(f, A.QC_FAIL).alias("bad")).agg(
        F.count("*").alias("total"), count(A.has(f, A.SECONDARY)).alias("secondary"), count(A.has(f, A.DUPLICATE)).alias("duplicates"), count(mapped).alias("mapped"), count(A.has(f, A.PAIRED)).alias("paired"),
        count(A.has(f, A.FIRST)).alias("read_1"), count(A.has(f, A.SECOND)).alias("read_2"), count(A.has(f, A.PROPER) & mapped).alias("proper"), count(mapped & mate).alias("both_mapped"),
        count(mapped & ~mate).alias("singletons"), count(across).alias("across"), count(across & (F.col("map_qual") >= 5)).alias("across_sure"),
    )


def view(records: DataFrame, min_qual: int = 0, required: int = 0, forbidden: int = 0) -> DataFrame:
    """Records of a least mapping quality with all required flags and none of the forbidden ones."""
    f = F.col("flag")
    return records.filter((F.col("map_qual") >= min_qual) & (f.bitwiseAND(required) == required) & (f.bitwiseAND(forbidden) == 0))


def revert(records: DataFrame) -> DataFrame:
    """Original qualities where the tags keep them, and no mark of a duplicate."""
    return records.withColumns({"quals": F.coalesce(F.try_element_at("tags", F.lit("OQ")), "quals"), "flag": F.col("flag").bitwiseAND(F.lit(~A.DUPLICATE))})


def bed_line(ref: Column, pos: Column, end: Column, name: Column, qual: Column, flag: Column) -> Column:
    return F.concat_ws("\t", ref.cast("string"), pos.cast("string"), end.cast("string"), name.cast("string"), qual.cast("string"), F.when(A.has(flag, A.REVERSE), "-").otherwise("+"))
