"""Conditions and derived values over read pairs: filters, roles, positions of mates, search windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import alignment as A

# For each of two technology rows, the pair type of the orientations 0 to 7.
PAIR_TYPES = (
    ("INVERTED3", "NORMAL", "UNKNOWN", "INVERTED5", "UNKNOWN", "UNKNOWN", "REVERSED", "UNKNOWN"),
    ("UNKNOWN", "UNKNOWN", "REVERSED", "UNKNOWN", "INVERTED3", "NORMAL", "UNKNOWN", "INVERTED5"),
)
CIGAR_CODES = "MIDNSHP=X"


def basic_pair(flag: Column, ref: Column, mate_ref: Column, name: Column) -> Column:
    """A usable pair on known references with a name."""
    return A.usable_pair(flag) & (ref >= 0) & (mate_ref >= 0) & ~name.isin("0", "*")


def scan_pair(flag: Column, ref: Column, mate_ref: Column, name: Column) -> Column:
    """A basic pair of primary records, both halves mapped."""
    return basic_pair(flag, ref, mate_ref, name) & ~A.has(flag, A.SECONDARY) & ~A.has(flag, A.UNMAPPED) & ~A.has(flag, A.MATE_UNMAPPED)


def orphan(flag: Column, mate_qual: Column, min_qual: int) -> Column:
    """The unmapped half of a pair whose other half is mapped well enough to anchor it."""
    return A.has(flag, A.UNMAPPED) & ~A.has(flag, A.MATE_UNMAPPED) & (mate_qual >= min_qual)


def unused_reference(name: Column) -> Column:
    return name.rlike("^(GL0|NC_|NT_|hs)")


def is_upstream(ref: Column, pos: Column, mate_ref: Column, mate_pos: Column) -> Column:
    """Whether a record comes before its mate; ties count as upstream."""
    return (ref < mate_ref) | ((ref == mate_ref) & (pos <= mate_pos))


def pair_type(orientation: Column) -> Column:
    """The one type that either technology row gives; null where none or both do."""
    rows = [F.element_at(F.array(*map(F.lit, row)), (orientation + 1).cast("int")) for row in PAIR_TYPES]
    known = [r != "UNKNOWN" for r in rows]
    return F.when(known[0] & ~known[1], rows[0]).when(known[1] & ~known[0], rows[1])


def normal_pair(orientation: Column, qual: Column, mate_qual: Column, min_qual: int, same_ref: Column, include_cross: bool = False) -> Column:
    """A pair fit for the histogram of fragment lengths: mapped well on both sides, of normal orientation."""
    fit = (qual >= min_qual) & (mate_qual >= min_qual) & (pair_type(orientation) == "NORMAL")
    return fit if include_cross else fit & same_ref


def near_enough(same_ref: Column, distance: Column, low: Column, median: Column, high: Column) -> Column:
    """Halves on one reference within the library's window, widened on both sides by its distance to the median."""
    return same_ref & distance.between(low - (median - low), high + (high - median))


def problematic(flag: Column, ref: Column, mate_ref: Column, sums: Column, max_ops: int = 5, max_clip: float = 0.15) -> Column:
    """Unmapped, across references, of many operations, or clipped by a good part of its length; sums are the CIGAR's."""
    return A.has(flag, A.UNMAPPED) | (ref != mate_ref) | (sums["parts"] > max_ops) | (sums["S"] > max_clip * A.sum_of(sums, "MIS=X"))


def mismatch_rate(sums: Column) -> Column:
    """Inserted, deleted, clipped and differing bases by those of the read, from the CIGAR's sums; null for a read of none."""
    read = A.sum_of(sums, "MIS=X")
    return F.when(read > 0, A.sum_of(sums, "IDSX") / read)


def role(flag: Column, qual: Column, sums: Column, min_qual: int, long_clip: int, max_rate: float) -> Column:
    """What a half can serve as: orphan, anchor, multiple, soft or none, in this order; sums are its CIGAR's."""
    lead, trail = sums["lead"] >= long_clip, sums["trail"] >= long_clip
    return (
        F.when(A.has(flag, A.UNMAPPED), "orphan").when((qual >= min_qual) & ~lead & ~trail, "anchor")
        .when((lead.cast("int") + trail.cast("int")) == 1, "soft").when(mismatch_rate(sums) <= max_rate, "multiple").otherwise("none")
    )


def mate_end(mate_pos: Column, mate_cigar: Column, own_end: Column, read_length: Column) -> Column:
    """The mate's closed end: by its CIGAR, else the record's own end, else by the read's length."""
    return F.coalesce(mate_pos + A.length_of(mate_cigar, "DMN=X") - 1, own_end, mate_pos + read_length - 1)


def encode_cigar(cigar: Column) -> Column:
    """Operations as numbers: the length above four bits of the operation's code."""
    return F.transform(A.cigar_ops(cigar), lambda x: F.shiftleft(x["len"].cast("long"), 4).bitwiseOR(F.instr(F.lit(CIGAR_CODES), x["op"]).cast("long") - 1))


def format_mate_tag(best: Column, second: Column, code: Column, n_map: Column, cigar: Column, md: Column, mate: Column) -> Column:
    """`<@;best;second;code;n;cigar;md>`, with & for the mate's half; what is null stays empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("<"), F.concat_ws(";", F.when(mate, "&").otherwise("@"), *[text(c) for c in (best, second, code, n_map, cigar, md)]), F.lit(">"))


def split_window(forward: Column, pos: Column, end: Column, read_length: Column, high: Column, limit: Column) -> Column:
    """Where the mate of an anchor is looked for: (low, high), closed and clipped to the reference."""
    low = F.when(forward, end + 1 - read_length).otherwise(end - high - 2 * read_length)
    top = F.when(forward, pos + high + 2 * read_length).otherwise(pos - 1 + read_length)
    return F.struct(F.greatest(low, F.lit(0)).alias("low"), F.least(top, limit - 1).alias("high"))


def detection_set(mask: int, names: list[str]) -> list[str]:
    """The event types of a bit mask, bit by bit; a mask of none is refused."""
    if mask <= 0 or mask >> len(names):
        raise ValueError(f"no detection set: {mask}")
    return [n for i, n in enumerate(names) if mask >> i & 1]


def natural_key(name: Column) -> Column:
    """A key that sorts digits inside names by their number: runs of digits are led by their length without zeros."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 3, "0"), number(x))).otherwise(x)), "")


def chromosome_rank(chrom: Column) -> Column:
    """The order of calls: numbers by value, X is 23, Y is 24, all others 0."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.rlike("^[0-9]{1,9}$"), bare.try_cast("int")).otherwise(0)
