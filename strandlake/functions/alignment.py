"""Column functions over alignment records: flags, CIGAR, tags and pair geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE = 64, 128, 256, 512, 1024
OPS = "array<struct<len:int,op:string>>"


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def usable_pair(flag: Column) -> Column:
    """Paired, not both halves unmapped, no failed check, no duplicate."""
    return has(flag, PAIRED) & ~(has(flag, UNMAPPED) & has(flag, MATE_UNMAPPED)) & ~has(flag, QC_FAIL) & ~has(flag, DUPLICATE)


def orientation(flag: Column) -> Column:
    """0 to 7: which mate comes first (bit 2), and the strands of the record and of its mate (bits 1 and 0)."""
    return F.when(has(flag, FIRST), 0).otherwise(4) + F.when(has(flag, REVERSE), 2).otherwise(0) + F.when(has(flag, MATE_REVERSE), 1).otherwise(0)


def cigar_ops(cigar: Column) -> Column:
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_sums(cigar: Column) -> Column:
    """A struct of all bases by operation (`M` to `X`), the operations' number `parts`, and the clips at both ends, `lead` and `trail`: one parse of the CIGAR.

    Store it in a column of its own and take what is needed from there with sum_of, alignment_end and the like.
    """
    letters = [*"MIDNSHP=X"]
    zero = F.lit(0)
    start = F.struct(*[zero.alias(x) for x in letters], zero.alias("parts"), zero.alias("lead"), zero.alias("trail"))

    def step(s: Column, x: Column) -> Column:
        clip = F.when(x["op"] == "S", x["len"]).otherwise(0)
        held = [(s[o] + F.when(x["op"] == o, x["len"]).otherwise(0)).alias(o) for o in letters]
        return F.struct(*held, (s["parts"] + 1).alias("parts"), F.when(s["parts"] == 0, clip).otherwise(s["lead"]).alias("lead"), F.when(s["parts"] == 0, 0).otherwise(clip).alias("trail"))

    return F.aggregate(cigar_ops(cigar), start, step)


def sum_of(sums: Column, ops: str) -> Column:
    """The bases of some operations together, from cigar_sums."""
    return sum((sums[x] for x in ops[1:]), sums[ops[0]])


def length_of(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(F.lit(ops).contains(x["op"]), x["len"]).otherwise(0))


def alignment_end(pos: Column, sums: Column) -> Column:
    """Half-open end on the reference, from cigar_sums."""
    return pos + sum_of(sums, "DMN=X")


def mismatches(sums: Column, md: Column) -> Column:
    """Inserted and deleted bases, from cigar_sums, plus the substituted ones, which MD names outside deletions."""
    return sum_of(sums, "ID") + F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Za-z]+", ""), "[^A-Za-z]", ""))


def clips(sums: Column) -> Column:
    return F.struct(sums["lead"].alias("lead"), sums["trail"].alias("trail"))


def walk(cigar: Column) -> Column:
    """The runs of an alignment that lie on the reference: op (M or D), len, ref and read (offsets where they begin), begins and ends (whether their first
    and last base are the first and last of a segment, which clips and skips part), next (I or D where one follows the last base) and next_len."""
    kind = "array<struct<op:string,len:int,ref:int,read:int,begins:boolean,ends:boolean,next:string,next_len:int>>"
    held = lambda x, letters: F.coalesce(F.lit(letters).contains(x), F.lit(False))

    def around(ops: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after, second = F.get(ops, i + 1), F.get(ops, i + 2)
            indel = held(after["op"], "ID")
            return F.struct(
                F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"]).alias("op"), x["len"].alias("len"), ((i == 0) | held(F.get(ops, i - 1)["op"], "SNH")).alias("begins"),
                (after["op"].isNull() | held(after["op"], "SNH") | (indel & (second["op"].isNull() | held(second["op"], "SNH")))).alias("ends"),
                F.when(indel, after["op"]).alias("next"), F.when(indel, after["len"]).otherwise(0).alias("next_len"),
            )

        return F.transform(ops, one)

    def step(s: Column, x: Column) -> Column:
        on_ref, on_read = x["op"].isin("M", "D", "N"), x["op"].isin("M", "I", "S")
        match = x["op"] == "M"
        run = F.struct(x["op"], x["len"], s["ref"], s["read"], (match & x["begins"]).alias("begins"), (match & x["ends"]).alias("ends"), F.when(match, x["next"]).alias("next"), F.when(match, x["next_len"]).otherwise(0).alias("next_len"))
        runs = F.when(x["op"].isin("M", "D"), F.concat(s["runs"], F.array(run).cast(kind))).otherwise(s["runs"])
        return F.struct((s["ref"] + F.when(on_ref, x["len"]).otherwise(0)).alias("ref"), (s["read"] + F.when(on_read, x["len"]).otherwise(0)).alias("read"), runs.alias("runs"))

    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast(kind).alias("runs"))
    told = F.get(F.transform(F.array(cigar_ops(cigar)), around), F.lit(0))
    return F.aggregate(told, start, step, lambda s: s["runs"])


def fragment_length(ref: Column, mate_ref: Column, insert: Column) -> Column:
    return F.when(ref == mate_ref, F.abs(insert)).otherwise(-1)


def partial_type(read_start: Column, read_end: Column, read_length: Column, tolerance: int = 5) -> Column:
    """Which side of a read aligns: its start close to the read's start is 3', its end close to the read's end is 5'."""
    return F.when(read_start < tolerance, "3'").when(read_length - read_end <= tolerance, "5'").otherwise("unknown")


def mate_tag(tag: Column) -> Column:
    """The halves of a pair tag `<@;mq1;mq2;code;n;cigar;md><&;...>` as an array of structs in their order."""
    halves = F.regexp_extract_all(tag, F.lit("<([^>]*)>"), F.lit(1))

    def half(x: Column) -> Column:
        p = F.split(x, ";", -1)
        text = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
        number = lambda i: F.try_to_number(text(i), F.lit("9999999999")).cast("int")
        return F.struct(
            F.get(p, F.lit(0)).alias("marker"), number(1).alias("best_mq"), number(2).alias("second_mq"), text(3).alias("special"),
            F.least(number(4), F.lit(65535)).alias("n_map"), text(5).alias("cigar"), text(6).alias("md"),
        )

    return F.transform(halves, half)


def difference_tags(seq: Column, ref: Column, cigar: Column) -> Column:
    """(md, nm) of a read's bases against the reference's from the alignment's first place on, as the MD and NM tags have them.

    md tells matches by their number, substituted reference bases by their letter and deleted ones behind ^; nm counts substituted, inserted and deleted
    bases. N equals nothing. Both are null where one of the three is.
    """
    at = lambda text, k: F.substring(text, (k + 1).cast("int"), F.lit(1))

    def marked(run: Column) -> Column:
        def one(i: Column) -> Column:
            read, base = at(seq, run["read"] + i), at(ref, run["ref"] + i)
            return F.when((read == base) & (base != "N"), "=").otherwise(base)

        # a space ends the deleted bases, which substituted ones may follow
        deleted = F.concat(F.lit("^"), F.substring(ref, (run["ref"] + 1).cast("int"), run["len"]), F.lit(" "))
        return F.when(run["op"] == "D", deleted).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), run["len"] - 1), one), ""))

    marks = F.array_join(F.transform(F.filter(walk(cigar), lambda run: run["len"] > 0), marked), "")
    parts = F.regexp_extract_all(marks, F.lit("(=+|\\^[A-Za-z]+|[A-Za-z])"), F.lit(1))

    def told(ps: Column) -> Column:
        number = lambda x: F.coalesce(x.startswith("="), F.lit(False))
        shown = F.transform(ps, lambda x, i: F.when(number(x), F.length(x).cast("string")).otherwise(F.concat(F.when(number(F.get(ps, i - 1)), "").otherwise("0"), x)))
        changed = F.aggregate(ps, F.lit(0), lambda s, x: s + F.when(number(x), 0).otherwise(F.length(F.replace(x, F.lit("^"), F.lit("")))))
        return F.struct(F.concat(F.array_join(shown, ""), F.when(number(F.element_at(ps, -1)), "").otherwise("0")).alias("md"), changed.alias("substituted"))

    found = F.get(F.transform(F.array(parts), told), F.lit(0))
    tags = lambda x: F.struct(x["md"].alias("md"), (x["substituted"] + length_of(cigar, "I")).alias("nm"))
    given = seq.isNotNull() & ref.isNotNull() & cigar.isNotNull()
    return F.when(given & (F.size(parts) > 0), F.get(F.transform(F.array(found), tags), F.lit(0)))


def soft_clips(pos: Column, cigar: Column, padded: bool = False) -> Column:
    """(size, read, genome) of each clip in the read's order: its bases, and the places of read and reference where it begins; a clip that leads the CIGAR
    names the read's place behind it, so that both places speak of one base. Deletions and skips move the read's place along as matches do; insertions move the
    reference's only if it is padded."""
    kind = "array<struct<size:int,read:bigint,genome:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("read"), pos.cast("bigint").alias("genome"), F.lit(True).alias("first"), F.array().cast(kind).alias("clips"))

    def step(s: Column, x: Column) -> Column:
        clip, along, inserted = x["op"] == "S", x["op"].isin("M", "D", "N", "=", "X"), x["op"] == "I"
        read = s["read"] + F.when(along | inserted | (clip & s["first"]), x["len"]).otherwise(0)
        genome = s["genome"] + F.when(along | (inserted & F.lit(padded)), x["len"]).otherwise(0)
        found = F.struct(x["len"].alias("size"), read.alias("read"), genome.alias("genome"))
        clips = F.when(clip, F.concat(s["clips"], F.array(found).cast(kind))).otherwise(s["clips"])
        return F.struct(read.alias("read"), genome.alias("genome"), F.lit(False).alias("first"), clips.alias("clips"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["clips"])
