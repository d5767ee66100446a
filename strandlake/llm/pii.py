"""Operator 1, PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

A value is found by pattern, validated (Luhn, mod 97, octets, calendar, area rules), and permuted by a keyed Feistel
network inside its own format, so that equal values get equal pseudonyms in every document and unequal ones of a format never
meet: digits stay digits, separators stay in place, check digits are made anew, dates stay dates. Letters of mail addresses
and of secrets are permuted inside their alphabets, capitals stay where they were, and neither the case of a mail address or hex
secret nor the separators of a phone number change its pseudonym. Country codes, known by prefix, stay. What fails validation is
left as it is. A slash date is read month first unless that fails, and written as it was read: the pseudonyms of 20/03/1999 and
of some date read the other way may look alike, those of one reading never do.

The key comes from the caller, else from the session's setting strandlake.pii.key, else it is KEY, with a warning, which only tests should use.
Spark writes it into plans and event logs as part of expressions; spark.sql.redaction.string.regex can keep it out of them.

Values may stand side by side: patterns are greedy, so at each place where one matches, exact shapes (country lengths of
IBANs, groups and issuers of cards, phones) are tried before the whole match, and shorter prefixes after it. Where
nothing holds, the search goes on behind the first digits or letters of the match. A run of numbers is searched in windows of
bounded size, whose last AHEAD characters wait for the next window; so work grows with the text's length, and values of up to
AHEAD characters, mail addresses and secrets of up to TOKEN, are found whole wherever they stand. A mail's host has 127 labels at most.

Defined cases: a null text stays null with counts of 0; empty texts stay empty; texts are read whole; repeated rows get
equal results; other columns are carried along by `pseudonymize_rows` and may bear any name.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
KEY = "pii-key-1"
KEY_SETTING = "strandlake.pii.key"
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Dates are permuted among the 73,049 days of 1900 to 2099, laid out as 17 rows of 4,297.
FIRST_DAY, DATE_ROWS, DATE_COLUMNS = "1900-01-01", 17, 4297
#: An international number, and a card in odd groups, end before another value.
_NEXT = r"(?! (?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-]?[0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?:[^0-9A-Za-z]|$))"
#: One alternative a kind, tried in this order where several could start.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{32}|[0-9A-F]{32})(?![0-9A-Za-z])|(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])|(?:[0-9a-f]{64}|[0-9A-F]{64})(?![0-9A-Za-z])|A(?:KI|SI)A[0-9A-Z]{16}(?![0-9A-Za-z])|(?:sk|pk|gh[opsu]|xox[abp])[_-][0-9A-Za-z_-]{16,}(?![0-9A-Za-z]))",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9A-Za-z]|[ .-][0-9])|(?<![0-9A-Za-z])\+[0-9](?:" + _NEXT + r"[ .-]?[0-9]){7,13}(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these characters holds nothing to find.
HINT = "[0-9@]"
#: Chunks with digits or @, or parts of an IBAN, parted by single spaces: every match lies whole inside one run.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: (?:[0-9A-Z]{1,4}(?![0-9A-Za-z])\S*+|[^\s0-9@]*+[0-9@]\S*+))*+"
#: The first match behind the first two characters, which are only there for what patterns ask of them.
FIRST = rf"(?<=[\s\S]{{2}})(?:{ANY})"
#: A window takes so many characters and what its last token, of up to TOKEN characters, has beyond; the last AHEAD of it, more than any other value
#: and what patterns ask behind it, wait for the next one.
WINDOW, TOKEN, AHEAD = 256, 4096, 128
WINDOWS = rf"[\s\S]{{1,{WINDOW}}}[0-9A-Za-z._%+@-]{{0,{TOKEN}}}+"
#: Lengths of IBANs, without spaces, with their countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
#: Country codes of phone numbers: of one or two digits, else of three.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Issuers' first digits with their lengths.
ISSUER = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35[0-9]{14}|6[0-9]{12,18}|5[06-9][0-9]{11,17})$"
#: Groups of a card's digits; one of 19 digits in groups only where no number goes on behind it.
CARD_SHAPES = [r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}(?![ .-]?[0-9])", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", "[0-9]{13,19}"]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(hexes: Column, place: Column | int) -> Column:
    """Four hex digits of a hash, from the place-th group on."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substr(hexes, at * 4 + 1, F.lit(4)), 16, 10).cast("long")


def _hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), turn.cast("string"), half), 512)


def _shift(text: Column, hexes: Column, hex_only: bool) -> Column:
    """Each character moved inside its alphabet by the hash; others stay."""
    letters = HEX if hex_only else DIGITS + LOWER + UPPER

    def one(c: Column, i: Column, hexes: Column) -> Column:
        place = F.instr(F.lit(letters), c).cast("int") - 1
        first = F.lit(0) if hex_only else F.when(place < 10, 0).when(place < 36, 10).otherwise(36)
        length = F.lit(16) if hex_only else F.when(place < 10, 10).otherwise(26)
        step = _number(hexes, F.pmod(i, F.lit(32)).cast("int"))
        moved = F.substr(F.lit(letters), (first + F.pmod(place - first + step, length) + 1).cast("int"), F.lit(1))
        return F.when((place < 0) | (c == ""), c).otherwise(moved)

    return _let(hexes, lambda h: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, h)), ""))


def feistel_text(text: Column, kind: str, key: str = KEY, hex_only: bool = False) -> Column:
    """A permutation of the texts of one shape (the class of each character): halves are shifted by each other in turn."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1, F.length(text)).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, _shift(s["a"], _hash(key, kind, r, s["b"]), hex_only)).otherwise(s["a"])
        right = F.when(r % 2 == 1, _shift(s["b"], _hash(key, kind, r, s["a"]), hex_only)).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(number: Column, kind: str, rows: int, columns: int, key: str = KEY) -> Column:
    """A permutation of 0 to rows * columns - 1: row and column are shifted by hashes of each other in turn."""
    start = F.struct(F.floor(number / columns).cast("long").alias("a"), F.pmod(number, F.lit(columns)).cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        of = lambda x: F.conv(F.substr(_hash(key, kind, r, x.cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long")
        left = F.when(r % 2 == 0, F.pmod(s["a"] + of(s["b"]), F.lit(rows))).otherwise(s["a"])
        right = F.when(r % 2 == 1, F.pmod(s["b"] + of(s["a"]), F.lit(columns))).otherwise(s["b"])
        return F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * columns + s["b"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column, odd_from_right: int) -> Column:
    """Sum of the digits, doubled (and cast out) at every second place from the right, from the given place on."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == odd_from_right, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters (A is 10)."""

    def add(s: Column, c: Column) -> Column:
        p = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(p < 10, (s * 10 + p) % 97).otherwise((s * 100 + p) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _refill(shape: Column, values: Column, places: str) -> Column:
    """The characters of values put, in turn, where shape has characters of the class."""
    other = f"[^{places}]"

    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(shape, F.lit(1), (i + 1).cast("int")), other, ""))
        return F.when(c.rlike(f"[{places}]"), F.substr(values, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _date_of(x: Column) -> Column:
    iso = F.when(x.rlike("^[0-9]{4}-"), x)
    second, first = F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))
    year = F.substr(x, F.lit(7), F.lit(4))
    day_first = F.when(x.contains(".") | (first.cast("int") > 12), F.concat_ws("-", year, second, first)).otherwise(F.concat_ws("-", year, first, second))
    return F.to_date(F.try_to_timestamp(F.coalesce(iso, day_first), F.lit("yyyy-MM-dd")))


def _write_date(x: Column, day: Column) -> Column:
    out = F.when(x.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(x.contains("."), F.date_format(day, "dd.MM.yyyy"))
    return out.otherwise(F.when(F.substr(x, F.lit(1), F.lit(2)).cast("int") > 12, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy")))


def _valid(kind: Column, x: Column) -> Column:
    d = _digits(x)
    parts = F.split(x, r"\.")
    compact = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5), F.length(compact)), F.substr(compact, F.lit(1), F.lit(4)))
    area = F.substr(d, F.lit(1), F.lit(3))
    valid = {
        "email": F.lit(True),
        "secret": x.rlike("[0-9]") & x.rlike("[a-zA-Z]"),
        "iban": _mod97(turned) == 1,
        "date": F.datediff(_date_of(x), F.lit(FIRST_DAY).cast("date")).between(0, DATE_ROWS * DATE_COLUMNS - 1),
        "ip": F.when(x.contains(":"), x.rlike("[0-9]") & (F.size(F.split(x, ":")) <= 8)).otherwise(F.forall(parts, lambda p: p.try_cast("int") <= 255)),
        "ssn": ~area.isin("000", "666") & (area < "900") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6), F.lit(4)) != "0000"),
        "card": _luhn_sum(d, 1) % 10 == 0,
        "phone": F.length(d).between(8, 15),
    }
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, valid[k]).otherwise(out)
    return out


def _candidates() -> list[tuple[str, str, bool]]:
    """(kind, pattern, whether a card needs an issuer) in the order tried at a place."""
    end = r"(?![0-9A-Za-z])"

    def iban(land: str, length: int) -> str:
        quads, rest = divmod(length - 4, 4)
        return rf"(?<![0-9A-Za-z]){land}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{quads}}}" + (rf" ?[0-9A-Z]{{{rest}}}" if rest else "") + end

    lands = "|".join(IBAN_LENGTHS.values())
    exact = [(k, PATTERNS[k], False) for k in ("email", "secret")] + [("iban", iban(f"(?:{own})", n), False) for n, own in IBAN_LENGTHS.items()]
    exact += [(k, PATTERNS[k], False) for k in ("date", "ip", "ssn")] + [("card", rf"(?<![0-9A-Za-z]){p}{end}", True) for p in CARD_SHAPES] + [("phone", PATTERNS["phone"], False)]
    # without a known issuer, a card is a number of its own, not some groups among others
    whole = [("iban", PATTERNS["iban"], False), ("card", rf"(?<![0-9A-Za-z])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{12,18}}(?![ -]?[0-9]|[A-Za-z])", False)]
    shorter = [("iban", iban(f"(?!{lands})[A-Z]{{2}}", n), False) for n in range(34, 11, -1)] + [("card", rf"(?<![0-9A-Za-z])[0-9](?:{_NEXT}[ -]?[0-9]){{{n - 1}}}{end}", True) for n in range(19, 12, -1)]
    return exact + whole + shorter


def _value_at(place: Column) -> Column:
    """(kind, value) of the first candidate that holds right behind the first two characters of place, else null."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract(place, rf"^[\s\S]{{2}}({p})", 1).alias("value"), F.lit(issuer).alias("issuer")) for k, p, issuer in _candidates()])
    found = F.filter(F.filter(found, lambda c: c["value"] != ""), lambda c: _valid(c["kind"], c["value"]) & (~c["issuer"] | _digits(c["value"]).rlike(ISSUER)))
    return F.get(found, F.lit(0))


def _scan_window(start: Column, last: Column, key: str) -> Column:
    """The state (before, rest, text, found) after a search of rest from left to right: a value found is left behind whole, else the first digits or letters.

    before holds the two characters ahead of rest. Unless the window is the last one, what begins in its last AHEAD characters stays in rest.
    """
    tail = lambda x: F.right(x, F.lit(2))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    from_ = lambda x, n: F.substr(x, n + 1, F.length(x))

    def state(before: Column, rest: Column, text: Column, found: Column) -> Column:
        return F.struct(before.alias("before"), rest.alias("rest"), text.alias("text"), found.alias("found"))

    def step(s: Column, _: Column) -> Column:
        parts = F.concat(s["before"], s["rest"])
        cut = F.struct(F.get(F.split(parts, FIRST, 2), F.lit(0)).alias("gap"), F.regexp_extract(parts, FIRST, 0).alias("match"), parts.alias("all"))

        def at(cut: Column) -> Column:
            rest = from_(cut["all"], F.length(cut["gap"]))
            text = F.concat(s["text"], from_(cut["gap"], F.lit(2)))
            kept = F.when(last, 0).otherwise(F.least(F.length(s["rest"]), F.lit(AHEAD)))
            told = F.length(cut["all"]) - kept

            def settle(v: Column) -> Column:
                skip = F.regexp_extract(cut["match"], r"^[^0-9A-Za-z]*[0-9A-Za-z]+", 0)
                left = state(tail(F.concat(cut["gap"], skip)), from_(rest, F.length(skip)), F.concat(text, skip), s["found"])
                made = lambda new: state(F.lit("\n\n"), from_(rest, F.length(v["value"])), F.concat(text, new), F.concat(s["found"], F.array(F.struct(v["kind"].alias("kind"), new.alias("value")))))
                return F.when(v.isNull(), left).otherwise(_let(_pseudonym(v["value"], v["kind"], key), made))

            seen = F.substr(cut["all"], F.lit(1), told)
            waits = state(tail(seen), from_(cut["all"], told), F.concat(s["text"], from_(seen, F.lit(2))), s["found"])
            unsure = (cut["match"] == "") | (F.length(cut["gap"]) > told)
            return F.when(unsure, waits).otherwise(_let(_value_at(F.concat(tail(cut["gap"]), rest)), settle))

        return F.when((s["rest"] == "") | (~last & (F.length(s["rest"]) <= AHEAD)), s).otherwise(_let(cut, at))

    steps = F.sequence(F.lit(1), F.size(F.split(start["rest"], "[^0-9A-Za-z]+")) + 1)
    return F.aggregate(steps, F.struct(start["before"], start["rest"], F.lit("").alias("text"), none.alias("found")), step)


def _scan(run: Column, key: str) -> Column:
    """(text, found) of a run, window by window."""
    cut = F.regexp_extract_all(run, F.lit(WINDOWS), F.lit(0))
    flagged = _let(cut, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), (i == F.size(ws) - 1).alias("last"))))
    done = F.array().cast("array<struct<text:string,found:array<struct<kind:string,value:string>>>>")
    start = F.struct(F.lit("\n\n").alias("before"), F.lit("").alias("rest"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        begun = F.struct(s["before"].alias("before"), F.concat(s["rest"], x["w"]).alias("rest"))
        went = lambda b: _let(
            _scan_window(b, x["last"], key),
            lambda r: F.struct(r["before"].alias("before"), r["rest"].alias("rest"), F.concat(s["done"], F.array(F.struct(r["text"].alias("text"), r["found"].alias("found")))).alias("done")),
        )
        return _let(begun, went)

    def joined(s: Column) -> Column:
        return F.struct(F.concat(F.array_join(F.transform(s["done"], lambda d: d["text"]), ""), s["rest"]).alias("text"), F.flatten(F.transform(s["done"], lambda d: d["found"])).alias("found"))

    return F.aggregate(flagged, start, step, joined)


def _capitals(old: Column, new: Column) -> Column:
    """new with capitals where old has them."""
    return F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substr(old, (i + 1).cast("int"), F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")


def _email(x: Column, key: str) -> Column:
    """Permuted in small letters, so that all spellings of an address stay linked."""
    low = F.lower(x)
    host = F.substring_index(low, "@", -1)
    site = feistel_text(F.regexp_extract(host, r"^(.*)\.[a-z]+$", 1), "host", key)
    whole = F.concat(feistel_text(F.substring_index(low, "@", 1), "email", key), F.lit("@"), site, F.lit("."), F.substring_index(host, ".", -1))
    return _let(whole, lambda new: F.when(low == x, new).otherwise(_capitals(x, new)))


def _secret(x: Column, key: str) -> Column:
    """Hex ones are keyed on the lower case, so that both spellings of a secret stay linked; of others the known prefix stays."""
    new = feistel_text(F.lower(x), "secret", key, hex_only=True)
    spelled = F.when(x.rlike("[A-F]"), F.upper(new)).otherwise(new)
    lead = F.length(F.regexp_extract(x, "^(?:A(?:KI|SI)A|[a-z]{2,4}[_-])", 0))
    other = F.concat(F.substr(x, F.lit(1), lead), feistel_text(F.substr(x, lead + 1, F.length(x)), "token", key))
    return F.when(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), spelled).otherwise(other)


def _card(x: Column, key: str) -> Column:
    def whole(payload: Column) -> Column:
        return F.concat(payload, F.pmod(-_luhn_sum(F.concat(payload, F.lit("0")), 1), F.lit(10)).cast("string"))

    payload = _let(_digits(x), lambda d: feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), "card", key))
    return _let(_let(payload, whole), lambda new: _refill(x, new, "0-9"))


def _iban(x: Column, key: str) -> Column:
    compact = F.regexp_replace(x, " ", "")
    land = F.substr(compact, F.lit(1), F.lit(2))
    check = lambda bank: F.lpad((98 - _mod97(F.concat(bank, land, F.lit("00")))).cast("string"), 2, "0")
    whole = _let(feistel_text(F.substr(compact, F.lit(5), F.length(compact)), "iban", key), lambda bank: F.concat(land, check(bank), bank))
    return _let(whole, lambda new: _refill(x, new, "0-9A-Z"))


def _date(x: Column, key: str) -> Column:
    days = F.datediff(_date_of(x), F.lit(FIRST_DAY).cast("date")).cast("long")
    new = feistel_number(days, "date", DATE_ROWS, DATE_COLUMNS, key).cast("int")
    return _let(F.date_add(F.lit(FIRST_DAY).cast("date"), new), lambda day: _write_date(x, day))


def _ip(x: Column, key: str) -> Column:
    """Version 6 in small letters, digit by digit; its colons stay."""
    octet = lambda i: F.try_element_at(F.split(x, r"\."), F.lit(i)).try_cast("long")
    old = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    new = feistel_number(old, "ip", 65536, 65536, key)
    four = _let(new, lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / 256**p), F.lit(256)).cast("string") for p in (3, 2, 1, 0)]))
    return F.when(x.contains(":"), feistel_text(F.lower(x), "ip6", key, hex_only=True)).otherwise(four)


def _ssn(x: Column, key: str) -> Column:
    """Among 898 areas (001 to 899 without 666) of 99 * 9,999 numbers."""
    area = F.substr(x, F.lit(1), F.lit(3)).cast("long") - 1
    area = F.when(area > 665, area - 1).otherwise(area)
    rest = (F.substr(x, F.lit(5), F.lit(2)).cast("long") - 1) * 9999 + F.substr(x, F.lit(8), F.lit(4)).cast("long") - 1

    def write(n: Column) -> Column:
        first, rest = F.floor(n / 989901) + 1, F.pmod(n, F.lit(989901))
        first = F.when(first > 665, first + 1).otherwise(first)
        parts = (first, 3), (F.floor(rest / 9999) + 1, 2), (F.pmod(rest, F.lit(9999)) + 1, 4)
        return F.concat_ws("-", *[F.lpad(v.cast("string"), width, "0") for v, width in parts])

    return _let(feistel_number(area * 989901 + rest, "ssn", 898, 989901, key), write)


def _phone(x: Column, key: str) -> Column:
    """A country code stays, so that all spellings of a number stay linked."""
    lead = F.length(F.regexp_extract(x, rf"^\+({COUNTRY_CODES})", 1))
    new = _let(_digits(x), lambda d: F.concat(F.substr(d, F.lit(1), lead), feistel_text(F.substr(d, lead + 1, F.length(d)), "phone", key)))
    return _let(new, lambda n: _refill(x, n, "0-9"))


def _pseudonym(x: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
    out = x
    for k in KINDS:
        out = F.when(kind == k, made[k](x, key)).otherwise(out)
    return out


def with_pseudonyms(docs: DataFrame, text: str = "text", key: str | None = None, out: str = "pii") -> DataFrame:
    """docs with one struct column more: the new text and `found`, an array of (kind, pseudonym) in text order.

    A column of the name out would be lost, so there must be none.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out!r} already")
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"no key given and {KEY_SETTING} isn't set: pseudonyms made with the key in the source can be undone by anyone", stacklevel=2)
        key = KEY
    t = F.col(text)
    scanned = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda run: _scan(run, key))
    nothing = F.array().cast("array<struct<text:string,found:array<struct<kind:string,value:string>>>>")
    hit = F.coalesce(t.rlike(HINT), F.lit(False))
    found = docs.withColumn(out, F.struct(F.when(hit, scanned).otherwise(nothing).alias("all")))
    pieces = F.zip_with(F.split(t, RUN, -1), F.col(out)["all"], lambda gap, m: F.concat(gap, F.coalesce(m["text"], F.lit(""))))
    new = F.when(F.size(F.col(out)["all"]) > 0, F.array_join(pieces, "")).otherwise(t)
    return found.withColumn(out, F.struct(new.alias("text"), F.flatten(F.transform(F.col(out)["all"], lambda m: m["found"])).alias("found")))


def pseudonymize_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with its personal values replaced; all columns stay, n_chars (if there) follows the text."""
    rows = with_pseudonyms(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text")), key=key)
    new = {"text": F.col("pii.text"), "n_chars": F.length("pii.text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole new text, and how many values of each kind were replaced."""
    docs = with_pseudonyms(table(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.transform("pii.found", lambda m: m["kind"])
    counts = [F.size(F.array_remove(F.array_compact(kinds), k)) for k in KINDS]
    counts = [(F.size("pii.found") - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    return docs.select("doc_id", F.col("pii.text").alias("text"), F.size("pii.found").cast("long").alias("n_pii"), *counts)
