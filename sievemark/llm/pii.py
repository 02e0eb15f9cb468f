"""Format-preserving pseudonyms for personal data.

Numbers and dates that validate are mapped by a keyed Feistel network onto values of the same format, so that one person's
number stays the same in all documents and no table of pseudonyms is kept:

* card numbers that pass the Luhn test keep length and separators, and the new number passes it too;
* IBANs that pass modulo 97 keep country and length and get new check digits;
* where a run of digits or of IBAN groups fails as a whole, what validates between two of its separators is replaced, so
  that a number beside a date, a code or an amount is found;
* telephone numbers and social security numbers keep their punctuation;
* IPv4 addresses with octets up to 255 map onto such addresses;
* dates map onto dates of 1900-2099, the same day alike in every notation.

Mail addresses keep their domain and get a keyed local part. Numbers that do not validate are left alone. Everything is
column expressions over one pattern: a text is split once, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty
from ._spans import matches, rewritten_by

MAIL = r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE = rf"(?:{ISO_DATE}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}})"
PHONE = r"\+?(?:[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
_APART = r"(?![\p{L}\p{N}])"
#: A run of 13 digits or more that can hold card numbers; it ends before a value of another kind.
_CARD_SEP = rf"[\x20-](?!(?:{ISO_DATE}T|(?:{DATE}|{SSN}|{IP}|{PHONE}){_APART}))"
CARD = rf"(?![0-9]{{20}})[0-9](?:(?:{_CARD_SEP}(?![0-9]{{20}}))?[0-9]){{12,799}}"
#: Kinds in the order in which they are tried at a place.
KINDS = {"mail": MAIL, "iban": IBAN, "date": DATE, "ssn": SSN, "ip": IP, "phone": PHONE, "card": CARD}
ANY = r"(?<![\p{L}\p{N}])(?:(?:" + "|".join(KINDS.values()) + rf"){_APART}|{ISO_DATE}(?=T[0-9]{{2}}:?[0-9]{{2}}))"
#: Lengths of the IBANs of the registry by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
DIGITS, HEX_DIGITS, ALNUM = "0123456789", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _keyed(key: str, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _chars(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.substr(x, i, F.lit(1)))


def _locate_of(c: Column, alphabet: str) -> Column:
    return F.instr(F.lit(alphabet), c) - 1


def feistel_string(x: Column, alphabet: str, key: str, rounds: int = 6) -> Column:
    """A keyed bijection of the strings of ``x``'s length over ``alphabet``; needs two characters or more.

    Each round adds to every character of one half a keyed function of the other half and of the place, modulo the size
    of the alphabet.
    """
    half = F.floor(F.length(x) / 2).cast("int")
    left, right = F.substr(x, F.lit(1), half), F.substr(x, half + 1, F.length(x) - half)

    def turned(part: Column, other: Column, r: int) -> Column:
        def one(c: Column, i: Column) -> Column:
            moved = F.pmod(_locate_of(c, alphabet) + _keyed(key, F.lit(str(r)), i.cast("string"), other), F.lit(len(alphabet)))
            return F.substr(F.lit(alphabet), moved.cast("int") + 1, F.lit(1))

        return F.array_join(F.transform(_chars(part), one), "")

    state = F.struct(left.alias("l"), right.alias("r"))
    def step(r: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["r"].alias("l"), turned(s["l"], s["r"], r).alias("r"))

    if rounds % 2:
        raise ValueError("the halves trade places in each round; take an even number")
    for r in range(rounds):
        state = _bind(state, step(r))
    return _bind(state, lambda s: F.concat(s["l"], s["r"]))


def _bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refilled(shape: Column, new: Column, chars: str = "[0-9]") -> Column:
    """``shape`` with its characters of class ``chars`` replaced, one after the other, by those of ``new``."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        hit = F.rlike(c, F.lit(chars))
        out = F.concat(acc["out"], F.when(hit, F.substr(new, acc["n"] + 1, F.lit(1))).otherwise(c))
        return F.struct((acc["n"] + hit.cast("int")).alias("n"), out.alias("out"))

    return F.aggregate(_chars(shape), start, step, lambda acc: acc["out"])


def _luhn_sum(digits: Column, offset: int) -> Column:
    """Sum of the Luhn test; ``offset`` 1 leaves room for a check digit."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when((i + offset) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), one), F.lit(0), lambda s, v: s + v)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def _between(x: Column, seps: str, least: int, most: int, made: Callable[[Column], Column]) -> Column:
    """``x`` with what ``made`` replaces between its separators: from the left, the longest first, ``least`` to ``most``
    characters besides separators; null if nothing is."""  # noqa: D205
    kind = "struct<at:int,out:string,hit:boolean>"

    def within(cuts: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda i: i + 1))
        ends = F.concat(F.array(F.length(x)), F.transform(F.reverse(cuts), lambda i: i - 1))
        fits = lambda a, z: F.length(F.regexp_replace(F.substr(x, a, z - a + 1), seps, "")).between(least, most)
        of = lambda a: F.transform(F.filter(ends, lambda z: (z - a < 2 * most) & (z - a + 1 >= least) & fits(a, z)), lambda z: F.struct(a.alias("a"), z.alias("z")))
        spans = F.flatten(F.transform(starts, of))

        def step(acc: Column, span: Column) -> Column:
            def taken(new: Column) -> Column:
                out = F.concat(acc["out"], F.substr(x, acc["at"], span["a"] - acc["at"]), new)
                return F.when(new.isNotNull(), F.struct((span["z"] + 1).alias("at"), out.alias("out"), F.lit(True).alias("hit")).cast(kind)).otherwise(acc)

            return F.when(span["a"] < acc["at"], acc).otherwise(_bind(made(F.substr(x, span["a"], span["z"] - span["a"] + 1)), taken))

        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(False).alias("hit")).cast(kind)
        return F.aggregate(spans, start, step, lambda acc: F.when(acc["hit"], F.concat(acc["out"], F.substr(x, acc["at"], F.length(x) - acc["at"] + 1))))

    return _bind(F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: F.rlike(F.substr(x, i, F.lit(1)), F.lit(seps))), within)


def _card(x: Column, key: str) -> Column:
    return _between(x, r"[\x20-]", 13, 19, lambda part: _one_card(part, key))


def _one_card(x: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = feistel_string(F.substr(d, F.lit(1), F.length(d) - 1), DIGITS, f"{key}/card")
        checked = _bind(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(b, 1), F.lit(10)).cast("string")))
        return F.when(luhn_valid(d), _refilled(x, checked))

    return _bind(only_digits(x), made)


def _mod97(x: Column) -> Column:
    """Remainder modulo 97 of a string of digits and capital letters (A is 10)."""

    def step(acc: Column, c: Column) -> Column:
        v = _locate_of(c, ALNUM)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(_chars(x), F.lit(0), step)


def _iban(x: Column, key: str) -> Column:
    """A match that validates whole, else the parts between its spaces that do and have their country's length."""
    lengths = F.create_map(*(F.lit(v) for n, names in IBAN_LENGTHS.items() for c in names.split() for v in (c, n)))
    right = lambda part: F.rlike(part, F.lit("^[A-Z]{2}[0-9]{2}")) & (F.length(F.replace(part, F.lit(" "))) == F.try_element_at(lengths, F.substr(part, F.lit(1), F.lit(2))))
    return _between(x, r"\x20", 12, 35, lambda part: F.when(right(part) | (part == x), _one_iban(part, key)))


def _one_iban(x: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        country, body = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5))
        valid = _mod97(F.concat(body, F.substr(d, F.lit(1), F.lit(4)))) == 1
        digits = only_digits(body)
        moved = _refilled(body, feistel_string(digits, DIGITS, f"{key}/iban"))
        whole = _bind(moved, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(valid & (F.length(digits) > 1), _refilled(x, whole, "[0-9A-Z]"))

    return _bind(F.replace(x, F.lit(" ")), made)


def _phone(x: Column, key: str) -> Column:
    """The last ten digits move; what stands before them is the country code."""

    def made(d: Column) -> Column:
        code = F.substr(d, F.lit(1), F.length(d) - 10)
        return _refilled(x, F.concat(code, feistel_string(F.substr(d, F.length(d) - 9), DIGITS, f"{key}/phone")))

    return _bind(only_digits(x), made)


def _ssn(x: Column, key: str) -> Column:
    return _refilled(x, feistel_string(only_digits(x), DIGITS, f"{key}/ssn"))


def _ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    packed = F.lower(F.array_join(F.transform(octets, lambda o: F.lpad(F.hex(o), 2, "0")), ""))
    moved = feistel_string(packed, HEX_DIGITS, f"{key}/ip")
    back = _bind(moved, lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10)), "."))
    return F.when(F.forall(octets, lambda o: o <= 255), back)


#: Days from 1900-01-01 to 2099-12-31 are 17 times 4297.
_DAYS = (17, 4297)


def _day(n: Column, key: str, rounds: int = 6) -> Column:
    """A keyed bijection of the days 0 to 73,048, as a network over residues modulo 17 and 4297."""
    a, b = _DAYS
    state = F.struct(F.pmod(n, F.lit(a)).cast("long").alias("a"), F.floor(n / a).cast("long").alias("b"))

    def step(r: int) -> Callable[[Column], Column]:
        def both(s: Column) -> Column:
            left = F.pmod(s["a"] + _keyed(key, F.lit(f"{r}a"), s["b"].cast("string")), F.lit(a))
            return _bind(left, lambda x: F.struct(x.alias("a"), F.pmod(s["b"] + _keyed(key, F.lit(f"{r}b"), x.cast("string")), F.lit(b)).alias("b")))

        return both

    for r in range(rounds):
        state = _bind(state, step(r))
    return _bind(state, lambda s: (s["b"] * a + s["a"]).cast("int"))


def _date(x: Column, key: str) -> Column:
    """ISO dates, and day-month-year with points or slashes; a text that is no date of 1900-2099 is left alone."""
    first, mark = F.lit("1900-01-01").cast("date"), F.substr(x, F.lit(3), F.lit(1))
    iso = F.rlike(x, F.lit("^[0-9]{4}-"))
    ymd = F.when(iso, x).otherwise(F.concat_ws("-", F.substr(x, F.lit(7)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))))

    def made(day: Column) -> Column:
        new = F.date_add(first, _day(F.date_diff(day, first), f"{key}/date"))
        shown = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
            F.concat_ws("", F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy"))
        )
        return F.when((F.year(day) >= 1900) & (F.year(day) <= 2099) & (iso | (mark == F.substr(x, F.lit(6), F.lit(1)))), shown)

    return _bind(F.try_to_date(ymd, "yyyy-MM-dd"), made)


def _mail(x: Column, key: str) -> Column:
    at = F.instr(x, "@")
    name = F.sha2(F.concat(F.lit(f"{key}/mail"), F.lower(F.substr(x, F.lit(1), at - 1))).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substr(name, F.lit(1), F.lit(16)), F.substr(x, at))


_MAKERS = {"mail": _mail, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def kind_of(x: Column) -> Column:
    """The kind of a match: the first whose pattern fits it whole."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(F.rlike(x, F.lit(f"^(?:{KINDS[name]})$")), name).otherwise(kind)
    return kind


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of a match; the match itself if it does not validate."""

    def one(kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, made in _MAKERS.items():
            out = F.when(kind == name, made(x, key)).otherwise(out)
        return out

    return F.coalesce(_bind(kind_of(x), one), x)


def _only(kinds: str, name: str) -> Column:
    return F.filter(kinds, lambda k: k == name)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_<kind>..., n_replaced)`` of each row, with pseudonyms in the text.

    ``n_<kind>`` counts what has the kind's shape, ``n_replaced`` the values that changed. A null text is empty. Rows are
    worked on singly, so null ids, repeated rows, ties and empty tables need no rule, and other columns are ignored. Texts
    of any length are searched whole. Equal values have equal pseudonyms under one key, in every document.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = source.withColumn("values", F.when(F.rlike("text", F.lit("[0-9@]")), matches(F.col("text"), ANY)).otherwise(F.array().cast("array<string>")))
    kinds = F.transform("values", kind_of)
    new = F.transform("values", lambda v: pseudonym(v, key))
    found = found.withColumn("kinds", kinds).withColumn("new", new)
    return found.select(
        "id", F.when(F.size("values") > 0, rewritten_by(F.col("text"), ANY, F.col("new"))).otherwise(F.col("text")).alias("text"),
        *(F.size(_only("kinds", n)).cast("long").alias(f"n_{n}") for n in KINDS),
        F.size(F.filter(F.arrays_zip("values", "new"), lambda x: x["values"] != x["new"])).cast("long").alias("n_replaced"),
    )
