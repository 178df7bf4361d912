"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks.

Each kind of value has a domain that splits into two mixed-radix halves; ten rounds add a
keyed hash of one half to the other, modulo its radix. That permutes the domain, so equal
values get equal pseudonyms in every document and different values different ones, and a
pseudonym is again a valid value of its kind, written in the same format:

* card: 13 to 19 digits in one run, or grouped, with a right Luhn digit. All digits but
  the last are permuted, the last is computed anew;
* iban: with right check digits (mod 97). The digits after the check digits are permuted;
* ssn: area 001-899 but 666, group 01-99, serial 0001-9999;
* ip: four numbers up to 255;
* date: YYYY-MM-DD, DD-MM-YYYY (also with dots), MM/DD/YYYY and YYYY/MM/DD that exist in
  the years 1800 to 2199, a whole cycle of the calendar of 146,097 = 189 * 773 days;
* phone: +country code and 7 to 14 more digits, or three groups of 3, 3 and 4 digits; the
  country code stays, by the table of calling codes, so a number keeps its pseudonym however
  its digits are grouped;
* email: in the part before the @ letters stay letters of their alphabet (Latin with its
  accents, Greek, Cyrillic) and case, digits stay digits; letters of other scripts stay.

A number that fails its check is no such value and stays as it is; what its match took of
the text is tried again at every later place, so values directly beside it or each other are
found. A phone has 15 digits at most. The main path is column expressions in one pass without
a shuffle. Its time grows with the text's length: each place is matched and checked once.

Defined results: a null text stays null with no finds; an empty text or one without a
valid value stays as it is; every row gives one row; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.functions.text import let
from failurelens.llm.common import unused

ROUNDS = 10

PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}_.%+-])[\p{L}\p{M}\p{N}_.%+-]+@(?:[\p{L}\p{M}\p{N}-]+\.)+[\p{L}\p{M}]{2,}",
    "date": r"(?<!\d)(?:\d{4}[-/]\d\d[-/]\d\d|\d\d[-/.]\d\d[-/.]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
#: What ends a phone beside it; groups of four digits are cards from where four, eight and so on are left.
_FOURS = "|".join(rf"\d{{4}}(?:{s}\d{{4}}){{3}}(?:(?:{s}\d{{4}}){{4}})*(?!\d|{s}\d{{4}}(?!\d))" for s in " -")
_VALUE = "|".join([*(PATTERNS[k] for k in ("email", "date", "ssn", "ip")), _FOURS, r"\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"])
_CODE = r"(?<![\w+])\+\d{1,3}(?:[ -]?\(\d{1,4}\))?"
#: Ends after the 8th to 15th digit behind the plus.
_DIGIT = r"[ .()-]{0,3}\d"
_BOUND = rf"(?!\d)(?<=\+{_DIGIT * 8}{f'(?:{_DIGIT}' * 7}{')?' * 7})"
#: With a plus: first the longest that neither takes a value beside it nor ends within a number, then the longest.
PATTERNS["phone"] = (
    rf"{_CODE}[ .-]?\d{{2,14}}(?:(?:[ .-](?!{_VALUE}))?\d{{2,14}}){{0,4}}{_BOUND}(?:(?![./-]\d|@)|(?=[./-](?:{_VALUE})))"
    rf"|{_CODE}(?:[ .-]?\d{{2,14}}){{1,5}}{_BOUND}"
    r"|(?<![\w-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?![\w-])")
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)
#: A place where a value may start, with the match there.
HERE = f"(?=({ANY}))"
#: Country calling codes (fixed values); none is the start of another, all others have three digits.
CALLING_CODE = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters outside a-z that e-mail names are shifted in.
ALPHABETS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "αβγδεζηθικλμνξοπρστυφχψω",
             "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")

#: Characters of an IBAN by country.
IBAN_LENGTHS = {n: c.split() for n, c in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()}

#: Days from 1800-01-01 to 2199-12-31, as 189 * 773.
DAYS = (189, 773)
FIRST_DAY = "1800-01-01"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _keyed(key: str, kind: str, i: Column, half: Column) -> Column:
    """60 keyed bits of one half, in round ``i``."""
    seed = F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, kind: Column | str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A permutation of the pairs (a below size_a, b below size_b)."""
    tag = kind if isinstance(kind, str) else "number"
    label = F.lit(tag) if isinstance(kind, str) else kind

    def turn(s: Column, i: Column) -> Column:
        new_a = F.pmod(s["a"] + _keyed(key, tag, F.concat_ws("/", label, i.cast("string")), s["b"]), s["m"])
        new_b = F.pmod(s["b"] + _keyed(key, tag, F.concat_ws("/", label, i.cast("string")), s["a"]), s["n"])
        return F.when(i % 2 == 0, F.struct(new_a.alias("a"), s["b"].alias("b"), s["m"].alias("m"), s["n"].alias("n"))
                      ).otherwise(F.struct(s["a"].alias("a"), new_b.alias("b"), s["m"].alias("m"), s["n"].alias("n")))

    long = [c.cast("long").alias(n) for c, n in ((a, "a"), (b, "b"), (size_a, "m"), (size_b, "n"))]
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(*long), turn)


def _permuted_digits(key: str, kind: str, d: Column) -> Column:
    """Another digit string of the same length (up to 30); each length has its own permutation."""
    n, half = F.length(d), F.floor(F.length(d) / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    left, right = F.substring(d, F.lit(1), half), F.substring(d, half + 1, n)
    label = F.concat(F.lit(kind), n.cast("string"))
    return let(_feistel(key, label, left.cast("long"), right.cast("long"), power(half), power(n - half)),
               lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), n - half, "0")))


def _refill(format_of: Column, digits: Column) -> Column:
    """The text ``format_of`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(new: Column) -> Callable[[Column, Column], Column]:
        def put(s: Column, c: Column) -> Column:
            return F.when(c.rlike(r"\d"), F.struct(F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"),
                                                   (s["at"] + 1).alias("at"))
                          ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
        return put

    return let(digits, lambda new: F.aggregate(_chars(format_of), start, step(new), lambda s: s["out"]))


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string."""
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    placed = F.transform(F.reverse(_chars(d)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(placed, F.lit(0), lambda s, v: s + v)


def _mod97(s: Column) -> Column:
    """A text of digits and capitals (A is 10) as a number modulo 97."""
    def add(r: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97)))
    return F.aggregate(_chars(s), F.lit(0), add)


def _turned(iban: Column) -> Column:
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    return F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))


def _date_order(m: Column) -> Column:
    return (F.when(m.rlike(r"^\d{4}"), F.array(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
            .when(m.rlike("^../"), F.array(F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
            .otherwise(F.array(F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))))


def _day(m: Column) -> Column:
    """Days since FIRST_DAY, or null if there is no such date in the 400 years."""
    def parsed(ymd: Column) -> Column:
        y, mo, d = (F.element_at(ymd, i).cast("int") for i in (1, 2, 3))
        real = y.between(1800, 2199) & mo.between(1, 12) & (d >= 1)
        return F.when(real, F.when(d <= F.day(F.last_day(F.make_date(y, mo, F.lit(1)))),
                                   F.datediff(F.make_date(y, mo, F.lit(1)), F.lit(FIRST_DAY).cast("date")) + d - 1))
    same = F.regexp_extract(m, r"^\d+(\D)", 1) == F.regexp_extract(m, r"(\D)\d+$", 1)
    return F.when(same, let(_date_order(m), parsed))


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its check, else null."""
    is_a = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    octets = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    area, group, serial = F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)
    ssn = (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")
    n = F.length(_digits(m))
    return (F.when(is_a("email"), F.lit("email"))
            .when(is_a("date"), F.when(_day(m).isNotNull(), F.lit("date")))
            .when(is_a("ssn"), F.when(ssn, F.lit("ssn")))
            .when(is_a("ip"), F.when(octets, F.lit("ip")))
            .when(is_a("iban"), F.when(_mod97(_turned(m)) == 1, F.lit("iban")))
            .when(is_a("card"), F.when(_luhn(_digits(m)) % 10 == 0, F.lit("card")))
            .otherwise(F.when(n.between(8, 15) | ~m.startswith("+"), F.lit("phone"))))


def _iban_within(m: Column) -> Column:
    """The valid IBAN at the start of a match that may have run into the next words, else null.

    Of several, the one of its country's length, then the longest."""
    words = F.split(m, " ")
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, 1, i), " "))
    valid = F.filter(ends, lambda e: e.rlike("^(?:" + PATTERNS["iban"] + ")$") & (_mod97(_turned(e)) == 1))
    size = lambda e: F.length(F.replace(e, F.lit(" "), F.lit("")))
    table = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for c in codes for x in (c, n)])
    usual = lambda e: size(e) == F.coalesce(F.try_element_at(table, F.substring(e, 1, 2)), F.lit(0))
    return let(valid, lambda v: F.coalesce(F.get(F.filter(v, usual), F.lit(0)), F.get(v, F.lit(0))))


def _found(m: Column) -> Column:
    """The value at the start of a match, with its kind; of no valid value: the match itself and a null kind."""
    iban = F.when(m.rlike("^(?:" + PATTERNS["iban"] + ")$"), _iban_within(m))
    return let(iban, lambda v: F.struct(F.when(v.isNotNull(), F.lit("iban")).otherwise(kind_of(m)).alias("kind"),
                                        F.coalesce(v, m).alias("m")))


def _walked(t: Column) -> Column:
    """All values of a text in turn, each with the text before it; the last has only text.

    The text is cut before every place where some pattern matches, and each place's match is
    checked once. Then one fold from left to right takes a valid value unless it starts inside
    the last one taken. A match without a valid value takes no text, so what it ran into is
    tried at its own place. The fold goes by blocks of about the root of the number of places.
    """
    hit = "array<struct<p:string,kind:string,m:string>>"
    own = F.concat(F.lit("\n"), t)  # so that the first cut always has text before it
    place = F.struct(F.lit(0).alias("cover"), F.lit("").alias("p"), F.array().cast(hit).alias("out"))

    def step(s: Column, c: Column) -> Column:
        taken = (s["cover"] <= 0) & c["kind"].isNotNull()
        new = F.struct(s["p"].alias("p"), F.when(taken, c["kind"]).alias("kind"),
                       F.when(taken, c["m"]).otherwise(F.lit("")).alias("m"))
        cover = F.when(taken, F.length(c["m"])).otherwise(F.greatest(s["cover"], F.lit(0)))
        return let(cover, lambda n: F.struct((n - F.length(c["piece"])).alias("cover"),
                                             F.substring(c["piece"], n + 1, F.length(c["piece"])).alias("p"),
                                             F.concat(s["out"], F.array(new)).alias("out")))

    def folded(pieces: Column, found: Column) -> Column:
        places = F.zip_with(F.slice(pieces, F.lit(2), F.size(found)), found, lambda x, h: F.struct(
            x.alias("piece"), h["kind"].alias("kind"), h["m"].alias("m")))
        width = F.ceil(F.sqrt(F.size(found))).cast("int")
        first = F.substring(F.get(pieces, F.lit(0)), F.lit(2), F.length(own))
        start = F.struct(F.lit(0).alias("cover"), first.alias("p"), F.array().cast(f"array<{hit}>").alias("out"))

        def block(all_places: Column, n: Column) -> Callable[[Column, Column], Column]:
            def run(s: Column, i: Column) -> Column:
                state = F.struct(s["cover"].alias("cover"), s["p"].alias("p"), place["out"].alias("out"))
                inner = F.aggregate(F.slice(all_places, i * n + 1, n), state, step)
                return let(inner, lambda r: F.struct(r["cover"].alias("cover"), r["p"].alias("p"),
                                                     F.concat(s["out"], F.array(r["out"])).alias("out")))
            return run

        def end(s: Column) -> Column:
            return F.concat(F.flatten(s["out"]), F.array(F.struct(
                s["p"].alias("p"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("m"))))

        return let(places, lambda ps: let(width, lambda n: F.aggregate(
            F.sequence(F.lit(0), n - 1), start, block(ps, n), end)))

    matches = F.regexp_extract_all(own, F.lit(HERE), F.lit(1))
    return let(F.split(own, HERE, -1), lambda pieces: let(F.transform(matches, _found), lambda found: folded(pieces, found)))


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    payload = _permuted_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
    whole = let(payload, lambda p: F.concat(p, F.pmod(-_luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
    return _refill(m, whole)


def _iban(key: str, m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    new = _refill(rest, _permuted_digits(key, "iban", _digits(rest)))
    check = lambda r: F.lpad((F.lit(98) - _mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
    return let(new, lambda r: _refill(m, _digits(F.concat(check(r), r))))


def _ssn(key: str, m: Column) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    a = area - F.when(area > 666, 2).otherwise(1)
    b = (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return let(_feistel(key, "ssn", a, b, F.lit(898), F.lit(99 * 9999)), lambda s: F.concat_ws(
        "-", pad(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3),
        pad(F.floor(s["b"] / 9999) + 1, 2), pad(F.pmod(s["b"], F.lit(9999)) + 1, 4)))


def _ip(key: str, m: Column) -> Column:
    o = F.split(m, r"\.")
    at = lambda i: F.element_at(o, i).cast("int")
    byte = lambda c: c.cast("long").cast("string")
    halves = _feistel(key, "ip", at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536))
    return let(halves, lambda s: F.concat_ws(".", byte(F.floor(s["a"] / 256)), byte(s["a"] % 256),
                                             byte(F.floor(s["b"] / 256)), byte(s["b"] % 256)))


def _date(key: str, m: Column) -> Column:
    def written(s: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int"))
        form = (F.when(m.rlike(r"^\d{4}"), F.date_format(day, "yyyyMMdd"))
                .when(m.rlike("^../"), F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy")))
        return _refill(m, form)
    halves = let(_day(m), lambda d: _feistel(key, "date", F.floor(d / DAYS[1]), d % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1])))
    return let(halves, written)


def _phone(key: str, m: Column) -> Column:
    """All digits behind the country code are permuted, however they are grouped."""
    def written(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(d, CALLING_CODE, 0)).otherwise(F.lit(""))
        return let(code, lambda c: _refill(m, F.concat(
            c, _permuted_digits(key, "phone", F.substring(d, F.length(c) + 1, F.length(d))))))
    return let(_digits(m), written)


def _email(key: str, m: Column) -> Column:
    """The part before the @ as two halves of characters; rounds shift one by a hash of the other."""
    at = F.instr(m, "@")
    local = F.substring(m, F.lit(1), at - 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def shifted(text: Column, by: Column) -> Column:
        def moved(c: Column, i: Column) -> Column:
            k = F.conv(F.substring(by, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda first, n: F.char(F.pmod(F.ascii(c) - first + k, F.lit(n)) + first)
            ascii_only = (F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26))
                          .when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c))
            other = c
            for letters in ALPHABETS:
                at = F.instr(F.lit(letters), c)
                other = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + k, F.lit(len(letters))) + 1, F.lit(1))
                               ).otherwise(other)
            return F.when(c.rlike("[^\\x00-\\x7F]"), other).otherwise(ascii_only)
        return F.array_join(F.transform(_chars(text), moved), "")

    def turn(s: Column, i: Column) -> Column:
        seed = lambda x: F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), i.cast("string"), x, F.lit(key)), 256)
        return (F.when(i % 2 == 0, F.struct(let(seed(s["b"]), lambda h: shifted(s["a"], h)).alias("a"), s["b"].alias("b")))
                .otherwise(F.struct(s["a"].alias("a"), let(seed(s["a"]), lambda h: shifted(s["b"], h)).alias("b"))))

    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return let(mixed, lambda s: F.concat(s["a"], s["b"], F.substring(m, at, F.length(m))))


MAKERS = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "iban": _iban, "card": _card, "phone": _phone}


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    """The pseudonym of a valid value; of no kind: the match itself."""
    out = m
    for name, make in MAKERS.items():
        out = F.when(kind == name, make(key, m)).otherwise(out)
    return out


def _hits(text: Column) -> Column:
    """All values of a text in turn, as ``_walked`` gives them; empty without a match."""
    hit = "array<struct<p:string,kind:string,m:string>>"

    def chosen(t: Column, ms: Column, found: Column) -> Column:
        plain = F.zip_with(F.split(t, ANY, -1), found, lambda p, h: F.struct(
            p.alias("p"), h["kind"].alias("kind"), F.coalesce(h["m"], F.lit("")).alias("m")))
        # a failed match may hide other values, but for a run of digits
        hidden = F.exists(F.zip_with(ms, found, lambda m, h: (h["m"] != m) | (h["kind"].isNull() & ~m.rlike(r"^\d+$"))), lambda x: x)
        return F.when(F.size(ms) == 0, F.array().cast(hit)).when(hidden, _walked(t)).otherwise(plain)

    def matched(t: Column) -> Column:
        ms = F.when(t.rlike(r"[\d@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
        return let(F.coalesce(ms, F.array().cast("array<string>")),
                   lambda ms: let(F.transform(ms, _found), lambda found: chosen(t, ms, found)))

    return let(text, matched)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and n_<kind> counts of the values replaced.

    An input column that is itself called n_<kind> is overwritten; all others are kept.
    """
    found = unused(docs, "hits")
    joined = F.array_join(F.transform(F.col(found), lambda h: F.concat(h["p"], pseudonym(key, h["kind"], h["m"]))), "")
    any_valid = F.exists(F.col(found), lambda h: h["kind"].isNotNull())
    kinds = F.col(found)["kind"]
    counts = {f"n_{k}": F.size(kinds) - F.size(F.array_remove(F.transform(kinds, lambda x: F.coalesce(x, F.lit(""))), k))
              for k in KINDS}
    return (docs.withColumn(found, _hits(F.col(text)))
            .withColumn(text, F.when(any_valid, joined).otherwise(F.col(text)))
            .withColumns(counts).drop(found))
