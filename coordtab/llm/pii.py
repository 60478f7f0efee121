"""Format-preserving pseudonyms for personal data.

Validated values (numbers by check digits or ranges, dates by the calendar) are permuted within their own format by a keyed
Feistel network: the result is again a valid value of the format, whoever has the key can take it back, and equal values
get equal pseudonyms in every document. All of it are SQL expressions: a regular expression cuts the text into what it
finds and what stands between, the finds are replaced, and the parts are joined again.

A network on a string of one alphabet splits it in two and ROUNDS times adds, character by character modulo the size of
the alphabet, a keyed SHA-256 of one part to the other. Dates are permuted as day numbers, walking along the cycle until
the number falls into the range. Values may have any length; the time is in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

ROUNDS = 8
DIGITS = "0123456789"
HEX = "0123456789abcdef"
UPPER_HEX = "0123456789ABCDEF"
MIXED_HEX = "0123456789abcdefABCDEF"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Days from FIRST_DAY that dates are permuted among: 1900 to 2099.
FIRST_DAY, DAYS = "1900-01-01", 73_049
#: A walk takes WALK * WALK steps at most. Of the formats here 0.36 of the numbers are inside at least, so that one in 10**198
#: values is left outside.
WALK = 32

#: What is looked for, in order of preference where finds start at one place. Possessive quantifiers and look-behinds keep
#: the search linear on long runs.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{18,}+(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){11,18}(?![\d])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def index_in(alphabet: str, char: Column) -> Column:
    """0-based place of a character, -1 if it isn't in the alphabet."""
    return F.instr(F.lit(alphabet), char) - 1


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def added(part: Column, other: Column, key: Column, tweak: Column, turn: Column, alphabet: str, sign: int) -> Column:
    """part plus (or minus) a keyed hash of other, character by character. A SHA-256 gives 32 characters' worth; longer
    parts take more, with a running number in what is hashed."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(part) - 1) / 32).cast("int"))
    seeds = F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", key, tweak, turn.cast("string"), F.length(part).cast("string"), b.cast("string"), other), 256))
    noise = F.flatten(F.transform(seeds, lambda s: F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda k: F.conv(F.substr(s, k, F.lit(2)), 16, 10).cast("int"))))
    moved = lambda c, x: F.substr(F.lit(alphabet), F.pmod(index_in(alphabet, c) + F.lit(sign) * x, F.lit(len(alphabet))) + 1, F.lit(1))
    return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.zip_with(characters(part), F.slice(noise, F.lit(1), F.length(part)), moved), ""))


def feistel(value: Column, tweak: Column, key: Column, alphabet: str, forward: bool = True) -> Column:
    """A permutation of the strings over the alphabet that have value's length."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    if forward:
        turns = F.sequence(F.lit(1), F.lit(ROUNDS))
        step = lambda s, k: F.struct(s["r"].alias("l"), added(s["l"], s["r"], key, tweak, k, alphabet, 1).alias("r"))
    else:
        turns = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
        step = lambda s, k: F.struct(added(s["r"], s["l"], key, tweak, k, alphabet, -1).alias("l"), s["l"].alias("r"))
    return F.aggregate(turns, start, step, lambda s: F.concat(s["l"], s["r"]))


def walked(value: Column, permuted, inside) -> Column:
    """Applies a permutation until the value is inside again (it was at first): a permutation of the inner values."""
    turns = F.sequence(F.lit(1), F.lit(WALK))
    walk = lambda v, first: F.aggregate(turns, v, lambda x, k: F.when(((k > 1) | ~first) & inside(x), x).otherwise(permuted(x)))
    return F.aggregate(turns, value, lambda v, j: F.when((j > 1) & inside(v), v).otherwise(walk(v, j == 1)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def filled(shape: Column, chars: Column, alphabet: str) -> Column:
    """shape with its characters of the alphabet replaced, one by one, by chars."""
    between = F.split(shape, f"[{alphabet}]", -1)
    return F.array_join(F.zip_with(between, characters(chars), lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), "")


def luhn(digits: Column, offset: int) -> Column:
    """Luhn sum; from the right every second digit is doubled, from the first on if offset is 1."""
    back = F.reverse(digits)

    def term(k):
        x = F.substr(back, k, F.lit(1)).cast("int")
        y = F.when((k + offset) % 2 == 0, 2 * x).otherwise(x)
        return F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, k: s + term(k))


def card(value: Column, key: Column, forward: bool) -> Column:
    d = digits_of(value)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    new = feistel(body, F.lit("card"), key, DIGITS, forward)
    check = F.pmod(10 - luhn(new, 1) % 10, F.lit(10)).cast("string")
    return F.when(luhn(d, 0) % 10 == 0, filled(value, F.concat(new, check), DIGITS))


def phone(value: Column, key: Column, forward: bool) -> Column:
    code = F.regexp_extract(value, r"^\+(\d{1,3}?)(?:[ .(-]|(?=\d{7,}))", 1)
    d = digits_of(value)
    rest = F.substr(d, F.length(code) + 1)
    american = lambda v: (F.length(v) == 10) & F.substr(v, F.lit(1), F.lit(1)).between("2", "9") & F.substr(v, F.lit(4), F.lit(1)).between("2", "9")
    new = walked(rest, lambda v: feistel(v, F.lit("phone"), key, DIGITS, forward), lambda v: american(v) == american(rest))
    return F.when(F.length(d).between(8, 15) & (F.length(rest) >= 6), filled(value, F.concat(code, new), DIGITS))


def ssn(value: Column, key: Column, forward: bool) -> Column:
    ok = lambda v: ~F.substr(v, F.lit(1), F.lit(3)).isin("000", "666") & (F.substr(v, F.lit(1), F.lit(1)) != "9") & (F.substr(v, F.lit(4), F.lit(2)) != "00") & (F.substr(v, F.lit(6)) != "0000")
    d = digits_of(value)
    return F.when(ok(d), filled(value, walked(d, lambda v: feistel(v, F.lit("ssn"), key, DIGITS, forward), ok), DIGITS))


def ip(value: Column, key: Column, forward: bool) -> Column:
    octets = F.split(value, r"\.")
    number = F.array_join(F.transform(octets, lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), "")
    new = feistel(number, F.lit("ip"), key, HEX, forward)
    dotted = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda k: F.conv(F.substr(new, k, F.lit(2)), 16, 10)), ".")
    return F.when(F.forall(octets, lambda x: (x.cast("int") <= 255) & ((x == "0") | ~x.startswith("0"))), dotted)


def date(value: Column, key: Column, forward: bool) -> Column:
    def among(pattern: str, also=lambda d: F.lit(True)):
        d = F.try_to_timestamp(value, F.lit(pattern)).cast("date")
        day = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        number = lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
        inside = lambda v: (v.cast("int") < DAYS) & also(number(v))
        new = walked(F.lpad(day.cast("string"), 5, "0"), lambda v: feistel(v, F.lit("date" + pattern), key, DIGITS, forward), inside)
        return F.when(d.isNotNull() & (day >= 0) & (day < DAYS) & also(d), F.date_format(number(new), pattern))

    return F.coalesce(
        F.when(value.rlike(r"^\d{4}-"), among("yyyy-MM-dd")),
        F.when(value.rlike(r"^\d\d\."), among("dd.MM.yyyy")),
        F.when(value.rlike(r"^\d\d/"), F.coalesce(among("dd/MM/yyyy"), among("MM/dd/yyyy", lambda d: F.dayofmonth(d) > 12))),
    )


def remainder_97(value: Column) -> Column:
    number = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, k: (s * 10 + F.substr(number, k, F.lit(1)).cast("int")) % 97)


def iban(value: Column, key: Column, forward: bool) -> Column:
    bare = F.regexp_replace(value, " ", "")
    country, rest = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))
    new = filled(rest, feistel(digits_of(rest), F.concat(F.lit("iban"), country), key, DIGITS, forward), DIGITS)
    check = F.lpad((98 - remainder_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = remainder_97(F.concat(rest, F.substr(bare, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, filled(value, F.concat(country, check, new), CAPITALS))


def email(value: Column, key: Column, forward: bool) -> Column:
    local = F.lower(F.substring_index(value, "@", 1))
    new = feistel(F.regexp_replace(local, "[^a-z0-9]", ""), F.lit("email"), key, LOWER, forward)
    return F.concat(filled(local, new, LOWER), F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: Column, forward: bool) -> Column:
    """Access keys keep their first four letters. Hexadecimal strings keep to lower, upper or mixed case and to have a letter."""
    named = F.concat(F.substr(value, F.lit(1), F.lit(4)), feistel(F.substr(value, F.lit(5)), F.lit("secret"), key, CAPITALS, forward))
    of = lambda alphabet, inside: walked(value, lambda v: feistel(v, F.lit("secret"), key, alphabet, forward), inside)
    lower, upper = lambda v: v.rlike("[a-f]"), lambda v: v.rlike("[A-F]")
    plain = F.when(lower(value) & upper(value), of(MIXED_HEX, lambda v: lower(v) & upper(v))).when(upper(value), of(UPPER_HEX, upper)).otherwise(of(HEX, lower))
    return F.when(value.rlike("^A[KS]IA"), named).otherwise(plain)


BY_KIND = {"email": email, "iban": iban, "secret": secret, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def marked(kind: str, value: Column):
    return lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, value).alias("value"))


def exchanged(value: Column, key: Column, forward: bool) -> Column:
    """struct<kind, value>: the pseudonym, or the value itself with a null kind if it isn't valid."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(KINDS):
        new = BY_KIND[kind](value, key, forward)
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.get(F.transform(F.array(new), marked(kind, value)), F.lit(0))).otherwise(out)
    return out


@store.keeps_columns
def pseudonymised(docs: DataFrame, key: str, text: str = "text", forward: bool = True) -> DataFrame:
    """docs with its text column pseudonymised (forward=False takes pseudonyms back), and _found, an array of
    struct<kind, value> of all that was looked at, in order of the text; kind is null where a check failed and nothing was
    changed. Who has the key can take pseudonyms back, so it has no default and is to be kept secret.

    A null text stays null and finds nothing. An empty text stays empty. Ids and repeated rows play no part: equal texts
    give equal results. Of finds that overlap the leftmost is taken, at one place the first kind of PATTERNS. Upper case
    in the local part of an address is lowered. An empty table stays empty; other columns pass through."""
    k = F.lit(key)
    t = F.col(text)
    some = t.rlike("[0-9@]|AKIA|ASIA|[A-Fa-f]{18}")  # a text without these has nothing that ANY finds
    found = docs.withColumn("_finds", F.when(some, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    many = F.size(F.coalesce("_finds", F.array().cast("array<string>"))) > 0
    new = found.withColumns({
        "_found": F.when(many, F.transform("_finds", lambda v: exchanged(v, k, forward))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        "_between": F.when(many, F.split(t, ANY, -1)),
    })
    joined = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_found")), lambda i: F.concat(F.get("_between", i), F.coalesce(F.get("_found", i)["value"], F.lit("")))), "")
    return new.withColumn(text, F.when(F.size("_found") > 0, joined).otherwise(t)).drop("_finds", "_between")
