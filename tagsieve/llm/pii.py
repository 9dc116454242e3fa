"""Format-preserving pseudonyms from a keyed Feistel network.

Validated personal values in texts are replaced by a keyed permutation of themselves within
their own format: digits stay digits, letters letters (case kept), separators stay, check
digits fit, dates are real days. Equal values get equal pseudonyms in every document, different
values of a kind and length get different ones.

Kinds, and what makes a match valid:

* email: local part, @, host with a top level domain; the local part is permuted;
* iban: two letters and two check digits, 15 to 34 characters, remainder 1 modulo 97; the
  account part is permuted and the check digits are set anew;
* card: 13 to 19 digits, plain or grouped by single spaces or hyphens, Luhn sum right; all
  digits but the last are permuted, the last is set anew;
* ssn: ddd-dd-dddd, area 001 to 899 but not 666, group and serial not zero;
* phone: + and 8 to 15 digits, or ten digits as (ddd) ddd-dddd or ddd-ddd-dddd, with dots or spaces
  too, or in one where a word like phone or call precedes; the country code stays where separated;
* ip: four octets of 0 to 255, written without leading zeros;
* date: yyyy-MM-dd, also before a time or in a range, dd.MM.yyyy, yyyy/MM/dd or dd/MM/yyyy, a real day of
  the years 1800 to 2199; MM/dd/yyyy where the day is over 12, and such days are permuted among themselves
  (so they are not linked with the same day in other layouts);
* secret: 16 to 64 hex digits assigned to a name like token, key, secret or password.

What fails validation stays as it is. Every place where a value may begin is tried, kind by kind in
the order email and secret, iban, ip, date and ssn, phone with +, card, phone; of the readings that begin there the first
valid one counts: the length of the country's accounts or phones, usual groups of a card, then the longest.
Numbers beside a value, such as an expiry date or a currency, neither hide it nor join it. A value is read as a string of symbols with a
radix each; its halves are two integers below a and b, and ten rounds add a keyed SHA-256 of
one half to the other modulo a or b in turn, which is a permutation of the a * b values. Days
are permuted within a 400-year cycle of 146097 = 189 * 773 days. Long values are cut into
blocks whose halves fit 62 bits.

Everything is a column expression on one row: no shuffle, no Python.

Defined cases: a null text stays null, an empty one empty; texts without a digit or @ are not
searched; rows are independent, so repeated rows repeat; an empty table gives no rows; extra
columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsieve.llm.common import let

#: Two passes over each half would do; ten resist known attacks on small domains better.
ROUNDS = 10
#: Symbols in a block: halves of at most 15 hex digits, 12 letters or digits of radix 26.
BLOCK = 24

#: Where a value of a kind may begin, with all that it may take and what follows.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}+"
IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
#: A day may be followed by a time, or by the other end of a range.
ISO = r"(?:(?<![\w.\-/])|(?<=[0-9Z]/))[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]|(?!\w|-))"
DATE = (
    ISO + r"|(?<![\w.\-/])(?:[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![\w\-/])"
)
SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
SECRET = r"""(?i:token|secret|password|passwd|api[_\-]?key|key)\s{0,3}+[=:]\s{0,3}+["']?+[0-9a-fA-F]{16,64}+(?![0-9A-Za-z])"""
IBAN = r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}.{0,45}"
CARD = r"(?:(?<![\w\-])|(?<=[0-9]-))[0-9](?:[ \-]?[0-9]){12}.{0,26}"
PLUS_PHONE = r"(?<![\w+])\+[0-9](?:[ .()\-]{0,3}[0-9]){5}.{0,40}"
#: Ten digits in one are a phone only where they are called one; ids and times look alike.
CALLED = r"(?<=(?i:phone|mobile|cell|call|tel|fax)[a-z]{0,4}[^0-9A-Za-z]{0,4}(?:is |me at |at |no[.:]? |number:? |us at )?)"
PHONE = rf"(?<![\w+])(?:\(?[0-9]{{3}}[) .\-].{{8,14}}|(?=[0-9]{{10}}(?![0-9])){CALLED}[0-9]{{10}}.{{0,2}})"
#: No value begins inside a word.
OUTSIDE = "(?<![A-Za-z0-9])"
#: A number may be followed by another one after a hyphen, but by no word.
END = r"(?!\w|-(?![0-9]))"

#: Cards in their usual groups, longest first, then in any groups.
CARD_GROUPS = (
    *(rf"[0-9]{{4}}([ \-])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{{n}}}" for n in (3, 2, 1)),
    *(rf"[0-9]{{{n}}}" for n in (19, 18, 17, 16)),
    *(rf"[0-9]{{4}}([ \-])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{{n}}}" for n in (4, 3, 2, 1)),
    *(rf"[0-9]{{4}}([ \-])[0-9]{{6}}\2[0-9]{{{n}}}" for n in (5, 4)),
    *(rf"[0-9]{{{n}}}" for n in (15, 14, 13)),
)
CARD_ANY = tuple(rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1))

#: Characters of an account number by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern(size: int, countries: str = "[A-Z]{2}") -> str:
    fours, rest = divmod(size - 4, 4)
    return rf"{countries}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: The country's own length, then any other, longest first.
IBANS = (
    "(?:" + "|".join(_iban_pattern(n, f"(?:{c.replace(' ', '|')})") + r"\b" for n, c in IBAN_SIZES.items()) + ")",
    *(_iban_pattern(n) for n in range(34, 14, -1)),
)

#: Digits after the country code where a country has one length only.
PLANS = {1: 10, 7: 10, 33: 9, 34: 9, 41: 9, 45: 8, 47: 8, 48: 9, 52: 10, 91: 10, 351: 9}
PLUS_PHONES = (
    "(?:"
    + "|".join(rf"\+{c}[ .\-]?\(?[0-9](?:\)?[ .\-]?\(?[0-9]){{{n - 1}}}{END}" for c, n in PLANS.items())
    + ")",
    *(
        rf"\+[0-9]{{1,3}}[ .\-]?(?:\([0-9]{{1,4}}\)[ .\-]?)?[0-9]{{2,4}}(?:[ .\-]?[0-9]{{2,4}}){{{n}}}"
        for n in (4, 3, 2, 1)
    ),
)
PHONES = (
    r"\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}",
    r"[0-9]{3}([ .\-])[0-9]{3}\2[0-9]{4}",
    r"[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}",
    r"[0-9]{10}",
)

LETTERS = "abcdefghijklmnopqrstuvwxyz"
CYCLE = (189, 773)
FIRST_DAY = "1800-01-01"


def _round(key: str, tweak: Column, step: Column, half: Column) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", F.lit(key), tweak, step.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the permuted pair; 0 <= left < a, 0 <= right < b, a and b below 2^62."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.when(
            i % 2 == 0, F.struct(((s["l"] + _round(key, tweak, i, s["r"]) % a) % a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _round(key, tweak, i, s["l"]) % b) % b).alias("r"))),
    )


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _radix(c: Column, digits: int) -> Column:
    """The number of symbols that may stand in place of c; 1 where c stays. digits: 10 or 16."""
    if digits == 16:
        return F.when(c.rlike("[0-9a-fA-F]"), 16).otherwise(1).cast("long")
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")


def _symbol(c: Column, digits: int) -> Column:
    if digits == 16:
        return F.when(c.rlike("[0-9a-fA-F]"), F.conv(c, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    return (
        F.when(c.rlike("[0-9]"), F.conv(c, 10, 10).cast("long"))
        .when(c.rlike("[A-Za-z]"), (F.ascii(F.lower(c)) - 97).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )


def _written(c: Column, value: Column, digits: int) -> Column:
    """The symbol of this value, in the case of c; c itself where it stays."""
    upper = c.rlike("[A-Z]")
    if digits == 16:
        lower = F.lower(F.conv(value.cast("string"), 10, 16))
        # the case of one hex letter tells nothing of its neighbours that are digits
        return F.when(c.rlike("[0-9a-fA-F]"), lower).otherwise(c)
    letter = F.substr(F.lit(LETTERS), (value + 1).cast("int"), F.lit(1))
    return (
        F.when(c.rlike("[0-9]"), value.cast("string"))
        .when(c.rlike("[A-Za-z]"), F.when(upper, F.upper(letter)).otherwise(letter))
        .otherwise(c)
    )


def _number(chars: Column, digits: int) -> Column:
    return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * _radix(c, digits) + _symbol(c, digits))


def _size(chars: Column, digits: int) -> Column:
    return F.aggregate(chars, F.lit(1).cast("long"), lambda n, c: n * _radix(c, digits))


def _spelled(chars: Column, value: Column, digits: int) -> Column:
    """The text of a mixed-radix value in the format of chars."""
    out = F.aggregate(
        F.reverse(chars),
        F.struct(value.alias("n"), F.lit("").alias("t")),
        lambda s, c: F.struct(
            F.call_function("div", s["n"], _radix(c, digits)).alias("n"),
            F.concat(_written(c, s["n"] % _radix(c, digits), digits), s["t"]).alias("t"),
        ),
    )
    return out["t"]


def permuted(key: str, tweak: Column, text: Column, digits: int = 10) -> Column:
    """text with its letters and digits permuted in place, block by block. The block's format
    and number are part of the tweak, so the map is a permutation of each format."""

    def block(chars: Column, number: Column) -> Column:
        half = (F.size(chars) / 2).cast("int")
        return let(
            F.struct(
                F.slice(chars, F.lit(1), half).alias("l"),
                F.slice(chars, half + 1, F.size(chars) - half).alias("r"),
                F.concat_ws(":", tweak, number.cast("string"), F.size(chars).cast("string")).alias("tweak"),
            ),
            lambda x: let(
                feistel(
                    key, x["tweak"], _number(x["l"], digits), _number(x["r"], digits),
                    _size(x["l"], digits), _size(x["r"], digits),
                ),
                lambda y: F.concat(_spelled(x["l"], y["l"], digits), _spelled(x["r"], y["r"], digits)),
            ),
        )

    chars = _chars(text)
    return let(
        chars,
        lambda all_chars: F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(all_chars) - 1, F.lit(0)), F.lit(BLOCK)),
                lambda at: block(F.slice(all_chars, at + 1, F.lit(BLOCK)), at),
            ),
            "",
        ),
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit as check digit."""
    return F.aggregate(
        F.transform(
            F.reverse(_chars(digits)),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _refilled(shape: Column, digits: Column) -> Column:
    """digits put in the places of the digits of shape."""
    out = F.aggregate(
        _chars(shape),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("t")),
        lambda s, c: F.when(
            c.rlike("[0-9]"),
            F.struct((s["at"] + 1).alias("at"), F.concat(s["t"], F.substr(digits, s["at"], F.lit(1))).alias("t")),
        ).otherwise(F.struct(s["at"].alias("at"), F.concat(s["t"], c).alias("t"))),
    )
    return out["t"]


def _card(key: str, m: Column) -> Column:
    def renewed(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        return let(
            permuted(key, F.lit("card"), head),
            lambda h: F.concat(h, ((10 - _luhn_sum(F.concat(h, F.lit("0"))) % 10) % 10).cast("string")),
        )

    return let(_digits(m), lambda d: F.when(_luhn_sum(d) % 10 == 0, _refilled(m, renewed(d))).otherwise(m))


def _mod97(text: Column) -> Column:
    """Remainder modulo 97 of letters (10 to 35) and digits."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.conv(c, 10, 10).cast("int")) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )


def _iban_valid(m: Column) -> Column:
    return let(
        F.replace(m, F.lit(" "), F.lit("")),
        lambda p: _mod97(F.concat(F.substr(p, F.lit(5), F.length(p)), F.substr(p, F.lit(1), F.lit(4)))) == 1,
    )


def _iban(key: str, m: Column) -> Column:
    def renewed(plain: Column) -> Column:
        country = F.substr(plain, F.lit(1), F.lit(2))
        return let(
            permuted(key, F.lit("iban"), F.substr(plain, F.lit(5), F.length(plain))),
            lambda rest: F.concat(
                country,
                F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"),
                rest,
            ),
        )

    def spaced(new: Column) -> Column:
        """new with the spaces of m."""
        out = F.aggregate(
            _chars(m),
            F.struct(F.lit(1).alias("at"), F.lit("").alias("t")),
            lambda s, c: F.when(c == " ", F.struct(s["at"].alias("at"), F.concat(s["t"], c).alias("t"))).otherwise(
                F.struct((s["at"] + 1).alias("at"), F.concat(s["t"], F.substr(new, s["at"], F.lit(1))).alias("t"))
            ),
        )
        return out["t"]

    def checked(plain: Column) -> Column:
        turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
        valid = (F.length(plain) >= 15) & (F.length(plain) <= 34) & (_mod97(turned) == 1)
        return F.when(valid, spaced(renewed(plain))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), checked)


def _ssn(key: str, m: Column) -> Column:
    """898 areas * 99 groups and 9999 serials."""
    area, group = F.substr(m, F.lit(1), F.lit(3)).cast("long"), F.substr(m, F.lit(5), F.lit(2)).cast("long")
    serial = F.substr(m, F.lit(8), F.lit(4)).cast("long")
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def written(x: Column) -> Column:
        at = F.call_function("div", x["l"], F.lit(99).cast("long"))
        return F.format_string("%03d-%02d-%04d", at + 1 + F.when(at >= 665, 1).otherwise(0), x["l"] % 99 + 1, x["r"] + 1)

    sizes = F.lit(898 * 99).cast("long"), F.lit(9999).cast("long")
    pair = feistel(key, F.lit("ssn"), place * 99 + group - 1, serial - 1, *sizes)
    return F.when(valid, let(pair, written)).otherwise(m)


def _phone_valid(m: Column) -> Column:
    digits = F.length(_digits(m))
    return F.when(m.startswith("+"), (digits >= 8) & (digits <= 15)).otherwise(digits == 10)


def _phone(key: str, m: Column) -> Column:
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?![0-9])|\+|)", 1)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    new = let(_digits(rest), lambda d: _refilled(rest, permuted(key, F.lit("phone"), d)))
    return F.when(_phone_valid(m), F.concat(head, new)).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    valid = m.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}")

    def written(x: Column) -> Column:
        parts = [F.shiftright(x[s], n).bitwiseAND(F.lit(255)).cast("string") for s in ("l", "r") for n in (8, 0)]
        return F.concat_ws(".", *parts)

    def pair(o: Column) -> Column:
        octet = [F.get(o, F.lit(i)).cast("long") for i in range(4)]
        size = F.lit(1 << 16).cast("long")
        return let(feistel(key, F.lit("ip"), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size), written)

    return F.when(valid, let(F.split(m, r"\."), pair)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    a, b = CYCLE
    size = F.lit(a).cast("long"), F.lit(b).cast("long")

    def days(form: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        return F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")

    def moved(n: Column) -> Column:
        pair = feistel(key, F.lit("date"), F.call_function("div", n, size[1]), n % b, *size)
        return let(pair, lambda x: x["l"] * b + x["r"])

    def day(n: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def walked(n: Column) -> Column:
        """n moved until its day is over 12 again, so that the result has one reading, too."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            F.struct(n.alias("n"), F.lit(False).alias("done")),
            lambda s, i: F.when(s["done"], s).otherwise(
                let(moved(s["n"]), lambda k: F.struct(k.alias("n"), (F.dayofmonth(day(k)) > 12).alias("done")))
            ),
        )["n"]

    def written(form: str, change: Callable[[Column], Column]) -> Column:
        return let(
            days(form),
            lambda n: F.when((n >= 0) & (n < a * b), F.date_format(day(change(n)), form)),
        )

    def slashed() -> Column:
        return F.coalesce(written("dd/MM/yyyy", moved), written("MM/dd/yyyy", walked), m)

    return (
        F.when(m.contains("-"), F.coalesce(written("yyyy-MM-dd", moved), m))
        .when(m.contains("."), F.coalesce(written("dd.MM.yyyy", moved), m))
        .when(m.rlike("^[0-9]{4}/"), F.coalesce(written("yyyy/MM/dd", moved), m))
        .otherwise(slashed())
    )


#: Moves in search of a day over 12; three of five moves find one, so all have failed with a chance below 1e-25.
WALK = 64


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    local = F.substr(m, F.lit(1), at - 1)
    return F.concat(permuted(key, F.lit("email"), local), F.substr(m, at, F.length(m)))


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, "([0-9a-fA-F]{16,64})$", 1)
    upper = value.rlike("[A-F]") & ~value.rlike("[a-f]")
    new = permuted(key, F.lit("secret"), value, 16)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.when(upper, F.upper(new)).otherwise(new))


SEGMENTS = "array<struct<kind:string,old:string,text:string>>"


def _value(kind: str, old: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), old.alias("old"), text.alias("text"))


def _free(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), text.alias("old"), text.alias("text"))


def _first(m: Column, patterns: tuple[str, ...], valid: Callable[[Column], Column]) -> Column:
    """The first of the patterns' readings of the beginning of m that is valid; null where none is."""
    readings = F.array(*[F.regexp_extract(m, f"^({p}){END}", 1) for p in patterns])
    return F.get(F.filter(readings, lambda o: (o != "") & valid(o)), F.lit(0))


def _read(kind: str, m: Column, patterns: tuple[str, ...], valid: Callable, renew: Callable) -> Column:
    return let(_first(m, patterns, valid), lambda o: F.when(o.isNotNull(), _value(kind, o, renew(o))))


def _named(key: str, m: Column) -> Column:
    return F.when(m.contains("@"), _value("email", m, _email(key, m))).otherwise(_value("secret", m, _secret(key, m)))


def _dated(key: str, m: Column) -> Column:
    """An address, a day or a number of three groups; null where validation fails."""
    renewed = (
        F.when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), _value("ip", m, _ip(key, m)))
        .when(m.rlike("^[0-9]{3}-"), _value("ssn", m, _ssn(key, m)))
        .otherwise(_value("date", m, _date(key, m)))
    )
    return let(renewed, lambda v: F.when(v["text"] != m, v))


def _card_valid(o: Column) -> Column:
    return _luhn_sum(_digits(o)) % 10 == 0


def _passes(key: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """Where values may begin, and the value that begins there, kind by kind."""
    return [
        (f"{OUTSIDE}(?:{EMAIL}|{SECRET})", lambda m: _named(key, m)),
        (f"{OUTSIDE}{IBAN}", lambda m: _read("iban", m, IBANS[:1], _iban_valid, lambda o: _iban(key, o))),
        (f"{OUTSIDE}{IBAN}", lambda m: _read("iban", m, IBANS[1:], _iban_valid, lambda o: _iban(key, o))),
        (f"{OUTSIDE}(?:{IP}|{DATE}|{SSN})", lambda m: _dated(key, m)),
        (f"{OUTSIDE}{PLUS_PHONE}", lambda m: _read("phone", m, PLUS_PHONES, _phone_valid, lambda o: _phone(key, o))),
        (f"{OUTSIDE}{CARD}", lambda m: _read("card", m, CARD_GROUPS, _card_valid, lambda o: _card(key, o))),
        (f"{OUTSIDE}{CARD}", lambda m: _read("card", m, CARD_ANY, _card_valid, lambda o: _card(key, o))),
        (f"{OUTSIDE}{PHONE}", lambda m: _read("phone", m, PHONES, _phone_valid, lambda o: _phone(key, o))),
    ]


def _searched(x: Column, pattern: str, value: Callable[[Column], Column]) -> Column:
    """x in segments: values and the free text around them. Every place where the pattern fits is
    tried, so what fails hides nothing; of overlapping values the first stays."""

    def cut(c: Column) -> Column:
        tried = F.transform(
            c["found"], lambda m, i: F.struct(value(m).alias("v"), F.length(F.get(c["pieces"], i + 1)).alias("n"))
        )

        def step(s: Column, t: Column) -> Column:
            take = t["v"]["kind"].isNotNull() & (s["at"] >= s["free"])
            one = F.struct(s["at"].alias("at"), t["v"].alias("v"))
            return F.struct(
                F.when(take, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"),
                (s["at"] + t["n"]).alias("at"),
                F.when(take, s["at"] + F.length(t["v"]["old"])).otherwise(s["free"]).alias("free"),
            )

        start = F.struct(
            F.expr(f"cast(array() as array<struct<at:int,v:{SEGMENTS[6:-1]}>>)").alias("out"),
            # the line break before x is not counted
            (F.length(F.get(c["pieces"], F.lit(0))) - 1).alias("at"),
            F.lit(0).alias("free"),
        )
        return let(F.aggregate(tried, start, step)["out"], segments)

    def segments(out: Column) -> Column:
        def end(i: Column) -> Column:
            return F.when(i < 0, F.lit(0)).otherwise(
                let(F.get(out, F.greatest(i, F.lit(0))), lambda o: o["at"] + F.length(o["v"]["old"]))
            )

        pairs = F.transform(
            out,
            lambda o, i: let(
                end(i - 1), lambda e: F.array(_free(F.substr(x, e + 1, o["at"] - e)), o["v"])
            ),
        )
        rest = let(end(F.size(out) - 1), lambda e: F.array(_free(F.substr(x, e + 1, F.length(x)))))
        return F.when(F.size(out) == 0, F.array(_free(x))).otherwise(F.concat(F.flatten(pairs), rest))

    # a match at the very beginning would leave no piece before it
    y = F.concat(F.lit("\n"), x)
    return let(
        F.regexp_extract_all(y, F.lit(f"(?=({pattern}))"), 1),
        lambda found: F.when(F.size(found) == 0, F.array(_free(x))).otherwise(
            let(F.struct(found.alias("found"), F.split(y, f"(?={pattern})", -1).alias("pieces")), cut)
        ),
    )


def _cutter(pattern: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """What cuts the free ones among segments."""
    return lambda s: F.when(
        s["kind"].isNull() & s["old"].rlike("[0-9@]"), _searched(s["old"], pattern, value)
    ).otherwise(F.array(s))


def pseudonymise(df: DataFrame, text: str, key: str, kinds: str | None = None) -> DataFrame:
    """df with personal values in the text column replaced. kinds names a new column with the
    kinds of the replaced values, in order of place."""
    marked = f"__llm_{text}"
    out = df.withColumn(marked, F.array(_free(F.col(text))).cast(SEGMENTS))
    for pattern, value in _passes(key):
        out = out.withColumn(marked, F.flatten(F.transform(F.col(marked), _cutter(pattern, value))))
    joined = F.when(F.col(text).isNotNull(), F.array_join(F.transform(F.col(marked), lambda s: s["text"]), ""))
    out = out.withColumn(text, joined)
    if kinds:
        changed = F.filter(F.col(marked), lambda s: s["kind"].isNotNull() & (s["text"] != s["old"]))
        out = out.withColumn(kinds, F.transform(changed, lambda s: s["kind"]))
    return out.drop(marked).select(*df.columns, *([kinds] if kinds else []))
