"""Format-preserving pseudonyms for numbers and dates in texts, by keyed Feistel permutations.

Found and validated:

- payment card numbers: 13 to 16 digits with a valid Luhn digit, also in groups of 4-4-4-4 or 4-6-5 digits, which share
  the unbroken number's pseudonym;
- bank accounts: IBANs, unbroken or in groups of four, with valid check digits (letters of the account stay);
- national numbers ddd-dd-dddd (area not 000, 666 or 9xx, no group of zeros);
- telephone numbers: ten digits by the North American plan, unbroken (area and exchange from 200) or in groups, with an
  optional +1; international ones (+, a calling code, 4 to 14 digits in groups), whose calling code stays; and national
  ones of Europe: a leading 0 and 7 to 11 digits in groups, ten digits from 01 unbroken, nine digits from 6 to 9 in groups;
- IPv4 addresses (octets to 255), and IPv6 addresses of eight groups or with ::, whose pseudonyms have eight groups;
- dates, real days from 1901 to 2096: yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, and, where that is no day, dd/mm/yyyy.

Each value is an element of a product of two ranges of just its format's size, and a Feistel network with modular
addition (SHA-256 of key, kind, round and the other half) permutes that product: a value always gets the same pseudonym,
in every document, two values never share one, and punctuation, check digits and calendar stay valid. Formats of more
than 18 digits or 64 bits are permuted in two parts, each under the other as a tweak. dd/mm/yyyy permutes the days from
the 13th by walking the permutation of all days until it meets one, so it never yields what reads as mm/dd/yyyy. E-mail
addresses keep their shape with a keyed digest for the mailbox, under a reserved domain. What fails validation stays.

All of it is SQL within a row: one regex splits a text into matches and gaps. The key is a string or, so that it shows in
no plan or event log, a table of one row. Defined cases: a null text stays null, an empty one empty; very long texts are
handled whole; of overlapping formats (a tie) the one named first in ANY counts; repeated rows and null ids are as any
other; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV6 = r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:.])|(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![A-Za-z0-9:])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
OTHER_DATE = r"(?<![0-9/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9/]|\.[0-9])"
NATIONAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9.+])(?:[0-9]{13,16}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.])(?:\+?1)?[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9]|\.[0-9])"
ABROAD = r"(?<![0-9+])\+(?!1[ .\-(0-9])(?:[1-9][0-9]{7,14}|[1-9][0-9]{0,6}(?:[ .\-/]\(?[0-9]{1,8}\)?){1,6})(?![0-9])"
EUROPE = r"(?<![0-9+.,/\-])(?:0[1-9](?:[ .\-][0-9]{2}){4}|0[1-9][0-9]{8}|0[1-9][0-9]{1,4}[ /\-][0-9]{3,4}(?:[ \-]?[0-9]{2,4})?|[6-9][0-9]{2} [0-9]{3} [0-9]{3}|[6-9][0-9]{2}(?: [0-9]{2}){3})(?![0-9]|[.,/\-][0-9])"
ANY = "|".join((EMAIL, IBAN, IPV6, IPV4, DATE, OTHER_DATE, NATIONAL, CARD, PHONE, ABROAD, EUROPE))
KINDS = ["email", "card", "iban", "phone", "national", "ipv4", "ipv6", "date"]
#: The calling codes of one and of two digits; all others have three.
CALLING = "[17]|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Days from 1901-01-01 to 2096-12-31, as a product of two whole numbers: 147 * 487 = 71589.
DAYS = (147, 487)
FIRST_DAY = "1901-01-01"
#: Steps that a walk for a day from the 13th may take; each misses with a probability of 0.4.
WALK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once and standing once in the plan, however often body names it. A plain Column
    is copied at each use: values built upon one another made the plan 60,000 nodes, which every task read and kept."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(kind: str | Column, x: Column, y: Column, nx: Column, ny: Column, key: Column) -> Column:
    """A struct (x, y): the image of (x, y) under a permutation of [0, nx) x [0, ny)."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), nx.cast("long").alias("nx"), ny.cast("long").alias("ny"))
    name = kind if isinstance(kind, Column) else F.lit(kind)

    def step(own, s, r):
        f = F.conv(F.substring(F.sha2(F.concat_ws("|", own, r.cast("string"), s["nx"].cast("string"), s["ny"].cast("string"), s["y"].cast("string")), 256), 1, 13), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), ((s["x"] + f) % s["nx"]).alias("y"), s["ny"].alias("nx"), s["nx"].alias("ny"))

    return _let(F.concat_ws("|", key, name), lambda own: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, r: step(own, s, r)))


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _zeros(v: Column, n) -> Column:
    """v with leading zeros, n digits."""
    return F.lpad(v.cast("string"), n, "0") if isinstance(n, int) else F.lpad(v.cast("string"), n, F.lit("0"))


def _digits(kind: str | Column, d: Column, key: Column) -> Column:
    """Permutes a string of 2 to 18 digits among those of its length."""

    def moved(d):
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        return _let(feistel(kind, F.left(d, a), F.right(d, n - a), _ten(a), _ten(n - a), key), lambda out: F.concat(_zeros(out["x"], a), _zeros(out["y"], n - a)))

    return _let(d, moved)


def _long_digits(kind: str, d: Column, key: Column) -> Column:
    """Permutes a string of 2 to 36 digits among those of its length."""

    def moved(d):
        a = F.floor(F.length(d) / 2).cast("int")
        head = _digits(F.concat(F.lit(f"{kind}|"), F.right(d, F.length(d) - a)), F.left(d, a), key)
        both = _let(head, lambda head: F.concat(head, _digits(F.concat(F.lit(f"{kind}|"), head), F.right(d, F.length(d) - a), key)))
        return F.when(F.length(d) <= 18, _digits(kind, d, key)).otherwise(both)

    return _let(d, moved)


def _only(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced by `digits` in order; all else stays where it stands."""
    return _let(digits, lambda d: F.array_join(F.transform(F.split(m, "[0-9]"), lambda gap, i: F.concat(gap, F.substring(d, i + 1, F.lit(1)))), ""))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    each = F.transform(F.regexp_extract_all(F.reverse(d), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def mod97(account: Column) -> Column:
    """An account number modulo 97: its first four characters last, letters as 10 to 35."""
    turned = _let(account, lambda a: F.concat(F.substring(a, F.lit(5), F.length(a) - 4), F.left(a, F.lit(4))))
    chars = F.transform(F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0)), lambda c: F.ascii(c))
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))


def _day(m: Column) -> Column:
    """The day that a match names, as yyyy-mm-dd, or null; it need not be real."""
    us, eu = (F.concat_ws("-", F.right(m, F.lit(4)), F.substring(m, b, 2), F.substring(m, a, 2)) for a, b in ((4, 1), (1, 4)))
    slash = F.when(F.substring(m, 1, 2) > "12", eu).otherwise(us)
    return F.when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), m).when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), slash).when(m.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), eu)


def _groups(m: Column) -> Column:
    """The eight groups of an IPv6 address as numbers."""
    part = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(m), "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(part(0)) - F.size(part(1)), F.lit(0)))
    return F.transform(F.concat(part(0), gap, part(1)), lambda g: F.conv(g, 16, 10).cast("long"))


def kind_of(m: Column) -> Column:
    """The kind of a match, or null if it isn't valid."""
    plain, digits = F.replace(m, F.lit(" "), F.lit("")), _only(m)
    day = _day(m)
    year = F.left(day, F.lit(4)).cast("int")
    iban = (F.length(plain) >= 15) & (F.length(_only(F.substring(plain, F.lit(5), F.lit(30)))) >= 2) & (mod97(plain) == 1)
    abroad = F.length(digits) - F.length(F.regexp_extract(digits, f"^(?:{CALLING}|...)", 0))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$") & ~m.contains(":"), F.when(iban, "iban"))
        .when(m.contains(":"), F.when((F.size(_groups(m)) == 8) & (m.contains("::") == (F.size(F.filter(F.split(m, ":"), lambda g: g != "")) < 8)), "ipv6"))
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.forall(F.split(m, r"\."), lambda o: o.cast("int") < 256), "ipv4"))
        .when(day.isNotNull(), F.when(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull() & year.between(1901, 2096), "date"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), "national"))
        .when(m.rlike("^([0-9]{13,16}$|[0-9]{4}[ -]([0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{6}[ -][0-9]{5})$)"), F.when(luhn_sum(m) % 10 == 0, "card"))
        .when(m.rlike(r"^\+(?!1[ .\-(0-9])"), F.when((abroad >= 4) & (F.length(digits) <= 15), "phone"))
        .when(m.rlike("[0-9]"), "phone")
    )


def _days(i: Column, key: Column) -> Column:
    return _let(feistel("date", F.floor(i / DAYS[1]), i % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key), lambda moved: moved["x"] * DAYS[1] + moved["y"])


def _date(m: Column, key: Column) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    day = lambda i: F.date_add(first, i.cast("int"))
    i = F.datediff(F.to_date(F.try_to_timestamp(_day(m), F.lit("yyyy-MM-dd"))), first).cast("long")
    late = m.contains("/") & (F.substring(m, 1, 2) > "12")
    start = F.struct(i.alias("i"), F.lit(False).alias("done"))

    def walk(s, _):
        return F.when(s["done"], s).otherwise(_let(_days(s["i"], key), lambda to: F.struct(to.alias("i"), (~late | (F.dayofmonth(day(to)) > 12)).alias("done"))))

    def write(s):
        at = day(F.when(s["done"], s["i"]).otherwise(F.raise_error(F.lit("no day from the 13th was met"))))
        forms = F.when(m.contains("-"), F.date_format(at, "yyyy-MM-dd")).when(m.contains("."), F.date_format(at, "dd.MM.yyyy"))
        return forms.when(late, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "MM/dd/yyyy"))

    # A day that may become any other takes one step.
    return _let(F.aggregate(F.sequence(F.lit(1), F.when(late, F.lit(WALK)).otherwise(F.lit(1))), start, walk), write)


def _phone(m: Column, key: Column) -> Column:

    def moved(digits):
        n = F.length(digits)
        calling = F.regexp_extract(digits, f"^(?:{CALLING}|...)", 0)
        part = lambda stays, kind: F.struct(stays.alias("stays"), kind.alias("kind"))
        own = m.rlike(rf"^(?:{PHONE})$")
        parts = F.when(own, part(F.left(digits, n - 10), F.lit("phone"))).when(m.startswith("+"), part(calling, F.concat(F.lit("phone+"), calling))).otherwise(part(F.left(digits, F.lit(1)), F.lit("phone0")))
        return _let(parts, lambda p: F.concat(p["stays"], _digits(p["kind"], F.right(digits, n - F.length(p["stays"])), key)))

    return _refill(m, _let(_only(m), moved))


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    """The pseudonym of a match of a kind; the match itself if kind is null."""
    payload = _let(_only(m), lambda only: _digits("card", F.left(only, F.length(only) - 1), key))
    # The check digit is the one digit that completes the sum.
    card = _refill(m, _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))
    country, tail = F.left(m, F.lit(2)), F.substring(m, F.lit(5), F.length(m) - 4)
    checked = lambda t: F.concat(country, _zeros(98 - mod97(F.replace(F.concat(country, F.lit("00"), t), F.lit(" "), F.lit(""))), 2), t)
    iban = _let(_refill(tail, _long_digits("iban", _only(tail), key)), checked)
    area = F.left(m, F.lit(3)).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    nat = feistel("national", area * 99 + F.substring(m, 5, 2).cast("long") - 1, F.right(m, F.lit(4)).cast("long") - 1, F.lit(898 * 99), F.lit(9999), key)
    got = lambda n: F.floor(n["x"] / 99)
    national = _let(nat, lambda n: F.concat_ws("-", _zeros(got(n) + F.when(got(n) >= 665, 2).otherwise(1), 3), _zeros(n["x"] % 99 + 1, 2), _zeros(n["y"] + 1, 4)))
    pair = lambda o, i: F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))
    ip = _let(F.transform(F.split(m, r"\."), lambda v: v.cast("long")), lambda o: feistel("ipv4", pair(o, 0), pair(o, 2), F.lit(65536), F.lit(65536), key))
    ipv4 = _let(ip, lambda s: F.concat_ws(".", *[x.cast("string") for c in ("x", "y") for x in (F.floor(s[c] / 256), s[c] % 256)]))
    word = F.lit(1 << 32)
    quad = lambda g, i: F.get(g, F.lit(i)) * 65536 + F.get(g, F.lit(i + 1))
    text = lambda s: F.concat_ws(":", *[F.lower(F.hex(v)) for c in ("x", "y") for v in (F.floor(s[c] / 65536).cast("long"), s[c] % 65536)])
    low = lambda g: F.concat_ws(":", F.lit("ipv6"), *[F.get(g, F.lit(i)).cast("string") for i in range(4, 8)])
    high = lambda g: _let(feistel(low(g), quad(g, 0), quad(g, 2), word, word, key), text)
    both = lambda g, h: F.concat_ws(":", h, _let(feistel(F.concat(F.lit("ipv6:"), h), quad(g, 4), quad(g, 6), word, word, key), text))
    ipv6 = _let(_groups(m), lambda g: _let(high(g), lambda h: both(g, h)))
    email = F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", _phone(m, key)).when(kind == "national", national)
        .when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind == "date", _date(m, key)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, the text with pseudonyms, and n_<kind> for the values replaced. key: a string, or
    a DataFrame of one row and column, whose value is read when the query runs."""
    t = F.col("__t")
    d = docs.select(F.col(id_col), F.col(text_col).alias("__t"), (F.lit(key) if isinstance(key, str) else key.scalar()).alias("__key"))
    # Texts that hold neither a digit nor an at sign need no further look.
    d = d.withColumn("__m", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__k", F.when(F.size("__m") > 0, F.transform("__m", kind_of)).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__gaps", F.when(F.exists("__k", lambda k: k.isNotNull()), F.split(t, ANY)))
    d = d.withColumn("__new", F.when(F.col("__gaps").isNotNull(), F.transform("__m", lambda m, i: pseudonym(m, F.get("__k", i), F.col("__key")))))
    text = F.when(F.col("__gaps").isNull(), t).otherwise(F.array_join(F.transform("__gaps", lambda g, i: F.concat(g, F.coalesce(F.get("__new", i), F.lit("")))), ""))
    counts = [F.expr(f"cast(size(filter(__k, v -> v <=> '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    return d.select(F.col(id_col), text.alias("text"), *counts)
