"""Format-preserving pseudonyms for private values in texts, in DataFrame functions only.

A Feistel network over the characters of a value: the two halves take turns, each character of one
half being shifted within its class (digits, small and capital letters) by a keyed hash of the other
half. The network is a permutation of the values of one format, so equal values get equal pseudonyms
in all documents and different ones stay different. Numbers that carry a check (cards, account
numbers) are permuted without it and get the check that fits; dates are permuted among dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LATIN_SMALL = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
LATIN_CAPITAL = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
DIGITS, SMALL, CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX_SMALL, HEX_CAPITAL = "abcdef", "ABCDEF"
# Dates with leading zeros are permuted among SPANS * DAYS days: 1850-01-01 to 2149-12-31. Dates without keep the
# number of digits in each part and stay in the years 1900 to 2099.
FIRST_DAY, SPANS, DAYS = "1850-01-01", 1387, 79
# United States numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
AREAS, REST = 898, 99 * 9999

# Characters of the account numbers of each country (ISO 13616 registry).
ACCOUNT_LENGTHS = {
    int(n): names.split()
    for n, names in {
        "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD FK", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK",
        "21": "CH CR HR LI LV", "22": "BG BH DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL",
        "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM",
        "28": "AL AZ BY CY DO GT HN HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
    }.items()
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?:(?<![\p{L}\d._%+@-])|(?<=[._%+-])(?<![\p{L}\d@][._%+-]{1,64}))[\p{L}\d][\p{L}\d._%+-]*@[A-Za-z\d](?:[A-Za-z\d-]*[A-Za-z\d])?(?:\.[A-Za-z\d-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?i:(?<![A-Za-z])(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z\d+/_=.-]{8,})"
ADDRESS = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
ACCOUNT_CAPITAL = r"(?<![A-Za-z\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])"
# In small letters the country must be known, and its length binds, as words may follow.
ACCOUNT_ANY = "|".join(
    rf"(?:{'|'.join(countries)})\d{{2}}(?: ?[a-z\d]){{{n - 4}}}" for n, countries in ACCOUNT_LENGTHS.items()
)
ACCOUNT = rf"(?:{ACCOUNT_CAPITAL}|(?i:(?<![a-z\d])(?:{ACCOUNT_ANY})(?![a-z\d])))"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[/.-]\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])"
CARD = r"(?<![\w+-])(?:\d(?:[ -]?\d){12,18}|(?<!\d\.)\d{4}(?:\.\d{4}){3}(?!\.\d))(?!\w|-\d)"
# The first that matches at a place names the kind.
KINDS = {
    "email": EMAIL,
    "secret": SECRET,
    "address": ADDRESS,
    "account": ACCOUNT,
    "social": SOCIAL,
    "date": DATE,
    "phone": PHONE,
    "card": CARD,
}
ANY = "|".join(KINDS.values())
# Kinds whose matches may hold a card where their own check fails; the other later kinds have marks that these lack,
# or would have matched first.
HOLDERS = ("account", "phone")
# A text without any of these characters holds none of the kinds but a secret.
HINT = r"[\d@]|(?i:token|secret|passw|pwd|key)"


def _hash(key: str, *parts: Column) -> Column:
    """128 hex digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _shift(char: Column, by: Column, classes: tuple[str, ...]) -> Column:
    """``char`` moved on within its class; characters of no class stay."""
    out = char
    for letters in classes:
        at = F.instr(F.lit(letters), char)
        moved = F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def permuted(value: Column, key: str, kind: str, classes: tuple[str, ...]) -> Column:
    """The pseudonym of a string: the same length, each character of the class it was of."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(
        F.substr(value, F.lit(1), half).alias("one"),
        F.substr(value, half + 1, F.length(value)).alias("two"),
    )

    def turn(held: Column, number: Column) -> Column:
        mark = _hash(key, F.lit(kind), number, held["two"])
        chars = F.filter(F.split(held["one"], ""), lambda c: c != "")
        byte = lambda i: F.conv(F.substr(mark, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = F.array_join(F.transform(chars, lambda c, i: _shift(c, byte(i), classes)), "")
        return F.struct(held["two"].alias("one"), moved.alias("two"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, turn, lambda held: F.concat(held["one"], held["two"]))


def permuted_pair(
    one: Column, two: Column, key: str, kind: str, sizes: tuple[int | Column, int | Column]
) -> Column:
    """A permutation of pairs of numbers, ``one`` below ``sizes[0]`` and ``two`` below ``sizes[1]``."""
    start = F.struct(one.cast("long").alias("one"), two.cast("long").alias("two"))
    sizes = tuple(F.lit(n) if isinstance(n, int) else n for n in sizes)

    def turn(held: Column, number: Column) -> Column:
        drawn = lambda part, n: F.conv(F.substr(_hash(key, F.lit(kind), number, part), F.lit(1), F.lit(15)), 16, 10).cast("long") % n
        first = F.pmod(held["one"] + drawn(held["two"], sizes[0]), sizes[0]).cast("long")
        after = F.struct(first.alias("one"), held["two"].alias("two"))
        second = lambda h: F.pmod(h["two"] + drawn(h["one"], sizes[1]), sizes[1]).cast("long")
        return F.transform(F.array(after), lambda h: F.struct(h["one"].alias("one"), second(h).alias("two")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, in order, and all else in its place."""
    between = F.split(value, r"\d", -1)
    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    return F.array_join(F.zip_with(between, chars, lambda b, d: F.concat(b, F.coalesce(d, F.lit("")))), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The check sum of digits counted from the last, those at odd (1) or even (0) places doubled."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(
        chars,
        lambda c, i: F.when(i % 2 == doubled, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")),
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b)


def _mod97(chars: Column) -> Column:
    """An account number, its first four characters moved to the end, as a number modulo 97."""
    moved = F.concat(F.substr(chars, F.lit(5), F.length(chars)), F.substr(chars, F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit(DIGITS + CAPITAL), F.upper(c)) - 1
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: ((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"),
    )


def _card(value: Column, key: str) -> Column:
    """The first run of whole groups with 13 to 19 digits and a right check sum, the longest at its place."""
    size = F.length(value)
    parts = lambda i: F.substr(value, i, F.lit(1)).isin(" ", "-", ".")
    places = F.sequence(F.lit(1), size)
    starts = F.filter(places, lambda i: (i == 1) | parts(i - 1))
    ends = F.reverse(F.filter(places, lambda i: (i == size) | parts(i + 1)))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(ends, lambda j: F.struct(i.alias("i"), j.alias("j")))))
    digits_of = lambda r: _digits(F.substr(value, r["i"], F.greatest(r["j"] - r["i"] + 1, F.lit(0))))
    long = F.filter(runs, lambda r: F.length(digits_of(r)).between(13, 19))
    right = F.filter(long, lambda r: _luhn_sum(digits_of(r), 1) % 10 == 0)

    def told(run: Column) -> Column:
        digits, held = digits_of(run), F.substr(value, run["i"], run["j"] - run["i"] + 1)
        payload = permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", (DIGITS,))
        check = F.pmod(-_luhn_sum(payload, 0), F.lit(10)).cast("string")
        before, after = F.substr(value, F.lit(1), run["i"] - 1), F.substr(value, run["j"] + 1, size)
        return F.concat(before, _refilled(held, F.concat(payload, check)), after)

    return F.coalesce(F.get(F.transform(F.slice(right, 1, 1), told), F.lit(0)), value)


def _account(value: Column, key: str) -> Column:
    """The whole match where its check is right, else as many characters as the country's numbers have."""
    size = F.lit(0)
    for n, countries in ACCOUNT_LENGTHS.items():
        size = F.when(F.upper(F.substr(value, F.lit(1), F.lit(2))).isin(*countries), n).otherwise(size)
    bare = F.regexp_replace(value, " ", "")
    start = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, F.lit(1), i)),
        lambda v: ~v.endswith(" ") & (F.length(F.regexp_replace(v, " ", "")) == size)
        & (F.substr(value, F.length(v) + 1, F.lit(1)) == " "),
    )
    tried = F.when(_mod97(bare) == 1, value).otherwise(F.coalesce(F.get(start, F.lit(0)), value))
    return F.transform(
        F.array(tried), lambda v: F.concat(_whole_account(v, key), F.substr(value, F.length(v) + 1, F.length(value)))
    )[0]


def _whole_account(value: Column, key: str) -> Column:
    bare = F.regexp_replace(value, " ", "")
    body = permuted(F.substr(bare, F.lit(5), F.length(bare)), key, "account", (DIGITS, SMALL, CAPITAL))
    country = F.substr(bare, F.lit(1), F.lit(2))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    # The blanks go back to their places.
    chars = F.concat(country, check, body)
    placed = F.aggregate(
        F.filter(F.split(value, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.struct(
            F.concat(a["out"], F.when(c == " ", c).otherwise(F.substr(chars, a["at"], F.lit(1)))).alias("out"),
            (a["at"] + F.when(c == " ", 0).otherwise(1)).alias("at"),
        ),
        lambda a: a["out"],
    )
    return F.when(_mod97(bare) == 1, placed).otherwise(value)


def _social(value: Column, key: str) -> Column:
    part = lambda k: F.split(value, "-")[k].cast("long")
    area, group, serial = part(0), part(1), part(2)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    found = permuted_pair(index, (group - 1) * 9999 + serial - 1, key, "social", (AREAS, REST))
    told = F.transform(
        F.array(found),
        lambda p: F.format_string(
            "%03d-%02d-%04d",
            p["one"] + F.when(p["one"] >= 665, 2).otherwise(1),
            F.floor(p["two"] / 9999) + 1,
            p["two"] % 9999 + 1,
        ),
    )[0]
    return F.when(valid, told).otherwise(value)


def _address(value: Column, key: str) -> Column:
    """Each part among the numbers of as many digits: 0 to 9, 10 to 99, 100 to 255."""
    part = lambda k: F.split(value, r"\.")[k]
    count = lambda k: F.element_at(F.array(*map(F.lit, (10, 90, 156))), F.length(part(k)))
    least = lambda k: F.element_at(F.array(*map(F.lit, (0, 10, 100))), F.length(part(k)))
    index = lambda k: part(k).cast("long") - least(k)
    found = permuted_pair(
        index(0) * count(1) + index(1),
        index(2) * count(3) + index(3),
        key,
        "address",
        (count(0) * count(1), count(2) * count(3)),
    )
    return F.transform(
        F.array(found),
        lambda p: F.concat_ws(
            ".",
            *[
                (least(k) + number).cast("string")
                for name, one, two in (("one", 0, 1), ("two", 2, 3))
                for k, number in ((one, F.floor(p[name] / count(two))), (two, p[name] % count(two)))
            ],
        ),
    )[0]


def _date(value: Column, key: str) -> Column:
    """Day first where dots part it, month first where slashes do and that is a date."""
    first = F.to_date(F.lit(FIRST_DAY))

    def moved(pattern: str) -> Column:
        day = F.to_date(F.try_to_timestamp(value, F.lit(pattern)))
        number = F.datediff(day, first)
        found = permuted_pair(F.floor(number / DAYS), number % DAYS, key, "date", (SPANS, DAYS))
        told = F.date_format(
            F.transform(F.array(found), lambda p: F.date_add(first, (p["one"] * DAYS + p["two"]).cast("int")))[0], pattern
        )
        return F.when((number >= 0) & (number < SPANS * DAYS), told)

    def short(mark: str, day_at: int, pattern: str) -> Column:
        """Parts without leading zeros, among dates with as many digits in each."""
        part = lambda k: F.split(value, rf"\{mark}")[k]
        day, month, year = part(day_at).cast("int"), part(1 - day_at).cast("int"), part(2).cast("int")
        # Days to 28 are in every month; later ones keep day and month, and the 29th of February a leap year.
        late, leap = day > 28, (day == 29) & (month == 2)
        days = F.when(late, 1).when(F.length(part(day_at)) == 1, 9).otherwise(19)
        from_day = F.when(late, day).when(F.length(part(day_at)) == 1, 1).otherwise(10)
        months = F.when(late, 1).when(F.length(part(1 - day_at)) == 1, 9).otherwise(3)
        from_month = F.when(late, month).when(F.length(part(1 - day_at)) == 1, 1).otherwise(10)
        step, from_year = F.when(leap, 4).otherwise(1), F.when(leap, 1904).otherwise(1900)
        years = F.when(leap, 49).otherwise(200)
        found = permuted_pair(
            (day - from_day) * months + month - from_month,
            F.floor((year - from_year) / step),
            key,
            f"date{day_at}",
            (days * months, years),
        )
        told = F.transform(
            F.array(found),
            lambda p: F.concat_ws(
                mark,
                *[
                    (from_day + F.floor(p["one"] / months) if k == day_at else from_month + p["one"] % months).cast("string")
                    for k in (0, 1)
                ],
                (from_year + p["two"] * step).cast("string"),
            ),
        )[0]
        valid = F.try_to_timestamp(value, F.lit(pattern)).isNotNull() & ~part(0).startswith("0") & ~part(1).startswith("0")
        return F.when(valid & year.between(1900, 2099), told)

    padded = value.rlike(r"^\d{2}\D\d{2}\D")
    return F.coalesce(
        F.when(value.contains("-"), moved("yyyy-MM-dd"))
        .when(padded & value.contains("."), moved("dd.MM.yyyy"))
        .when(padded, F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy")))
        .when(value.contains("."), short(".", 0, "d.M.yyyy"))
        .otherwise(F.coalesce(short("/", 1, "M/d/yyyy"), short("/", 0, "d/M/yyyy"))),
        value,
    )


def _phone(value: Column, key: str) -> Column:
    """All digits but a country code."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)|^\+\d|^", 0)
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    digits = _digits(rest)
    valid = F.length(_digits(value)).between(8, 15)
    return F.when(valid, F.concat(code, _refilled(rest, permuted(digits, key, "phone", (DIGITS,))))).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """All but the last label of the domain."""
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    front = F.substr(value, F.lit(1), F.length(value) - F.length(top))
    return F.concat(permuted(front, key, "email", (DIGITS, SMALL, CAPITAL, LATIN_SMALL, LATIN_CAPITAL)), top)


def _secret(value: Column, key: str) -> Column:
    """What follows the name; hexadecimal values stay so."""
    name = F.regexp_extract(value, r"^[^=:]*[=:]\s*[\"']?", 0)
    told = F.substr(value, F.length(name) + 1, F.length(value))
    return F.concat(
        name,
        F.when(told.rlike(r"^(?:[\da-f]+|[\dA-F]+)$"), permuted(told, key, "secret", (DIGITS, HEX_SMALL, HEX_CAPITAL))).otherwise(
            permuted(told, key, "secret", (DIGITS, SMALL, CAPITAL))
        ),
    )


MAKERS = {
    "email": _email,
    "secret": _secret,
    "address": _address,
    "account": _account,
    "social": _social,
    "date": _date,
    "phone": _phone,
    "card": _card,
}


def _unless(value: Column, inner: Column) -> Callable[[Column], Column]:
    return lambda told: F.when(told == value, inner).otherwise(told)


def pseudonym(value: Column, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """The pseudonym of a match of ``kinds``; a number that fails its check stays as it is.

    What starts like an account or phone number and fails its check is searched for cards.
    """
    out = value
    for kind in reversed(kinds):
        own = MAKERS[kind](value, key)
        if kind in HOLDERS:
            held = F.regexp_extract_all(value, F.lit(CARD), F.lit(0))
            own = F.transform(F.array(own), _unless(value, replaced(value, held, key, ("card",))))[0]
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), own).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the private values in its texts replaced; all other columns as they are.

    Lengths do not change. Texts that are null, empty or hold no private value stay as they are;
    repeated rows and equal values get equal results; there is no shuffle and no state.
    """
    text = F.col(f"`{text_col}`")
    return docs.withColumn(text_col, replaced(text, found_in(text), key))


def found_in(text: Column) -> Column:
    """All matches of the private kinds in order; null or empty where there is none."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def replaced(text: Column, found: Column, key: str, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    between = F.split(text, "|".join(KINDS[k] for k in kinds), -1)
    values = F.transform(found, lambda v: pseudonym(v, key, kinds))
    joined = F.zip_with(between, values, lambda b, v: F.concat(b, F.coalesce(v, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(text)


def private_values(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the pseudonymised ``text`` and ``n_found``, the values looked at, of each row."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`"), text.alias("text"), found_in(text).alias("found"))
    return rows.select(
        F.col(f"`{id_col}`"),
        replaced(F.col("text"), F.col("found"), key).alias("text"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"),
    )
