"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Numbers and dates that pass their validation are put through a keyed Feistel
network whose domain is exactly the set of valid values of that format: card
numbers keep their length, separators and check digit, addresses stay dotted
quads, dates stay dates. A permutation maps equal values to equal ones and
different values to different ones, so they stay linked across documents
without a table of values; nothing is shuffled. Dates written month first are
linked to each other only.

A text is split at the values found; they are replaced and the pieces joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so that the halves end where they began

# The written forms that are looked for.
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = (r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})"
        r"(?![0-9])")
SECRET = r"""(?<=(?:token|TOKEN|secret|SECRET|key|KEY) = ")[0-9A-Za-z]{16,128}(?=")"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
NUMBERS = f"(?:{DATE}|{ADDRESS}|{PHONE}|{SOCIAL}|{CARD}|{SECRET})"
ALL = f"(?:{MAIL}|{NUMBERS})"
KINDS = ("card", "phone", "address", "date", "social", "mail", "secret")

FIRST_DAY, DAYS = "1600-01-01", (378, 773)  # two whole Gregorian cycles: 1600 to 2399
FIRST_YEAR, MONTHS, LATE_DAYS = 1600, 9600, (18, 9833)  # the same years: 9600 months, 176,994 days after the twelfth


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (values replaced), n_replaced and n_<kind> for each kind, changed: one row per input row.

    Replaced: card numbers (13 to 19 digits with a right check digit), phone
    numbers, IPv4 addresses, dates (1600 to 2399; day before month where both
    readings exist), social security numbers, and, letter for letter and digit
    for digit, the local part of mail addresses and quoted secrets. A number that
    fails its validation stays. A null text stays null and an empty one empty,
    with no values; repeated rows and null ids stay rows of their own; an empty
    table gives an empty result. Other columns do not matter.
    """
    text = F.col("_text")
    pattern = F.when(F.contains(text, F.lit("@")), F.lit(ALL)).otherwise(F.lit(NUMBERS))
    has_any = F.coalesce(text.rlike("[0-9]") | F.contains(text, F.lit("@")), F.lit(False))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).select(
        "doc_id", "_text",
        F.when(has_any, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_found"))
    items = found.withColumn("_items", F.transform("_found", lambda m: F.struct(m.alias("value"), _kind(m).alias("kind"))))
    items = items.withColumn("_new", F.transform("_items", lambda i: _replaced(i["value"], i["kind"], key)))
    pieces = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(
        pieces, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("_items", lambda i: i["kind"] == kind)).cast("long")

    return items.select(
        "doc_id", F.when(F.size("_found") > 0, joined).otherwise(text).alias("text"),
        F.size(F.filter("_items", lambda i: i["kind"].isNotNull())).cast("long").alias("n_replaced"),
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.exists("_items", lambda i: i["kind"].isNotNull()).alias("changed"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _kind(m: Column) -> Column:
    """Which validated kind a value is; null where it fails its validation."""
    octets = F.split(m, r"\.")
    return (F.when(F.contains(m, F.lit("@")), "mail")
            .when(m.rlike("^[0-9.]+$") & m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
                  F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "address"))
            .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"),
                  F.when(_day(m).between(0, DAYS[0] * DAYS[1] - 1), "date"))
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
                  F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "social"))
            .when(m.rlike("[A-Za-z]") | ~m.rlike("^[0-9 +().-]+$"), "secret")
            .when(m.rlike(r"^\+|[(]") | m.rlike(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$") & (F.length(_digits(m)) < 14), "phone")
            .when(F.length(_digits(m)).between(13, 19), F.when(_check_digit(_body(m)) == F.right(m, F.lit(1)), "card")))


def _replaced(m: Column, kind: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return (F.when(kind == "card", _card(m, key))
            .when(kind == "phone", _refill(m, _phone(_digits(m), key)))
            .when(kind == "address", _address(m, key))
            .when(kind == "date", _date(m, key))
            .when(kind == "social", _social(m, key))
            .when(kind == "mail", F.concat(_letters(F.substring(m, F.lit(1), at - 1), key, "mail"), F.substring(m, at, F.length(m))))
            .when(kind == "secret", _letters(m, key, "secret"))
            .otherwise(m))


def _feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """struct(l, r): a keyed permutation of left in 0..a-1 and right in 0..b-1."""
    def turn(acc: Column, i: Column) -> Column:
        word = F.md5(F.concat_ws("|", F.lit(key), tag, i.cast("string"), acc["r"].cast("string")).cast("binary"))
        step = F.conv(F.substring(word, 1, 15), 16, 10).cast("bigint")
        size = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(step, size), size).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _permuted_digits(d: Column, key: str, tag: str) -> Column:
    """Permutes the digit strings of d's length (2 to 36 digits)."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = (F.length(d) - half).cast("int")
    out = _feistel(F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest), _power(half), _power(rest), key,
                   F.concat(F.lit(tag), F.length(d).cast("string")))
    return _let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), half, F.lit("0")),
                                        F.lpad(o["r"].cast("string"), rest, F.lit("0"))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _body(m: Column) -> Column:
    d = _digits(m)
    return F.substring(d, F.lit(1), F.length(d) - 1)


def _check_digit(body: Column) -> Column:
    """The last digit that makes a number pass the card checksum."""
    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    weighed = F.transform(digits, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
        F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    total = F.reduce(weighed, F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    return _let(_permuted_digits(_body(m), key, "card"), lambda b: _refill(m, F.concat(b, _check_digit(b))))


def _phone(d: Column, key: str) -> Column:
    """Keeps the country code, permutes the last ten digits."""
    code = F.length(d) - 10
    return F.concat(F.substring(d, F.lit(1), code), _permuted_digits(F.right(d, F.lit(10)), key, "phone"))


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order, its other characters where they were."""
    chars = F.filter(F.split(m, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(
        c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _address(m: Column, key: str) -> Column:
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    out = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("address"))
    return _let(out, lambda x: F.concat_ws(".", *(
        v.cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256).cast("int"), x[h] % 256))))


def _social(m: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    out = _feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("social"))
    return _let(out, lambda x: F.concat_ws(
        "-", F.lpad((x["l"] + 1 + (x["l"] >= 665).cast("int")).cast("string"), 3, "0"),
        F.lpad((F.floor(x["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["r"] % 9999 + 1).cast("string"), 4, "0")))


def _format(m: Column) -> Column:
    day_first = F.try_to_timestamp(F.translate(m, ".", "/"), F.lit("dd/MM/yyyy")).isNotNull()
    return (F.when(F.contains(m, F.lit("-")), "yyyy-MM-dd")
            .when(F.contains(m, F.lit(".")), "dd.MM.yyyy")
            .when(day_first, "dd/MM/yyyy").otherwise("MM/dd/yyyy"))


def _day(m: Column) -> Column:
    """Days since the first of the domain; null for what is no date."""
    read = F.coalesce(*(F.try_to_timestamp(m, F.lit(f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")))
    return F.unix_date(read.cast("date")) - F.unix_date(F.lit(FIRST_DAY).cast("date"))


def _date(m: Column, key: str) -> Column:
    """A date of the same format.

    ``MM/dd/yyyy`` is the reading of strings that are no ``dd/MM/yyyy``, those with
    a day after the twelfth. They are permuted among themselves: their pseudonyms
    could otherwise be strings that stand for another day in the other format.
    """
    form = _format(m)
    moved = _let(_day(m), lambda d: F.when(form == "MM/dd/yyyy", _late_day(d, key)).otherwise(_any_day(d, key)))
    return _let(moved, lambda d: F.when(form == "yyyy-MM-dd", F.date_format(_calendar(d), "yyyy-MM-dd"))
                .when(form == "dd.MM.yyyy", F.date_format(_calendar(d), "dd.MM.yyyy"))
                .when(form == "dd/MM/yyyy", F.date_format(_calendar(d), "dd/MM/yyyy"))
                .otherwise(F.date_format(_calendar(d), "MM/dd/yyyy")))


def _calendar(d: Column) -> Column:
    return F.date_from_unix_date(d.cast("int") + F.unix_date(F.lit(FIRST_DAY).cast("date")))


def _any_day(d: Column, key: str) -> Column:
    a, b = DAYS
    return _let(_feistel(F.floor(d / b), d % b, F.lit(a), F.lit(b), key, F.lit("date")), lambda x: x["l"] * b + x["r"])


def _late_day(d: Column, key: str) -> Column:
    """Permutes the days after the twelfth of their months, counted without the twelve before each."""
    a, b = LATE_DAYS
    day = _calendar(d)
    month = (F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1

    def first(m: Column) -> Column:
        """The count at the thirteenth of a month."""
        begin = F.make_date((F.floor(m / 12) + FIRST_YEAR).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))
        return F.datediff(begin, F.lit(FIRST_DAY).cast("date")) - m * 12

    def back(x: Column) -> Column:
        # months are nearly equal, so the month by the mean length is at most one off
        near = F.floor(x * MONTHS / (a * b))
        return x + 12 * (near + (x >= first(near + 1)).cast("int") - (x < first(near)).cast("int") + 1)

    moved = _let(d - (month + 1) * 12, lambda x: _feistel(
        F.floor(x / b), x % b, F.lit(a), F.lit(b), key, F.lit("late date")))
    return _let(_let(moved, lambda x: x["l"] * b + x["r"]), back)


def _letters(s: Column, key: str, tag: str) -> Column:
    """The same network on strings: each half is moved, letter for letter within its
    class, by what the key and the other half say. Other characters stay."""
    def moved(c: Column, step: Column) -> Column:
        def turned(first: str, size: int) -> Column:
            return F.char((F.ascii(c) - ord(first) + step) % size + ord(first))
        return (F.when(c.between("a", "z"), turned("a", 26)).when(c.between("A", "Z"), turned("A", 26))
                .when(c.between("0", "9"), turned("0", 10)).otherwise(c))

    def turn(acc: Column, i: Column) -> Column:
        word = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), acc["r"]).cast("binary"), 512)
        chars = F.filter(F.split(acc["l"], ""), lambda c: c != "")
        new = F.transform(chars, lambda c, k: moved(c, F.conv(F.substring(word, k % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.struct(acc["r"].alias("l"), F.array_join(new, "").alias("r"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    return _let(F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda o: F.concat(o["l"], o["r"]))
