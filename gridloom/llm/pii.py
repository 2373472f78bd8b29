"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in native expressions.

Validated e-mail addresses, phone numbers, IPv4 addresses, payment card numbers (Luhn), bank account numbers
(IBAN), social security numbers and dates are replaced by values of the same format. The permutation depends
on the key and the kind alone, so equal values stay equal across documents. A value x becomes
E'(S(E(x))), with E a Feistel network, E' its inverse and S a step that moves every value (by one, or in
e-mail addresses to the next character in a keyed order): still a permutation of the format, and no
value stays as it was.

All patterns are linear: groups repeat a bounded number of times, and only single characters repeat without
bound, which Java's matcher does in a loop, not by recursion.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import whole_row

#: Formats as Java regular expressions.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9-]\.[A-Za-z]{2,}"
PHONE = r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_YEAR, _TWO = "(?:1[89]|2[01])[0-9]{2}", "[0-3][0-9]"
DATE = rf"(?<![0-9-]){_YEAR}-{_TWO}-{_TWO}(?![0-9-])|(?<![0-9/]){_YEAR}/{_TWO}/{_TWO}(?![0-9/])|(?<![0-9/]){_TWO}/{_TWO}/{_YEAR}(?![0-9/])|(?<![0-9.]){_TWO}\.{_TWO}\.{_YEAR}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Patterns of a date and the order of its parts, by preference: month first where both could be.
DATE_FORMS = (
    (r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{4}/", "yyyy/MM/dd"), (r"^(?:0[1-9]|1[0-2])/[0-3][0-9]/", "MM/dd/yyyy"),
    (r"^[0-9]{2}/", "dd/MM/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy"),
)
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
FIXED = "|".join((EMAIL, DATE, SSN, PHONE, IP, IBAN))
#: Stretches that may hold cards, and the groupings of a card that may stand beside other numbers, by preference.
STRETCH = r"(?<![0-9])[0-9][0-9 -]{12,}+"
GROUPINGS = (
    r"[0-9]{13,19}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",
    *(rf"[0-9]{{4,}}(?:[ -][0-9]{{4,}}){{{k}}}" for k in (1, 2, 3)),
    r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", r"[0-9]{4}(?:[ -][0-9]{3}){3}",
)
KINDS = ("email", "date", "ssn", "phone", "ip", "iban", "card")
#: Feistel rounds each way; days from 1800-01-01 to 2199-12-31 are 27 * 5411.
ROUNDS, DAY_0, DAYS = 4, "1800-01-01", (27, 5411)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def cards(text: Column) -> Column:
    """The distinct strings of a text that are cards (Luhn), by preference.

    Every group of digits may begin a card, so one next to another number is found. A run of any other
    grouping is a card as a whole, unless a card of a usual grouping is inside.
    """
    found = F.array_join(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0)), "\n")

    def listed(stretches: Column) -> Column:
        # Looked ahead, so that proposals may overlap.
        each = [F.regexp_extract_all(stretches, F.lit(rf"(?<![0-9])(?=({g})(?![0-9]))[0-9]"), F.lit(1)) for g in GROUPINGS]
        usual = F.filter(F.array_distinct(F.concat(*each)), _is_card)
        runs = F.filter(F.array_distinct(F.regexp_extract_all(stretches, F.lit(CARD), F.lit(0))), _is_card)
        return _let(usual, lambda u: F.concat(u, F.filter(runs, lambda run: ~F.exists(u, lambda c: F.contains(run, c)))))

    none = F.array().cast("array<string>")
    return F.when(found == "", none).otherwise(_let(found, listed))


def pattern(text: Column) -> Column:
    """The regular expression of a text's personal data: the fixed formats, and its own cards."""
    one = lambda c: F.when(F.size(c) == 0, F.lit(FIXED)).otherwise(F.concat(F.lit(f"{FIXED}|(?<![0-9])(?:"), F.array_join(c, "|"), F.lit(")(?![0-9])")))
    return _let(cards(text), one)


def _day(m: Column) -> Column:
    """The days from DAY_0 of a date in any of the forms; null where it is none."""
    out = None
    for pattern_, form in DATE_FORMS:
        day = F.date_diff(F.try_to_date(m, form), F.lit(DAY_0).cast("date"))
        out = F.when(F.rlike(m, F.lit(pattern_)), day) if out is None else out.when(F.rlike(m, F.lit(pattern_)), day)
    return out


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capitals, which count as 10 to 35."""
    numbers = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(numbers, F.lit(0), lambda r, n: (F.when(n > 9, r * 100 + n).otherwise(r * 10 + n) % 97).cast("int"))


def kind_of(m: Column) -> Column:
    """The kind of a match that its validation confirms, else null."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    bare = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(F.rlike(m, F.lit(f"^(?:{DATE})$")), F.when(_day(m).isNotNull(), "date"))
        .when(F.rlike(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn")
        .when(F.rlike(m, F.lit(f"^(?:{PHONE})$")), "phone")
        .when(F.rlike(m, F.lit(f"^(?:{IP})$")), "ip")
        .when(F.rlike(m, F.lit("^[A-Z]{2}")), F.when(F.length(bare).between(15, 34) & (_mod97(moved) == 1), "iban"))
        .when(F.call_function("luhn_check", digits), "card")
    )


def _numeric(kind: Column, left: Column, right: Column, a: Column, b: Column, key: str) -> Column:
    """struct(l, r): the permutation of (left, right) in Z_a x Z_b."""

    def mask(other: Column, round_: Column, m: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), kind, a.cast("string"), b.cast("string"), round_.cast("string"), other.cast("string"))
        return F.pmod(F.xxhash64(F.sha2(text, 256)), m)

    middle = 2 * ROUNDS

    def step(s: Column, i: Column) -> Column:
        back = i > middle
        round_ = F.when(back, 2 * middle - i).otherwise(i)
        sign = F.when(back, F.lit(-1)).otherwise(F.lit(1))
        l, r = s["l"], s["r"]
        return (
            F.when(i == middle, F.struct(F.when(b > 1, l).otherwise(F.pmod(l + 1, a)).alias("l"), F.pmod(r + 1, b).alias("r")))
            .when(round_ % 2 == 0, F.struct(F.pmod(l + sign * mask(r, round_, a), a).alias("l"), r.alias("r")))
            .otherwise(F.struct(l.alias("l"), F.pmod(r + sign * mask(l, round_, b), b).alias("r")))
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    # Rounds 0 to middle - 1, the step by one, and the rounds back in reverse.
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * middle)), start, lambda s, i: step(s, i.cast("int")))


def _digits(kind: Column, d: Column, key: str) -> Column:
    """A digit string permuted among those of its length (1 to 18 digits)."""
    half = F.floor(F.length(d) / 2).cast("int")
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    left = F.coalesce(F.expr("null").cast("long"), F.when(half > 0, F.substring(d, F.lit(1), half).cast("long")).otherwise(F.lit(0)))
    right = F.substring(d, half + 1, F.length(d)).cast("long")
    out = _numeric(kind, left, right, power(half), power(F.length(d) - half), key)
    return _let(out, lambda x: F.concat(F.when(half > 0, F.lpad(x["l"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(x["r"].cast("string"), F.length(d) - half, F.lit("0"))))


def _refill(m: Column, digits: Column) -> Column:
    """The digits of ``m`` in order replaced by ``digits``; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = F.rlike(c, F.lit("[0-9]"))
        new = F.when(is_digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the check digit that makes Luhn hold."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    payload = _digits(F.lit("card"), F.substring(digits, F.lit(1), F.length(digits) - 1), key)
    check = lambda p: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(p, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    return _refill(m, _let(payload, check))


def _phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code stays.

    Area code and exchange each stay among those that begin with 2 to 9, or among those that
    begin with 0 or 1, so a number that can be dialled gives one that can.
    """
    digits = F.regexp_replace(m, "[^0-9]", "")
    country = F.substring(digits, F.lit(1), F.length(digits) - 10)

    def out(last: Column) -> Column:
        area, exchange, line = F.substring(last, 1, 3).cast("int"), F.substring(last, 4, 3).cast("int"), F.substring(last, 7, 4).cast("int")
        low = lambda x: F.when(x >= 200, 200).otherwise(0)
        many = lambda x: F.when(x >= 200, 800).otherwise(200)
        x = _numeric(F.lit("phone"), area - low(area), (exchange - low(exchange)) * 10000 + line, many(area), many(exchange) * 10000, key)
        pad = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
        return _let(x, lambda x: F.concat(pad(x["l"] + low(area), 3), pad(F.floor(x["r"] / 10000) + low(exchange), 3), pad(x["r"] % 10000, 4)))

    return _refill(m, F.concat(country, _let(F.substring(digits, F.length(digits) - 9, F.lit(10)), out)))


def _iban(m: Column, key: str) -> Column:
    """The last 18 digits at most of the account are permuted, letters stay, and the check digits are those of the result."""

    def out(bare: Column) -> Column:
        country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
        digits = F.regexp_replace(account, "[^0-9]", "")
        last = F.least(F.length(digits), F.lit(18))
        new = F.concat(F.substring(digits, F.lit(1), F.length(digits) - last), F.when(last > 0, _digits(F.lit("iban"), F.right(digits, last), key)).otherwise(""))

        def checked(new_account: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new_account, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(check, F.regexp_replace(new_account, "[^0-9]", ""))

        return _let(_refill(account, new), checked)

    return _refill(m, _let(F.replace(m, F.lit(" "), F.lit("")), out))


def _ip(m: Column, key: str) -> Column:
    def out(o: Column) -> Column:
        n = lambda k: F.get(o, F.lit(k)).cast("int")
        x = _numeric(F.lit("ip"), n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65536), F.lit(65536), key)
        part = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
        return _let(x, lambda x: F.concat_ws(".", part(x["l"]), part(x["r"])))

    return _let(F.split(m, "\\."), out)


def _ssn(m: Column, key: str) -> Column:
    def out(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(k)).cast("int") for k in range(3))
        area = F.when(area > 666, area - 2).otherwise(area - 1)
        x = _numeric(F.lit("ssn"), area, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key)
        back = lambda a: F.when(a >= 665, a + 2).otherwise(a + 1)
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return _let(x, lambda x: F.concat_ws("-", pad(back(x["l"]), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4)))

    return _let(F.split(m, "-"), out)


def _date(m: Column, key: str) -> Column:
    """The same day in another form gives the same pseudonym in that form."""
    zero = F.lit(DAY_0).cast("date")
    moved = lambda day: _numeric(F.lit("date"), F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key)

    def shown(x: Column) -> Column:
        date, out = F.date_add(zero, (x["l"] * DAYS[1] + x["r"]).cast("int")), None
        for pattern_, form in DATE_FORMS:
            text = F.date_format(date, form)
            out = F.when(F.rlike(m, F.lit(pattern_)), text) if out is None else out.when(F.rlike(m, F.lit(pattern_)), text)
        return out

    return _let(_let(_day(m), moved), shown)


def successors(key: str) -> tuple[str, str]:
    """Small letters, capitals and digits, and for each the next of its class in an order of the key."""
    given, out = "", ""
    for chars in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        order = sorted(chars, key=lambda c: hashlib.sha256(f"{key}|successor|{c}".encode()).digest())
        given += "".join(order)
        out += "".join(order[1:] + order[:1])
    return given, out


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part move within their class; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    middle = 2 * ROUNDS

    def moved(c: Column, by: Column) -> Column:
        code = F.ascii(c)
        turn = lambda first, n: F.char((F.pmod(code - first + by, F.lit(n)) + first).cast("long"))
        return F.when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).when(code.between(48, 57), turn(48, 10)).otherwise(c)

    def shifted(part: Column, other: Column, round_: Column, sign: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), round_.cast("string"), F.array_join(other, "")), 512)
        at = lambda d, i: F.conv(F.substring(d, F.pmod(i * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")
        return _let(digest, lambda d: F.transform(part, lambda c, i: moved(c, sign * at(d, i))))

    def step(s: Column, i: Column) -> Column:
        back = i > middle
        round_ = F.when(back, 2 * middle - i).otherwise(i)
        sign = F.when(back, F.lit(-1)).otherwise(F.lit(1))
        # One letter alone has no other half, so the step itself depends on the key.
        one = lambda x: F.transform(x, lambda c: F.translate(c, *successors(key)))
        return (
            F.when(i == middle, F.struct(one(s["l"]).alias("l"), one(s["r"]).alias("r")))
            .when(round_ % 2 == 0, F.struct(shifted(s["l"], s["r"], round_, sign).alias("l"), s["r"].alias("r")))
            .otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], round_, sign).alias("r")))
        )

    start = F.struct(chars(F.substring(local, F.lit(1), half)).alias("l"), chars(F.substring(local, half + 1, F.length(local))).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(2 * middle)), start, lambda s, i: step(s, i.cast("int")), lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))
    return F.concat(out, F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value): a match's kind and its pseudonym; what fails validation has no kind and stays."""

    def by_kind(k: Column) -> Column:
        value = (
            F.when(k == "email", _email(m, key)).when(k == "date", _date(m, key)).when(k == "ssn", _ssn(m, key))
            .when(k == "phone", _phone(m, key)).when(k == "ip", _ip(m, key)).when(k == "iban", _iban(m, key)).when(k == "card", _card(m, key)).otherwise(m)
        )
        return F.struct(k.alias("kind"), value.alias("value"))

    return _let(kind_of(m), by_kind)


def _replaced(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(row, text, found): each whole row as a struct, its new text, and the kind and value of each match.

    Own columns stand beside one struct, so no column of ``docs`` can have the name of one.
    """
    text = F.col("row")[text_col]
    found = docs.select(whole_row(docs).alias("row"))
    found = found.withColumn("pattern", pattern(text))
    found = found.withColumn("found", F.transform(F.regexp_extract_all(text, F.col("pattern"), F.lit(0)), lambda m: pseudonym(m, key)))
    parts = F.split(text, F.col("pattern"), -1)
    joined = _let(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform("found", lambda x, i: F.concat(x["value"], F.get(p, i + 1))), "")))
    return found.select("row", F.when(F.size("found") > 0, joined).otherwise(text).alias("text"), "found")


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in the text replaced and, as ``kinds_col`` (a new name), the kinds found in order.

    Null stays null, and an empty text empty; the order and number of rows and all other columns, whatever
    their names, stay; no rows give no rows. One pass, no shuffle.
    """
    if kinds_col in docs.columns:
        raise ValueError(f"there is a column {kinds_col} already")
    out = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if kinds_col:
        out.append(F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k.isNotNull()).alias(kinds_col))
    return _replaced(docs, key, text_col).select(*out)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_<kind> for each kind) of every row.

    Null texts stay null with zero counts; repeated rows each give a row; other columns are left aside.
    """
    out = _replaced(docs.select(id_col, text_col), key, text_col)
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0))
    counts = [F.when(F.col("found").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("row")[id_col].alias(id_col), F.col("text").alias(text_col), *counts)
