"""Pseudonyms against a plain Feistel network, adversarial texts and clashing names."""

import datetime
import hashlib
import re

import pytest
import xxhash

from gridloom.llm import pii

KEY = "brute force"
ZERO = datetime.date(1800, 1, 1)


def permuted(kind, left, right, a, b):
    """The keyed permutation of (left, right) in Z_a x Z_b, round by round."""

    def mask(round_, other, m):
        digest = hashlib.sha256("|".join(map(str, (KEY, kind, a, b, round_, other))).encode()).hexdigest()
        x = xxhash.xxh64(digest, seed=42).intdigest()
        return (x - 2**64 if x >= 2**63 else x) % m

    def turn(round_, sign):
        nonlocal left, right
        if round_ % 2 == 0:
            left = (left + sign * mask(round_, right, a)) % a
        else:
            right = (right + sign * mask(round_, left, b)) % b

    for k in range(8):
        turn(k, 1)
    right = (right + 1) % b
    for k in reversed(range(8)):
        turn(k, -1)
    return left, right


def digits_of(kind, d):
    half = len(d) // 2
    left, right = permuted(kind, int(d[:half] or 0), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return (f"{left:0{half}d}" if half else "") + f"{right:0{len(d) - half}d}"


def refilled(text, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def email(m):
    local, domain = m.split("@")
    half = len(local) // 2
    given, next_ = pii.successors(KEY)
    step = dict(zip(given, next_, strict=True))
    parts = [list(local[:half]), list(local[half:])]

    def moved(c, by):
        for first, n in ((97, 26), (65, 26), (48, 10)):
            if first <= ord(c) < first + n:
                return chr((ord(c) - first + by) % n + first)
        return c

    def turn(round_, sign):
        mine, other = parts[round_ % 2], parts[1 - round_ % 2]
        digest = hashlib.sha512("|".join((KEY, "email", str(round_), "".join(other))).encode()).hexdigest()
        mine[:] = [moved(c, sign * int(digest[i * 4 % 124 :][:4], 16)) for i, c in enumerate(mine)]

    for k in range(8):
        turn(k, 1)
    parts[:] = [[step.get(c, c) for c in p] for p in parts]
    for k in reversed(range(8)):
        turn(k, -1)
    return "".join(parts[0] + parts[1]) + "@" + domain


def date(m, form):
    day = (datetime.datetime.strptime(m, form).date() - ZERO).days
    left, right = permuted("date", day // 5411, day % 5411, 27, 5411)
    return (ZERO + datetime.timedelta(days=left * 5411 + right)).strftime(form)


def phone(m):
    d = re.sub("[^0-9]", "", m)
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    low = [200 if x >= 200 else 0 for x in (area, exchange)]
    many = [800 if x >= 200 else 200 for x in (area, exchange)]
    left, right = permuted("phone", area - low[0], (exchange - low[1]) * 10000 + line, many[0], many[1] * 10000)
    return refilled(m, d[:-10] + f"{left + low[0]:03d}{right // 10000 + low[1]:03d}{right % 10000:04d}")


def ip(m):
    o = list(map(int, m.split(".")))
    left, right = permuted("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    left, right = permuted("ssn", area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{left + 2 if left >= 665 else left + 1:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def card(m):
    payload = digits_of("card", re.sub("[^0-9]", "", m)[:-1])
    return refilled(m, next(payload + c for c in "0123456789" if luhn(payload + c)))


def iban(m):
    bare = m.replace(" ", "")
    digits = re.sub("[^0-9]", "", bare[4:])
    new = refilled(bare[4:], digits[:-18] + digits_of("iban", digits[-18:]))
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    check = f"{98 - number(new + bare[:2] + '00') % 97:02d}"
    assert number(new + bare[:2] + check) % 97 == 1
    return refilled(m, check + re.sub("[^0-9]", "", new))


VALUES = [
    *((email, x) for x in ("a@x.org", "Z@x.org", "7@x.org", "ann.lee+tag@mail.example.co.uk", "_@x.org", "Q9@a-b.io")),
    *((phone, x) for x in ("212-555-0100", "+1 (743) 555-3824", "012.155.0100", "200 200 0000", "(999) 999-9999")),
    *((ip, x) for x in ("10.0.0.255", "0.0.0.0", "255.255.255.255")), *((ssn, x) for x in ("001-01-0001", "665-99-9999", "667-50-1234", "899-01-0001")),
    *((card, x) for x in ("4111 1111 1111 1111", "378282246310005", "4222222222222")), *((iban, x) for x in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84MALT011000012345MTLCAST001S")),
    *((lambda m, f=f: date(m, f), x) for f, x in (("%Y-%m-%d", "2024-02-29"), ("%m/%d/%Y", "12/31/1999"), ("%d/%m/%Y", "31/12/1999"), ("%d.%m.%Y", "31.12.1999"), ("%Y/%m/%d", "1800/01/01"))),
]


def test_every_kind_is_a_plain_feistel_network(spark):
    rows = spark.createDataFrame([(i, f"see {x}, then") for i, (_, x) in enumerate(VALUES)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, KEY).collect()}
    for i, (plain, x) in enumerate(VALUES):
        assert got[i] == f"see {plain(x)}, then", x
        assert got[i] != f"see {x}, then" or x == "_@x.org"
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, "another key").collect()}
    assert [got[i] for i in range(3)] != [other[i] for i in range(3)]


N = 60_000
ADVERSARIAL = [
    "x@" + "a." * N, "a." * N + "@", "1" * N, "1-" * N, "1 " * N, "(123) " * N, "1.1." * N, "AB12" * N, "AB12 " * N, "x@" + "a" * N, "x@" + "-" * N, "12/31/" * N,
    "@" * N, "4111 " * N, "12.12." * N, "+1 " * N, "2000-01-" * N, "123-45-" * N, "\n" * N, "é" * N,
]


def test_long_tokens_of_every_alternative(spark):
    """No pattern recurses once a repetition, so no token overflows the stack or takes quadratic time."""
    long = spark.createDataFrame([(i, t) for i, t in enumerate([*ADVERSARIAL, "a" * N + "@x.org " + "mail me@x.org " * 500])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(long, KEY).collect()}
    assert all(got[i]["text"] == t for i, t in enumerate(ADVERSARIAL))
    assert got[len(ADVERSARIAL)]["n_email"] == 501


def test_clashing_names(spark):
    names = ["doc_id", "text", "_m", "_p", "_pattern", "_kinds", "row", "found", "pattern", "a.b"]
    rows = spark.createDataFrame([(1, "me@x.org", *"abcdefgh"), (None, None, *"abcdefgh"), (1, "", *"abcdefgh")], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names[2:]))
    out = pii.with_pseudonyms(rows, KEY)
    assert out.columns == names and sorted(str(r[1]) for r in out.collect()) == ["", "None", email("me@x.org")] and {tuple(r[2:]) for r in out.collect()} == {tuple("abcdefgh")}
    assert pii.with_pseudonyms(rows, KEY, kinds_col="kinds").where("doc_id is null").first()["kinds"] is None
    with pytest.raises(ValueError):
        pii.with_pseudonyms(rows, KEY, kinds_col="_kinds")
    assert pii.pseudonymise(rows.limit(0), KEY).count() == 0
