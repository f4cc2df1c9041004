"""PII pseudonyms that keep their format, in DataFrame functions only.

Found values are validated (Luhn for cards, octets for addresses, the calendar for dates,
the issued ranges for social security numbers, leading digits for telephone numbers) and
then permuted within their format by a keyed Feistel network whose round function is an MD5
of the key, the round, the format and one half. The network runs over the ranks of the
valid values, so it is a permutation of just these: equal values get equal pseudonyms in
every document, different values different ones, and no pseudonym equals a value that was
left as it is. Cards stay Luhn-valid, dates stay dates (a permutation of the 146,097 days of
1800 to 2199), IPv4 addresses stay addresses, social security numbers stay in the issued
ranges; of a telephone number the country code stays, and a leading digit of 0 or 1 (which no
area code or exchange has) stays among these. Mail addresses, key ids and secrets, which
are not numbers, get keyed digests of the same kind of form. Values that fail validation
stay as they are.

The text is split at the matches and the pseudonyms are put between the parts, so nothing
else changes. All patterns are bounded or loops over single characters, with a start that
no run of like characters repeats, so their time grows with the text and not with its
square, and no text can exhaust the stack: a mail address has at most 64 characters before
the at sign and 127 labels after it (longer ones are no addresses). Texts without a digit,
an at sign, a key prefix or a secret's keyword are passed through.

Null texts stay null, with 0 found; empty and very long texts are texts like others. Repeated
rows are treated alike; all other columns are kept as they are, ``n_found`` is added (a column
of that name is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAYS_A, DAYS_B = 27, 5411  # 27 * 5411 = 146,097 days, 400 Gregorian years
EMAIL = r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
KEY_ID = r"AKIA[0-9A-Z]{16}"
SECRET = r"(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9]{8,}\"?"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DATE_EU = r"(?<![0-9/.])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9/.])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = PHONE.replace("([.-])", "[.-]")
ANY = "|".join([EMAIL, KEY_ID, SECRET, DATE, DATE_EU, IPV4, PHONE, SSN, CARD])
QUICK = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_key)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _number(key: str, what: Column) -> Column:
    """48 bits of a keyed MD5, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}|"), what).cast("binary")), 1, 12), 16, 10).cast("long")


def _rounds(a: Column, b: Column, ma: Column, mb: Column, form: Column, key: str) -> Column:
    """An alternating Feistel network over pairs (a < ma, b < mb); an even number of rounds."""

    def step(s: Column, i: Column) -> Column:
        m = F.when(i % 2 == 0, ma).otherwise(mb)
        f = _number(key, F.concat_ws("|", form, i.cast("string"), s["b"].cast("string")))
        return F.struct(s["b"].alias("a"), ((s["a"] + f % m) % m).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A permutation of the strings of as many digits (2 to 36)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.element_at(F.array(*[F.lit(10**j).cast("long") for j in range(19)]), k + 1)
    form = F.concat(F.lit(kind), n.cast("string"))
    halves = _rounds(digits.substr(F.lit(1), u), digits.substr(u + 1, n), ten(u), ten(n - u), form, key)
    return _let(halves, lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), n - u, "0")))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; the last digit counts once."""

    def total(x: Column) -> Column:
        n = F.length(x)

        def add(so_far: Column, i: Column) -> Column:
            d = x.substr(n - i, F.lit(1)).cast("int")
            return so_far + F.when(i % 2 == 0, d).otherwise(F.floor(d * 2 / 10).cast("int") + d * 2 % 10)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    return _let(digits, total)


def refilled(found: Column, digits: Column) -> Column:
    """``found`` with its digits, in order, replaced by ``digits``."""

    def fill(new: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(
                F.concat(s["out"], F.when(is_digit, new.substr(s["k"], F.lit(1))).otherwise(c)).alias("out"),
                (s["k"] + is_digit.cast("int")).alias("k"),
            )

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        return F.aggregate(F.split(found, ""), start, put)["out"]

    return _let(digits, fill)


def _date(found: Column, form: str, key: str) -> Column:
    day = F.try_to_timestamp(found, F.lit(form)).cast("date")
    n = F.datediff(day, F.lit("1800-01-01").cast("date"))
    halves = _rounds(F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A).cast("long"), F.lit(DAYS_B).cast("long"), F.lit("date"), key)
    moved = F.date_add(F.lit("1800-01-01").cast("date"), _let(halves, lambda s: (s["a"] * DAYS_B + s["b"]).cast("int")))
    return F.when(day.isNotNull() & n.between(0, DAYS_A * DAYS_B - 1), F.date_format(moved, form)).otherwise(found)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found value, or the value itself if it isn't valid."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    body = permuted_digits(digits.substr(F.lit(1), n - 1), "card", key)
    checked = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    card = F.when(luhn_sum(digits) % 10 == 0, refilled(found, checked)).otherwise(found)
    # ten digits of a phone: three and three, neither of which may begin with 0 or 1, and four
    last = digits.substr(n - 9, F.lit(10))
    part = [last.substr(1, 3).cast("long"), last.substr(4, 3).cast("long")]
    low = [p < 200 for p in part]
    base, span = ([F.when(x, lo).otherwise(hi).cast("long") for x in low] for lo, hi in ((0, 200), (200, 800)))
    country = digits.substr(F.lit(1), n - 10)
    rank = (part[0] - base[0]) * span[1] + part[1] - base[1]
    halves = _rounds(rank, last.substr(7, 4).cast("long"), span[0] * span[1], F.lit(10_000).cast("long"), F.concat(F.lit("phone"), country, F.lit("/"), *[x.cast("string") for x in low]), key)
    moved = _let(halves, lambda s: F.concat(*[F.lpad(x.cast("string"), w, "0") for x, w in ((base[0] + F.floor(s["a"] / span[1]), 3), (base[1] + s["a"] % span[1], 3), (s["b"], 4))]))
    phone = refilled(found, F.concat(country, moved))
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area, group, serial = digits.substr(1, 3).cast("long"), digits.substr(4, 2).cast("long"), digits.substr(6, 4).cast("long")
    valid_ssn = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    halves = _rounds((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), F.lit("ssn"), key)
    place = lambda s: F.floor(s["a"] / 99) + 1
    nine = _let(halves, lambda s: F.concat(F.lpad((place(s) + (place(s) >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0")))
    ssn = F.when(valid_ssn, refilled(found, nine)).otherwise(found)
    octet = [F.split(found, r"\.")[k].cast("int") for k in range(4)]
    two16 = F.lit(65536).cast("long")
    halves = _rounds(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], two16, two16, F.lit("ipv4"), key)
    dotted = _let(halves, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)]))
    ip = F.when(F.greatest(*octet) <= 255, dotted).otherwise(found)
    hexed = F.md5(F.concat(F.lit(f"{key}|mail|"), F.lower(found)).cast("binary"))
    mail = F.concat(F.lit("u"), F.substring(hexed, 1, 24), F.lit("@example.invalid"))
    key_id = F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.concat(F.lit(f"{key}|key|"), found).cast("binary")), 1, 16)))
    value = F.regexp_extract(found, r"([A-Za-z0-9]{8,})\"?$", 1)
    secret = F.concat(
        F.regexp_extract(found, r"^(.*?[=:]\s?\"?)[A-Za-z0-9]{8,}\"?$", 1),
        F.substring(F.sha2(F.concat(F.lit(f"{key}|secret|"), value).cast("binary"), 256), F.lit(1), F.least(F.length(value), F.lit(64))),
        F.regexp_extract(found, r"(\"?)$", 1),
    )
    return (
        F.when(found.rlike(_whole(EMAIL)), mail)
        .when(found.rlike(_whole(KEY_ID)), key_id)
        .when(found.rlike(_whole(SECRET)), secret)
        .when(found.rlike(_whole(DATE)), _date(found, "yyyy-MM-dd", key))
        .when(found.rlike(_whole(DATE_EU)), F.when(found.contains("/"), _date(found, "dd/MM/yyyy", key)).otherwise(_date(found, "dd.MM.yyyy", key)))
        .when(found.rlike(_whole(IPV4)), ip)
        .when(found.rlike(_whole(PHONE)), phone)
        .when(found.rlike(_whole(SSN)), ssn)
        .when(found.rlike(_whole(CARD)), card)
        .otherwise(found)
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with PII in ``text`` replaced, and ``n_found`` values replaced or kept. Who has
    ``key`` can link a value to its pseudonym; keep it as a secret."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    out = docs.withColumn("n_found", F.when(t.rlike(QUICK), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(none))
    found = F.col("n_found")
    put = F.transform(found, lambda m: pseudonym(m, key))
    merged = F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), F.concat(put, F.array(F.lit(""))), lambda p, v: F.array(p, v))), "")
    return out.withColumns({"n_found": F.size(found), text: F.when(F.size(found) > 0, merged).otherwise(t)})
