"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in Spark expressions only.

Found values are validated (dates exist, address bytes are at most 255, numbers have a possible length) and then permuted
within their own format: a date becomes a date, a card number with a right check digit one with a right check digit. The
permutation depends on key and kind alone, so equal values stay equal across documents, and whoever holds the key can undo it:
see restore. The key reaches the executors as the result of a scalar subquery, so it stands in no plan and no event log.

Every domain is a product of two sets of known sizes (or a string, cut in two), on which an unbalanced Feistel network is a
permutation by construction; nothing has to be drawn again until it fits:

    dates            the 146,097 days of a Gregorian cycle, 1800-01-01 to 2199-12-31, as 27 x 5,411
    day-first dates  25/12/2020, which can't be month-first: 400 years x 221 days after a month's twelfth; the 97 leap days apart
    IPv4 addresses   65,536 x 65,536
    123-45-6789      898 areas x 99 groups, x 9,999 serials
    card numbers     all digits but the last, which is the right check digit before and after
    phone numbers    the digits after the country code
    e-mail, secrets  letters and digits, each within its class (hexadecimal digits for secrets)
"""

from __future__ import annotations

from calendar import monthrange

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import fresh

ROUNDS = 8
START, DAYS = "1800-01-01", 146_097

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": _B + r"(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}" + _E,
    "date": _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _E,
    "ip": r"(?<![\p{L}\p{N}_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}_]|\.[0-9])",
    "ssn": _B + r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-[0-9])" + _E,
    "phone": r"(?<![\p{L}\p{N}_+(-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + _E,
    "card": r"(?<![\p{L}\p{N}_+(-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _E,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(key: Column, kind: str, turn: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), text), 256)


def _number(digest: Column) -> Column:
    """The first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: Column, kind: str, back: bool = False) -> Column:
    """struct(a, b) permuted over {0..size_a-1} x {0..size_b-1}: each round shifts one part by a keyed hash of the other. back: the
    inverse permutation."""
    state, sign = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), -1 if back else 1

    def turn(s: Column, r: Column) -> Column:
        to_a = F.pmod(s["a"] + sign * _number(_hash(key, kind, r, s["b"].cast("string"))), F.lit(size_a).cast("long"))
        to_b = F.pmod(s["b"] + sign * _number(_hash(key, kind, r, s["a"].cast("string"))), F.lit(size_b).cast("long"))
        return F.when(r % 2 == 0, F.struct(to_a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), to_b.alias("b")))

    return F.aggregate(_rounds(back), state, turn)


def _shift(c: Column, by: Column, hexadecimal: bool, back: bool) -> Column:
    """A character moved within its class; others stay."""
    step = lambda n: F.pmod(-by, F.lit(n)) if back else by % n
    among = lambda alphabet: F.substring(F.lit(alphabet * 2), (F.instr(F.lit(alphabet), c) + step(len(alphabet))).cast("int"), F.lit(1))
    if hexadecimal:
        return F.when(c.rlike("^[0-9a-f]$"), among("0123456789abcdef")).when(c.rlike("^[A-F]$"), among("0123456789ABCDEF")).otherwise(c)
    return F.when(c.rlike("^[0-9]$"), among("0123456789")).when(c.rlike("^[a-z]$"), among("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)


def feistel_text(text: Column, key: Column, kind: str, hexadecimal: bool = False, back: bool = False) -> Column:
    """text with digits and ASCII letters permuted, each within its class and place: the halves of the character list take
    turns, each shifted by a keyed hash of the other. Two hash digits drive one character, from a digest for each 32. back: the
    inverse permutation."""
    half = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))

    def moved(own: Column, other: Column, r: Column) -> Column:
        chars = F.split(own, "")
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(own) / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", key, F.lit(kind), r.cast("string"), k.cast("string"), other), 256))
        stream = F.array_join(blocks, "")
        return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: _shift(c, F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), hexadecimal, back)), "")

    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(moved(s["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], r).alias("b")))

    return F.aggregate(_rounds(back), state, turn, lambda s: F.concat(s["a"], s["b"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _in_format(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those of `digits`."""
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes digits + it valid."""
    of = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, of), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10))


def _one(value: Column, steps) -> Column:
    """Evaluates value once for an expression that names it often."""
    return F.transform(F.array(value), steps)[0]


def _date(x: Column, key: Column, back: bool = False) -> Column:
    formats = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{2}/": "MM/dd/yyyy", r"^[0-9]{2}\.": "dd.MM.yyyy"}
    out = F.lit(None).cast("string")
    for pattern, form in formats.items():
        day = F.datediff(F.try_to_date(x, form), F.lit(START).cast("date"))
        moved = lambda d: F.when((d >= 0) & (d < DAYS), _one(feistel_pair(F.floor(d / 5411), d % 5411, 27, 5411, key, "date", back), lambda p: F.date_format(F.date_add(F.lit(START).cast("date"), (p["a"] * 5411 + p["b"]).cast("int")), form)))  # noqa: E731, B023
        out = F.when(x.rlike(pattern), _one(day, moved)).otherwise(out)
    return F.coalesce(out, F.when(x.rlike(r"^[0-9]{2}/"), _day_first(x, key, back)))


def _day_first(x: Column, key: Column, back: bool) -> Column:
    """dd/MM/yyyy with a day after the twelfth becomes another such date; null for other texts."""
    days = [monthrange(2001, m)[1] for m in range(1, 13)]
    slots = F.array(*[F.lit(f"{d:02}/{m:02}") for m, n in enumerate(days, 1) for d in range(13, n + 1)])
    leap = F.array(*[F.lit(y) for y in range(1800, 2200) if monthrange(y, 2)[1] == 29])
    year, n_slots, n_leap = F.substring(x, 7, 4).cast("int"), sum(days) - 12 * 12, 97
    slot, of_leap = F.array_position(slots, F.substring(x, 1, 5)), F.array_position(leap, year)
    plain = lambda p: F.concat(F.get(slots, p["b"].cast("int")), F.lit("/"), (p["a"] + 1800).cast("string"))
    on_leap = lambda p: F.concat(F.lit("29/02/"), F.get(leap, p["a"].cast("int")).cast("string"))
    out = F.when((slot > 0) & year.between(1800, 2199), _one(feistel_pair(year - 1800, slot - 1, 400, n_slots, key, "day-first", back), plain))
    return out.when((F.substring(x, 1, 5) == "29/02") & (of_leap > 0), _one(feistel_pair(of_leap - 1, F.lit(0), n_leap, 1, key, "leap-day", back), on_leap))


def _ip(x: Column, key: Column, back: bool = False) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    two = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
    moved = lambda o: F.when(F.array_max(o) <= 255, _one(feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", back), lambda p: F.concat_ws(".", two(p["a"]), two(p["b"]))))
    return _one(octets, moved)


def _ssn(x: Column, key: Column, back: bool = False) -> Column:
    area, group, serial = (F.split(x, "-")[i].cast("int") for i in range(3))
    at = lambda a: F.when(a > 666, a - 2).otherwise(a - 1)
    area_of = lambda k: F.when(k + 1 >= 666, k + 2).otherwise(k + 1)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    out = lambda p: F.format_string("%03d-%02d-%04d", area_of(F.floor(p["a"] / 99)), p["a"] % 99 + 1, p["b"] + 1)
    return F.when(valid, _one(feistel_pair(at(area) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", back), out))


def _phone(x: Column, key: Column, back: bool = False) -> Column:
    code = F.regexp_extract(x, r"^(\+[0-9]{1,3}(?=[ .(-]))?(.*)$", 1)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    n = F.length(_digits(x))
    return F.when(n.between(8, 15), F.concat(code, _in_format(rest, feistel_text(_digits(rest), key, "phone", back=back))))


def _card(x: Column, key: Column, back: bool = False) -> Column:
    def moved(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        valid = F.substring(d, F.length(d), F.lit(1)).cast("int") == luhn_digit(body)
        return F.when(valid, _one(feistel_text(body, key, "card", back=back), lambda new: _in_format(x, F.concat(new, luhn_digit(new).cast("string")))))

    return _one(_digits(x), moved)


def _email(x: Column, key: Column, back: bool = False) -> Column:
    local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    return F.concat(feistel_text(local, key, "email", back=back), F.lit("@"), host)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern fits a whole found value."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of a found value of a kind; null where the value isn't valid. back: the value of a pseudonym."""
    each = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
    out = F.when(kind == "secret", feistel_text(value, key, "secret", hexadecimal=True, back=back))
    for name, f in each.items():
        out = out.when(kind == name, f(value, key, back))
    return out


def _secret(docs: DataFrame, key: str) -> Column:
    """The key as a one-row table's value: a literal would be readable in plans and logs."""
    return docs.sparkSession.createDataFrame([(key,)], "key string").scalar()


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with found values in text_col replaced, and the columns n_values (replaced), values (kind, start, length and
    pseudonym of each, by place) and changed; in their place if docs has such.

    Null texts stay null with no values, empty ones empty. What looks like a value but isn't valid stays as it is. A row is
    treated by itself over its whole text, whatever its id; there is no shuffle. Two different valid values of a kind never
    get the same pseudonym.
    """
    found, gaps, made, secret = fresh(docs, "pii_found", "pii_gaps", "pii_made", "pii_key")
    t = F.col(text_col).cast("string")
    may = t.rlike(r"[0-9]|@")
    wide = docs.withColumn(found, F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
    wide = wide.withColumn(gaps, F.when(F.size(found) > 0, F.split(t, ANY, -1))).withColumn(secret, _secret(docs, key))

    def one(value: Column) -> Column:
        return F.transform(F.array(kind_of(value)), lambda kind: F.struct(kind.alias("kind"), value.alias("value"), pseudonym(value, kind, F.col(secret)).alias("pseudonym")))[0]

    wide = wide.withColumn(made, F.transform(found, one))
    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(made)), made, lambda g, m: F.concat(g, F.coalesce(m["pseudonym"], m["value"]))), ""), F.element_at(gaps, -1))
    starts = F.transform(made, lambda m, i: F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.aggregate(F.slice(made, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["value"])))
    values = F.filter(F.zip_with(made, starts, lambda m, s: F.struct(m["kind"].alias("kind"), s.alias("start"), F.length(m["value"]).alias("length"), m["pseudonym"].alias("pseudonym"))), lambda v: v["pseudonym"].isNotNull())
    out = wide.withColumn("values", values).withColumn(text_col, F.when(F.size(made) > 0, text).otherwise(t))
    return out.withColumn("n_values", F.coalesce(F.size("values"), F.lit(0)).cast("long")).withColumn("changed", F.col("n_values") > 0).drop(found, gaps, made, secret)


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs of pseudonymise with the original values back in text_col, by their places in `values`; columns as given. Null texts
    stay null. Texts must not have been changed since."""
    secret, = fresh(docs, "pii_key")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("shift"))

    def put_back(s: Column, v: Column) -> Column:
        here, size = v["start"] + s["shift"], F.length(v["pseudonym"])
        out = F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, here - s["at"]), pseudonym(v["pseudonym"], v["kind"], F.col(secret), back=True))
        return F.struct(out.alias("out"), (here + size).alias("at"), (s["shift"] + size - v["length"]).alias("shift"))

    whole = F.aggregate("values", start, put_back, lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.length(text_col))))
    back = docs.withColumn(secret, _secret(docs, key))
    return back.withColumn(text_col, F.when(F.size("values") > 0, whole).otherwise(F.col(text_col))).drop(secret)
