"""PII: format-preserving Feistel pseudonyms.

Card, phone and social security numbers, IP addresses and dates that are valid, and the local parts of mail addresses,
are permuted by a keyed Feistel network inside their own set of valid values, so that the pseudonym has the same
format, is valid too, and is the same wherever the value stands. Each set is split into two moduli whose product is
its size, which makes the network a permutation of exactly that set; only the dates' set is no such product, and
there the permutation walks on while it is outside, EXCESS + 1 steps at most. Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, quoted, text_or_empty

ROUNDS = 8
#: Digits permuted at once, and the longest local part of a mail address.
CHUNK, LOCAL = 26, 64
#: Dates are days from here; 271 * 270 is the least such product at or above their number.
FIRST_DAY, DAYS, DAY_A, DAY_B = "1900-01-01", 73049, 271, 270
EXCESS = DAY_A * DAY_B - DAYS


def _alone(body: str, own: str) -> str:
    """A value that no digit continues, neither directly nor over the value's own separators; letters may touch it."""
    return rf"(?<!\d)(?<!\d[{own}])(?:{body})(?!\d|[{own}]\d)"


#: Card numbers alone may not be joined over letters, '.' or '-' to further digits: hashes and decimal numbers have long runs.
CARD_LEFT, CARD_RIGHT = r"(?<!\d)(?<!\d[A-Za-z_.-]{1,8})", r"(?!\d|(?!-\d)[A-Za-z_.-]{1,8}\d)"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ip": _alone(r"\d{1,3}(?:\.\d{1,3}){3}", "."),
    "date": "|".join(_alone(rf"\d{{4}}{s}\d{{1,2}}{s}\d{{1,2}}|\d{{1,2}}{s}\d{{1,2}}{s}\d{{4}}", s) for s in ("/", r"\.", "-")),
    "ssn": _alone(r"\d{3}-\d{2}-\d{4}", "-"),
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d|[.-]\d)|" + _alone(r"(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}", ".-"),
}
#: A whole chain of digit groups, up to where another value begins; possessive, so that long chains need no stack.
PATTERNS["card"] = CARD_LEFT + r"(?=\d(?:[ -]?\d){12})\d++" + CARD_RIGHT + r"(?:[ -](?!" + "|".join(PATTERNS.values()) + r")\d++" + CARD_RIGHT + ")*+"
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _power(base: int, exponent: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(14)]), exponent.cast("int") + 1)


def _network(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, kind: Column) -> tuple[Column, Column]:
    """Permutes the pair (a, b) of numbers below (mod_a, mod_b)."""

    def turn(state: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), kind, mod_a.cast("string"), mod_b.cast("string"), i.cast("string"), state["b"].cast("string")), 256)
        f = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
        mod = F.when(i % 2 == 0, mod_a).otherwise(mod_b)
        return F.struct(state["b"].alias("a"), ((state["a"] + f) % mod).alias("b"))

    state = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)
    return state["a"], state["b"]


def permuted_number(x: Column, mod_a: int, mod_b: int, key: str, kind: str) -> Column:
    """A permutation of 0..mod_a * mod_b - 1."""
    a, b = _network(_div(x, mod_b), x % mod_b, F.lit(mod_a).cast("long"), F.lit(mod_b).cast("long"), key, F.lit(kind))
    return a * mod_b + b


def _div(x: Column, by: int) -> Column:
    """Whole quotient of numbers that are not negative."""
    return (x - x % by) / by


def permuted_digits(digits: Column, key: str, kind: str, base: int = 10, most: int = CHUNK) -> Column:
    """A permutation of the digit strings of the same length, up to `most` digits.

    Each CHUNK of digits is permuted by itself, keyed by its place and the digits before it.
    """
    chunks = []
    for at in range(0, most, CHUNK):
        chunk = F.substring(digits, at + 1, CHUNK)
        of = F.concat(F.lit(f"{kind}/{at}/"), F.substring(digits, 1, at)) if at else F.lit(kind)
        chunks.append(F.when(chunk != "", _permuted_chunk(chunk, key, of, base)).otherwise(F.lit("")))
    return F.concat(*chunks)


def _permuted_chunk(digits: Column, key: str, kind: Column, base: int) -> Column:
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    number = lambda s: F.coalesce(F.conv(F.when(s != "", s), base, 10).cast("long"), F.lit(0).cast("long"))
    a, b = _network(number(F.substr(digits, F.lit(1), u)), number(F.substr(digits, u + 1, v)), _power(base, u), _power(base, v), key, kind)
    text = lambda x, size: F.when(size == 0, F.lit("")).otherwise(F.lpad(F.conv(x.cast("string"), 10, base), size, "0"))
    return F.concat(text(a, u), text(b, v))


def refilled(form: Column, chars: Column, which: str) -> Column:
    """form with the characters of the class `which` replaced by those of chars, in turn."""
    out = F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda acc, c: F.when(
            c.rlike(which), F.struct(F.concat(acc["s"], F.substr(chars, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
    )
    return out["s"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _part(digits: Column, begin: int, size: int) -> Column:
    return F.substring(digits, begin, size).cast("long")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the last doubled (its digits added)."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(acc["i"] % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).alias("sum"),
            (acc["i"] + 1).alias("i"),
        ),
    )["sum"]


def _card(m: Column, key: str) -> tuple[Column, Column, Column]:
    """Whether a chain of digit groups has runs of whole groups that are valid, the chain with these replaced, and their number.

    Of runs that overlap, one of 16 digits goes first, then the longest, then the leftmost.
    """
    got = _let(F.regexp_extract_all(m, F.lit(r"[ -]?\d+"), F.lit(0)), lambda groups: _let(_chosen(groups), lambda chosen: _with_pseudonyms(groups, chosen, key)))
    return got["n"] > 0, got["s"], got["n"]


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), result)[0]


def _run(groups: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(groups, at + 1, size), "")


def _chosen(groups: Column) -> Column:
    """The runs (at, size) of groups to be replaced."""
    n = F.size(groups)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(n - i, F.lit(19))), lambda k: F.struct(i.alias("at"), k.alias("size"), _digits(_run(groups, i, k)).alias("d")))))
    valid = F.filter(runs, lambda r: F.when(F.char_length(r["d"]).between(13, 19), luhn_sum(r["d"]) % 10 == 0).otherwise(False))
    ranked = F.array_sort(F.transform(valid, lambda r: F.struct((F.char_length(r["d"]) != 16).alias("odd"), (-F.char_length(r["d"])).alias("short"), r["at"].alias("at"), r["size"].alias("size"))))
    return F.array_sort(F.aggregate(
        ranked,
        F.array().cast("array<struct<at:int,size:int>>"),
        lambda acc, r: F.when(F.exists(acc, lambda c: (r["at"] < c["at"] + c["size"]) & (c["at"] < r["at"] + r["size"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(r["at"].alias("at"), r["size"].alias("size"))))
        ),
    ))


def _with_pseudonyms(groups: Column, chosen: Column, key: str) -> Column:
    """struct(s, n): the chain with the chosen runs replaced, and their number."""

    def replaced(form: Column) -> Column:
        d = _digits(form)
        body = permuted_digits(F.substr(d, F.lit(1), F.char_length(d) - 1), key, "card")
        new = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return _let(new, lambda digits: refilled(form, digits, "[0-9]"))

    out = F.aggregate(
        chosen,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("to")),
        lambda acc, c: F.struct(
            F.concat(acc["s"], _run(groups, acc["to"], c["at"] - acc["to"]), _let(_run(groups, c["at"], c["size"]), replaced)).alias("s"),
            (c["at"] + c["size"]).alias("to"),
        ),
        lambda acc: F.concat(acc["s"], _run(groups, acc["to"], F.size(groups))),
    )
    return F.struct(out.alias("s"), F.size(chosen).alias("n"))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d, north = _digits(m), r"^(?:\+1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}$"
    own = F.substr(d, F.char_length(d) - 9, F.lit(10))
    x = ((_part(own, 1, 3) - 200) * 800 + (_part(own, 4, 3) - 200)) * 10000 + _part(own, 7, 4)
    p = permuted_number(x, 80000, 80000, key, "phone-1")
    line, rest = p % 10000, _div(p, 10000).cast("long")
    new = F.concat((_div(rest, 800).cast("long") + 200).cast("string"), (rest % 800 + 200).cast("string"), F.lpad(line.cast("string"), 4, "0"))
    prefix = F.substr(d, F.lit(1), F.char_length(d) - 10)
    # elsewhere the country code is what stands before the first separator, else two digits
    code = F.char_length(F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .(-])", 1))
    code = F.when(code == 0, 2).otherwise(code)
    other = F.concat(F.substr(d, F.lit(1), code), permuted_digits(F.substr(d, code + 1, F.lit(20)), key, "phone"))
    valid = F.char_length(d).between(8, 15) & (m.rlike(north) | m.startswith("+"))
    return valid, refilled(m, F.when(m.rlike(north), F.concat(prefix, new)).otherwise(other), "[0-9]")


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (_part(_digits(m), *x) for x in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    p = permuted_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    rest = _div(p, 9999).cast("long")
    to = _div(rest, 99).cast("long")
    to = F.when(to >= 665, to + 2).otherwise(to + 1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return valid, F.concat_ws("-", pad(to, 3), pad(rest % 99 + 1, 2), pad(p % 9999 + 1, 4))


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = F.forall(octets, lambda x: x <= 255) & ~m.rlike(r"(?:^|\.)0\d")
    x = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    p = permuted_number(x, 65536, 65536, key, "ip").cast("long")
    return valid, F.concat_ws(".", *[(F.shiftright(p, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def _date(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, "[/.-]"), lambda x: x.cast("int"))
    year_first = m.rlike(r"^\d{4}")
    year = F.when(year_first, parts[0]).otherwise(parts[2])
    # day before month if that can be, unless the year comes first
    day_first = ~year_first & (parts[1] <= 12)
    month = F.when(year_first | day_first, parts[1]).otherwise(parts[0])
    day = F.when(year_first, parts[2]).when(day_first, parts[0]).otherwise(parts[1])
    fine = year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31)
    month_end = F.when(fine, F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))))
    valid = F.coalesce(fine & (day <= month_end), F.lit(False))
    x = F.datediff(F.make_date(year, month, day), F.lit(FIRST_DAY).cast("date")).cast("long")
    once = lambda y: permuted_number(y, DAY_A, DAY_B, key, "date").cast("long")
    p = F.aggregate(F.sequence(F.lit(0), F.lit(EXCESS)), F.lit(-1).cast("long"), lambda acc, _: F.when(acc == -1, once(x)).when(acc >= DAYS, once(acc)).otherwise(acc))
    to = F.date_add(F.lit(FIRST_DAY).cast("date"), p.cast("int"))
    ymd = [F.date_format(to, f) for f in ("yyyy", "MM", "dd")]
    sep = F.regexp_extract(m, "([/.-])", 1)
    join = lambda *c: F.concat(c[0], sep, c[1], sep, c[2])
    return valid, F.when(year_first, join(*ymd)).when(day_first, join(*ymd[::-1])).otherwise(join(ymd[1], ymd[2], ymd[0]))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    letters, digits = F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), _digits(local)
    # a-z as the base-26 digits 0-9 and a-p
    base = "0123456789abcdefghijklmnop"
    az = "abcdefghijklmnopqrstuvwxyz"
    new = F.translate(F.lower(permuted_digits(F.translate(letters, az, base), key, "mail-letters", 26, LOCAL)), base, az)
    out = refilled(refilled(local, new, "[A-Za-z]"), permuted_digits(digits, key, "mail-digits", most=LOCAL), "[0-9]")
    return F.lit(True), F.concat(out, F.substr(m, F.char_length(local) + 1, F.lit(1 << 20)))


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _found(m: Column, key: str) -> Column:
    """What stands for a match: struct(kind, text, n values replaced); kind is null if it is not valid."""
    out = None
    as_found = lambda kind, text, n=F.lit(1): F.struct(kind.cast("string").alias("kind"), text.alias("text"), n.alias("n"))
    for kind, maker in _MAKERS.items():
        valid, new, *n = maker(m, key)
        test = m.rlike(f"^(?:{PATTERNS[kind]})$")
        value = F.when(valid, as_found(F.lit(kind), new, *n)).otherwise(as_found(F.lit(None), m))
        if kind in ("phone", "ssn", "date"):
            test = test & valid
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(as_found(F.lit(None), m))


def _count(hits: Column, kind: str) -> Column:
    return F.aggregate(F.filter(hits, lambda h: h["kind"] == kind), F.lit(0).cast("long"), lambda acc, h: acc + h["n"])


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with personal numbers, dates and mail names of text_col replaced, and n_email, n_ip, ... (long) of those replaced.

    A null or empty text comes out empty, with counts of 0. What looks like a number of some kind but is not valid
    stays. Every row stays; equal values get equal pseudonyms in all rows and runs with the same key. Input columns
    named as the counts are replaced; other columns pass through unread.
    """
    names = [f"n_{k}" for k in KINDS]
    kept = [c for c in df.columns if c.lower() not in names]
    text, hits, parts = F.col(f"{OWN}text"), F.col(f"{OWN}hits"), F.col(f"{OWN}parts")
    # most texts have neither a digit nor an at sign
    some = text.rlike("[0-9@]")
    kind = "array<struct<kind:string,text:string,n:int>>"
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _found(m, key))).otherwise(F.array().cast(kind))
    out = (
        df.select(*[F.col(quoted(c)) for c in kept])
        .withColumn(f"{OWN}text", text_or_empty(quoted(text_col)))
        .withColumn(f"{OWN}hits", found)
        .withColumn(f"{OWN}parts", F.when(F.size(hits) > 0, F.split(text, ANY, -1)))
    )
    new = F.when(
        F.size(hits) > 0,
        F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(hits, i)["text"], F.lit("")))), ""),
    ).otherwise(text)
    return out.select(
        *[new.alias(c) if c == text_col else F.col(quoted(c)) for c in kept],
        *[_count(hits, k).alias(f"n_{k}") for k in KINDS],
    )
