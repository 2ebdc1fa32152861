"""Format-preserving pseudonyms of personal data (DataFrame functions only).

One regular expression finds candidates; each is validated by kind. Numbers and dates are permuted within their format by
a keyed Feistel network, so equal values get equal pseudonyms in every document and different values different ones:

- payment cards (13 to 19 digits that pass the Luhn check): all digits but the last are permuted, the check digit is made anew;
- other runs of 12 to 34 digits: the digits are permuted;
- phone numbers: the digits after the country code are permuted under that code, so that one number gets one pseudonym
  however it is spelt; without a sign the number is North American (code 1). Signs and the country code stay;
- social security numbers: those that can be issued are permuted among themselves, others among the rest;
- IBANs (that pass the mod 97 check): the digits of the account part are permuted, the check digits made anew;
- IPv4 addresses: permuted among all addresses;
- calendar dates of all four-digit years: those of 1800 to 2199 among themselves, others among the rest, written in the same
  format. Each format is a domain of its own. Dates with slashes are three: 25/12/2020 can only be read day first, 12/25/2020
  only month first, 05/06/2020 both ways; each is walked along the permutation until it comes out in its own domain.

The network alternates over both halves of a value: l = l + F(r), then r = r + F(l), modulo each half's size; F is a keyed
SHA-256. ``reveal`` runs the rounds backwards. Mail addresses and secrets (hex digests, keys of known shapes), which are
neither numbers nor dates, get keyed digests of the same shape. Phone numbers carry no check digit to validate.

The key must be given, or set in ``spark.cairn.pii.key``: who knows it can undo the pseudonyms.

Defined results: a null text stays null with no findings; candidates that fail validation (a date of 31 February) stay as
they are. Repeated rows and extra columns stay, whatever their names, but for a column named found, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY_CONF = "spark.cairn.pii.key"
#: The days of the years 0000 to 9999; those of 1800 to 2199 among them; radices of the domains inside and outside of these.
DAYS, EPOCH = 3652425, "0000-01-01"
RECENT, RECENT_DAYS = 657437, 146097
RADICES, REST_RADICES = (189, 773), (1512, 2319)
#: Steps of a walk: a value that belongs to its domain by chance p is not back after them with probability (1 - p) ** steps.
WALK = 600
# The calling codes of two digits; 1 and 7 have one, the others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![\w.%+\-])[\w.%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}\b"
SECRET = r"\b[0-9A-Fa-f]{32,128}\b|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,255}\b|\bsk-[0-9A-Za-z\-]{20,200}\b"
IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b(?!\.[0-9])"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
DAY_DATE = r"\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_LOCAL = r"\b[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}\b"
#: What a space before it parts from a number: the group belongs to an address, a date or a number of its own.
_NEXT = rf"{IPV4}|{ISO_DATE}|{DAY_DATE}|{SSN}|{_LOCAL}|[0-9]{{4}}(?:[ \-][0-9]{{4}}){{3}}\b(?![ \-][0-9]{{4}}\b)|[0-9]{{12}}"
#: After ten digits a phone may be whole: a year, a decimal number or a time is none of its groups.
_NEXT_WHOLE = rf"{_NEXT}|(?:19|20)[0-9]{{2}}\b|[0-9]+[.,:/][0-9]"
_SHUT = "|".join(rf"(?<=\([0-9]{{{n}}})\)[ .\-]?" for n in range(1, 6))
_GROUP = r"[ .\-](?=[0-9]{2})"
#: After the country code one digit may be a group.
_CODE = "|".join(rf"(?<=\+[0-9]{{{n}}})[ .\-]" for n in range(1, 4))
_HEAD = rf"{_CODE}|{_GROUP}|[ .\-]?\((?=[0-9]{{1,5}}\))|{_SHUT}"
#: At most 15 digits (E.164); +1 has ten after it.
PHONE = (
    r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}\b"
    rf"|\+[0-9](?:(?:{_HEAD})?[0-9]){{6}}(?:(?:(?! (?:{_NEXT})){_GROUP})?[0-9]){{0,3}}(?:(?:(?! (?:{_NEXT_WHOLE})){_GROUP})?[0-9]){{0,5}}\b"
    rf"|\([0-9]{{3}}\) ?[0-9]{{3}}[ .\-][0-9]{{4}}\b|{_LOCAL}"
)
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b"
NUMBER = rf"\b[0-9]{{4}}(?:[ \-]?[0-9]{{4}}){{2}}(?! (?:{_NEXT}))[ \-]?[0-9]{{1,7}}\b|\b[0-9]{{12,34}}\b"
PATTERN = "|".join((EMAIL, IPV4, ISO_DATE, DAY_DATE, SSN, PHONE, IBAN, NUMBER, SECRET))
#: Digits with single separators anywhere, of which no group begins another candidate: a card if the Luhn check says so.
GROUPED = rf"\b(?=(?:[ \-]?[0-9]){{13}})(?!{PATTERN})[0-9]{{1,18}}(?:[ \-](?!{PATTERN})[0-9]{{1,18}}){{1,18}}\b"
#: (?U): letters of any script are letters, so a local part in French is found whole.
ANY = f"(?U){PATTERN}|{GROUPED}"


def _prf(key: Column, tweak: Column, i: Column, value: Column, size: Column) -> Column:
    h = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % size


def network(left: Column, right: Column, m: Column, n: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """struct(l, r): the Feistel network over [0, m) x [0, n), or its inverse."""
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(a: Column, i: Column) -> Column:
        x, y = a["l"], a["r"]
        fx, fy = _prf(key, tweak, i, y, m), _prf(key, tweak, i, x, n)
        new_x = (x - fx + m) % m if back else (x + fx) % m
        new_y = (y - fy + n) % n if back else (y + fy) % n
        even = i % 2 == 0
        return F.struct(F.when(even, new_x).otherwise(x).alias("l"), F.when(even, y).otherwise(new_y).alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, turn)


def _once(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def walked(start: Column, step, belongs) -> Column:
    """The first value after start on its way along a permutation that belongs to its domain again."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), start, lambda x, i: F.when((i > 0) & belongs(x), x).otherwise(step(x)))


def digits_permuted(digits: Column, key: Column, kind: str | Column, back: bool = False) -> Column:
    """A permutation of the strings of as many digits (2 to 34)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def run(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        out = network(F.substring(d, F.lit(1), u), F.substring(d, u + 1, v), ten(u), ten(v), key, F.concat_ws("|", kind, F.length(d).cast("string")), back)
        return _once(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), v, "0")))

    return _once(digits, run)


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits, in order, replaced by those of digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))
    )
    return F.aggregate(F.split(shape, ""), start, step, lambda a: a["s"])


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits as they stand before a check digit: the last one is doubled."""
    n = F.length(digits)

    def add(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), add), F.lit(0), lambda a, x: a + x)


def check_digit(digits: Column) -> Column:
    return ((10 - luhn_sum(digits) % 10) % 10).cast("string")


def mod97(s: Column) -> Column:
    """The number that letters (A = 10) and digits spell, modulo 97."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + _value(c)) % 97)


def _value(c: Column) -> Column:
    # cast of a letter would fail: the digit's value comes from its code as well
    return F.ascii(c) - F.when(c.rlike("^[0-9]$"), 48).otherwise(55)


def number(s: Column, key: Column, back: bool = False) -> Column:
    """Cards keep a valid check digit and other numbers do not become cards' pseudonyms: each set is permuted on its own digits."""

    def run(d: Column) -> Column:
        n = F.length(d)
        body = F.substring(d, F.lit(1), n - 1)
        # The last digit keeps its distance from the check digit: none for a card, and a number that is no card must not come out
        # as one.
        gap = (F.substring(d, n, F.lit(1)).cast("int") - check_digit(body).cast("int") + 10) % 10

        def again(g: Column) -> Column:
            kind = F.when((g == 0) & n.between(13, 19), "card").otherwise("number")
            return _once(digits_permuted(body, key, kind, back), lambda b: F.concat(b, ((check_digit(b).cast("int") + g) % 10).cast("string")))

        return _once(gap, again)

    return _once(only_digits(s), lambda d: refill(s, run(d)))


def is_card(digits: Column) -> Column:
    n = F.length(digits)
    return n.between(13, 19) & (F.substring(digits, n, F.lit(1)) == check_digit(F.substring(digits, F.lit(1), n - 1)))


def grouped(s: Column, key: Column) -> Column:
    """The card that all groups spell, or the cards that runs of groups of three digits or more spell, leftmost and longest
    first; null if there is none."""

    def run(g: Column) -> Column:
        k = F.size(g)

        def longest(i: Column) -> Column:
            joined = lambda n: F.array_join(F.slice(g, i + 1, n), "")
            fits = lambda n: ((n == k) | F.forall(F.slice(g, i + 1, n), lambda x: F.length(only_digits(x)) >= 3)) & is_card(only_digits(joined(n)))
            return F.coalesce(F.get(F.filter(F.sequence(k - i, F.lit(1), F.lit(-1)), fits), F.lit(0)), F.lit(0))

        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("skip"))

        def step(a: Column, i: Column) -> Column:
            new = lambda n: F.when(n > 0, F.struct(F.concat(a["s"], number(F.array_join(F.slice(g, i + 1, n), ""), key)).alias("s"), (i + n).alias("skip"))).otherwise(
                F.struct(F.concat(a["s"], F.get(g, i)).alias("s"), a["skip"].alias("skip"))
            )
            return F.when(i < a["skip"], a).otherwise(_once(longest(i), new))

        return F.aggregate(F.sequence(F.lit(0), k - 1), start, step, lambda a: a["s"])

    return F.nullif(_once(F.split(s, r"(?<=[ \-])"), run), s)


def phone(s: Column, key: Column, back: bool = False) -> Column:
    def run(d: Column) -> Column:
        n = F.when(~s.startswith("+"), 0).when(d.rlike("^[17]"), 1).when(F.substring(d, 1, 2).isin(TWO_DIGIT_CODES), 2).otherwise(3)

        def under(code: Column) -> Column:
            tweak = F.concat(F.lit("phone"), F.when(code == "", "1").otherwise(code))
            return F.concat(code, digits_permuted(F.substring(d, F.length(code) + 1, F.length(d)), key, tweak, back))

        return refill(s, _once(F.substring(d, F.lit(1), n), under))

    return _once(only_digits(s), run)


def issued(d: Column) -> Column:
    """Whether nine digits can be a social security number."""
    return ~d.rlike("^(?:000|666|9|[0-9]{3}00|[0-9]{5}0000)")


def ssn(s: Column, key: Column, back: bool = False) -> Column:
    """Areas but 000, 666 and 9xx, groups but 00 and serials but 0000 number 898 * 99 and 9999."""

    def run(d: Column) -> Column:
        part = lambda i, n: F.substring(d, i, n).cast("long")
        area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
        out = network(area * 99 + part(4, 2) - 1, part(6, 4) - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn"), back)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        area_of = lambda x: F.floor(x / 99) + F.when(F.floor(x / 99) >= 665, 2).otherwise(1)
        new = _once(out, lambda x: F.concat(pad(area_of(x["l"]), 3), pad(x["l"] % 99 + 1, 2), pad(x["r"] + 1, 4)))
        return F.when(issued(d), new).otherwise(walked(d, lambda x: digits_permuted(x, key, "no ssn", back), lambda x: ~issued(x)))

    return _once(only_digits(s), lambda d: refill(s, run(d)))


def iban(s: Column, key: Column, back: bool = False) -> Column:
    """Null for what is no IBAN."""
    land, tail = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
    bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    valid = (mod97(F.concat(bare(tail), F.substring(s, 1, 4))) == 1) & (F.length(only_digits(tail)) >= 4)
    new = refill(tail, digits_permuted(only_digits(tail), key, "iban", back))
    check = lambda t: F.lpad((98 - mod97(F.concat(bare(t), land, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _once(new, lambda t: F.concat(land, check(t), t)))


def ipv4(s: Column, key: Column, back: bool = False) -> Column:
    o = F.split(s, r"\.")
    half = lambda i: F.get(o, F.lit(i)).cast("long") * 256 + F.get(o, F.lit(i + 1)).cast("long")
    out = network(half(0), half(2), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ipv4"), back)
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _once(out, lambda x: F.concat_ws(".", part(x["l"]), part(x["r"])))


def day_permuted(day: Column, key: Column, back: bool = False) -> Column:
    """A permutation of [0, DAYS) that keeps the days of 1800 to 2199 among themselves."""
    recent = day.between(RECENT, RECENT + RECENT_DAYS - 1)
    pick = lambda a, b: F.when(recent, a).otherwise(b)
    (a, b), (c, d) = RADICES, REST_RADICES
    # The domain's own number of the day, and the day of such a number.
    at = pick(day - RECENT, F.when(day < RECENT, day).otherwise(day - RECENT_DAYS))
    day_of = lambda x: pick(x + RECENT, F.when(x < RECENT, x).otherwise(x + RECENT_DAYS))
    m, n = pick(a, c).cast("long"), pick(b, d).cast("long")
    out = _once(at, lambda x: network(F.floor(x / n), x % n, m, n, key, pick("date", "other date"), back))
    return _once(_once(out, lambda y: y["l"] * n + y["r"]), day_of)


def date(s: Column, key: Column, fmt: str | Column, back: bool = False, low: Column | None = None) -> Column:
    """Null for what is no date. low: the date must come out with a day up to 12 (true) or above (false); null: with any."""
    fmt, low = F.lit(fmt) if isinstance(fmt, str) else fmt, F.lit(None).cast("boolean") if low is None else low
    epoch = F.lit(EPOCH).cast("date")
    day = F.datediff(F.to_date(F.try_to_timestamp(s, fmt)), epoch).cast("long")
    of = lambda n: F.date_add(epoch, n.cast("int"))
    new = lambda n: walked(n, lambda x: day_permuted(x, key, back), lambda x: F.coalesce((F.dayofmonth(of(x)) <= 12) == low, F.lit(True)))
    return F.when(day.isNotNull(), _once(day, lambda n: F.call_function("date_format", of(new(n)), fmt)))


def dated(s: Column, key: Column, back: bool = False) -> Column:
    """A date in the format that its signs tell. With slashes it is read day first if it can be; whether it can be read both
    ways stays as it is."""
    first, second = F.substring(s, 1, 2).try_cast("int"), F.substring(s, 4, 2).try_cast("int")
    slash = s.contains("/")
    fmt = F.when(s.contains("-"), "yyyy-MM-dd").when(~slash, "dd.MM.yyyy").when(second > 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    return date(s, key, fmt, back, F.when(slash, (first <= 12) & (second <= 12)))


def email(s: Column, key: Column) -> Column:
    h = lambda x, n: F.substring(F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(x)), 256), 1, n)
    at = F.split(s, "@")
    return F.concat(F.lit("u"), h(s, 12), F.lit("@h"), h(F.get(at, F.lit(1)), 8), F.lit(".invalid"))


def secret(s: Column, key: Column) -> Column:
    """Digests of the same length: hex in the case of hex, else after the prefix that tells the kind."""
    h = F.concat(*[F.sha2(F.concat_ws("|", key, F.lit(f"secret{i}"), s), 256) for i in range(4)])
    lead = F.regexp_extract(s, r"^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0)
    same = F.when(s.rlike("[A-F]"), F.upper(F.substring(h, F.lit(1), F.length(s)))).otherwise(F.substring(h, F.lit(1), F.length(s)))
    return F.when(F.length(lead) > 0, F.concat(lead, F.upper(F.substring(h, F.lit(1), F.length(s) - F.length(lead))))).otherwise(same)


def whole(pattern: str) -> str:
    return f"(?U)^(?:{pattern})$"


def kind_of(s: Column) -> Column:
    out = F.when(s.rlike(whole(EMAIL)), "email").when(s.rlike(whole(IPV4)), "ipv4").when(s.rlike(whole(ISO_DATE)), "iso_date")
    out = out.when(s.rlike(whole(DAY_DATE)) & s.contains("/"), "slash_date").when(s.rlike(whole(DAY_DATE)), "dot_date").when(s.rlike(whole(SSN)), "ssn")
    return out.when(s.rlike(whole(PHONE)), "phone").when(s.rlike(whole(NUMBER)), "number").when(s.rlike(whole(IBAN)), "iban").when(s.rlike(r"^[0-9]+(?:[ \-][0-9]+)+$"), "grouped").otherwise("secret")


def pseudonym(s: Column, key: Column) -> Column:
    """The pseudonym of a candidate; null where validation says that it is none."""

    def run(k: Column) -> Column:
        out = F.when(k == "email", email(s, key)).when(k == "ipv4", ipv4(s, key)).when(k.endswith("_date"), dated(s, key)).when(k == "ssn", ssn(s, key))
        out = out.when(k == "phone", phone(s, key)).when(k == "number", number(s, key)).when(k == "iban", iban(s, key)).when(k == "grouped", grouped(s, key))
        return F.struct(F.when(k == "grouped", "number").otherwise(k).alias("kind"), out.otherwise(secret(s, key)).alias("value"))

    return _once(kind_of(s), run)


def reveal(s: Column, key: Column, kind: str) -> Column:
    """The original of a number's or a date's pseudonym, for who holds the key."""
    return {
        "number": lambda: number(s, key, True), "phone": lambda: phone(s, key, True), "ssn": lambda: ssn(s, key, True), "iban": lambda: iban(s, key, True),
        "ipv4": lambda: ipv4(s, key, True), "iso_date": lambda: dated(s, key, True), "dot_date": lambda: dated(s, key, True), "slash_date": lambda: dated(s, key, True),
    }[kind]()


#: What every text with a match of ANY holds: a digit, an at sign, or a key of letters only.
NEEDED = r"[0-9@]|sk-|gh[pousr]_|A[KS]IA|[A-Fa-f]{32}"


def protect(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and found: an array of (kind, value) with the pseudonyms in text order."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"no key for pseudonyms: give one, or set {KEY_CONF}")
    k = F.lit(key)
    # The columns of docs travel in one struct, so none of their names can clash with those made here.
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("t"))
    x = x.withColumn("m", F.when(F.col("t").rlike(NEEDED), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))
    some = F.size("m") > 0
    x = x.withColumn("new", F.when(some, F.transform("m", lambda m: pseudonym(m, k))))
    x = x.withColumn("new", F.when(some, F.zip_with("m", "new", lambda m, p: F.struct(F.when(p["value"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["value"], m).alias("value")))))
    gaps = F.split("t", ANY, -1)
    pairs = F.zip_with(gaps, "new", lambda g, p: F.concat(g, F.coalesce(p["value"], F.lit(""))))
    found = F.coalesce(F.filter("new", lambda p: p["kind"].isNotNull()), F.array().cast("array<struct<kind:string,value:string>>"))
    x = x.select("row", F.when(some, F.array_join(pairs, "")).otherwise(F.col("t")).alias("t"), found.alias("found"))
    return x.select(*[F.col("t").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c != "found"], "found")


def digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_found, kinds (sorted, distinct, joined by commas), text."""
    x = protect(docs.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda p: p["kind"]))), ",")
    return x.select("doc_id", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"), "text")
