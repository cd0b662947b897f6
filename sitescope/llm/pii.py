"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Numbers and dates are validated (Luhn digit, octets, calendar, number plans) and
mapped by a keyed Feistel permutation of exactly the valid values of their format: a
card becomes another valid card, a date another date. The rounds add a keyed hash of
one half to the other, alternately, in the residue rings of the two halves, so no
value is met twice and none leaves the format. Equal values get equal pseudonyms in
all documents. Addresses of mail and credentials, which are no numbers, get keyed
hashes of their kind.

A text is cut at its matches once; cards are sought in whole runs of digit groups. A null text stays null, an empty one empty, and a
match that does not validate is left as it stands. Repeated rows are treated alike.
"""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Dates that are permuted: all 17 * 4297 days of the years 1900 to 2099.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
YEARS = (1900, 200)
#: The setting that holds the key; Spark redacts settings of such names.
KEY_SETTING = "spark.sitescope.pseudonym.secret"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
KEY_ID = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9_/+-]{8,}\"?"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9]|[.-][0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])|(?<![0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9]| [0-9]))"
#: Country, check digits and 11 to 30 letters and digits, together or in groups of four.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
#: Three, three and four digits with or without a one, and up to 15 digits behind a plus; any digits.
#: The second form ends before a date or an address of another kind.
LOCAL_PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
PHONE = rf"{LOCAL_PHONE}|(?<![0-9A-Za-z+/])\+[0-9](?:(?![ .-](?:{DATE}|{ADDRESS}))[ .()/-]{{0,2}}[0-9]){{6,14}}(?![0-9])"
#: A whole run of at least 13 digits with single blanks or dashes between; it ends before a value of another kind.
#: The cards are sought in it.
CARD = rf"(?<![0-9])[0-9](?:(?![ -](?:{DATE}|{ADDRESS}|{SOCIAL}|{LOCAL_PHONE}))[ -]?[0-9]){{12,}}+"
#: How cards are usually written.
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
KINDS = {"email": EMAIL, "key_id": KEY_ID, "secret": SECRET, "iban": IBAN, "date": DATE, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())


def _hash(key: Column | str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), *[p.cast("string") for p in parts]), 256)


def permuted(left: Column, right: Column, a, b, key, kind: str) -> Column:
    """(l, r): the keyed permutation of ``left`` < ``a`` and ``right`` < ``b``, as a struct of longs."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def step(pair, i):
        def noise(half):
            return F.conv(F.substring(_hash(key, F.lit(kind), a, b, i, half), 1, 13), 16, 10).cast("long")

        even = i % 2 == 0
        return F.struct(
            F.when(even, (pair.l + noise(pair.r)) % a).otherwise(pair.l).alias("l"),
            F.when(even, pair.r).otherwise((pair.r + noise(pair.l)) % b).alias("r"),
        )

    first = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), first, step)


def _then(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _padded(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _refilled(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced, one after the other."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def put(state, c):
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(state.s, F.when(digit, F.substring(digits, state.k, F.lit(1))).otherwise(c)).alias("s"),
            (state.k + digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(match, ""), start, put, lambda state: state.s)


def _doubled(payload: Column) -> Column:
    """Luhn sum of the digits before a check digit."""
    n = F.length(payload)
    places = F.sequence(F.lit(1), n)

    def add(total, i):
        d = F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(places, F.lit(0), add)


def _check_digit(payload: Column) -> Column:
    return ((10 - _doubled(payload) % 10) % 10).cast("string")


def _card(m: Column, key) -> Column:
    def swap(d):
        n = F.length(d)
        body = F.substring(d, F.lit(2), n - 2)
        half = F.floor((n - 2) / 2).cast("int")
        width = n - 2 - half
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = permuted(F.substring(body, F.lit(1), half), F.substring(body, half + 1, width), ten(half), ten(width), key, "card")
        payload = _then(pair, lambda p: F.concat(F.substring(d, 1, 1), _padded(p.l, half), _padded(p.r, width)))
        return _refilled(m, _then(payload, lambda x: F.concat(x, _check_digit(x))))

    return _then(_digits(m), swap)


def _valid_card(t: Column) -> Column:
    d = _digits(t)
    return F.length(d).between(13, 19) & _then(d, lambda x: F.substring(x, -1, 1) == _check_digit(F.substring(x, F.lit(1), F.length(x) - 1)))


def _cards(m: Column, key) -> Column:
    """(text, cards) of a run: from left to right the sub-runs between separators that validate.

    One in a usual grouping goes before all others that overlap it, then the longest.
    """

    def from_group(groups, i):
        text = lambda k: F.regexp_replace(F.array_join(F.slice(groups, i, k), ""), "^[ -]", "")
        counts = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1))
        made = F.transform(counts, lambda k: _then(text(k), lambda t: F.struct(t.rlike(USUAL).alias("usual"), k.alias("k"), t.alias("t"))))
        return F.filter(made, lambda c: _valid_card(c.t))

    def listed(match, new):
        return F.struct(F.lit("card").alias("kind"), match.alias("match"), new.alias("pseudonym"))

    def read(x):
        none = F.array().cast("array<struct<kind:string,match:string,pseudonym:string>>")
        at = lambda free, text, cards: F.struct(free.alias("free"), text.alias("text"), cards.alias("cards"))

        def step(state, i):
            group = F.element_at(x.groups, i)
            free = F.filter(F.element_at(x.found, i), lambda c: c.usual | ~F.exists(F.slice(x.usual, i + 1, c.k - 1), lambda u: u))

            def put(c):
                plain = at(i + 1, F.concat(state.text, group), state.cards)
                lead = F.regexp_extract(group, "^[ -]?", 0)
                card = _then(
                    _card(c.t, key),
                    lambda new: at(i + c.k, F.concat(state.text, lead, new), F.concat(state.cards, F.array(listed(c.t, new)))),
                )
                return F.when(c.isNull(), plain).otherwise(card)

            return F.when(i < state.free, state).otherwise(_then(F.array_max(free), put))

        start = at(F.lit(1), F.lit(""), none)
        return F.aggregate(F.sequence(F.lit(1), F.size(x.groups)), start, step, lambda state: F.struct(state.text.alias("text"), state.cards.alias("cards")))

    groups = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    found = _then(groups, lambda g: F.struct(g.alias("groups"), F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: from_group(g, i)).alias("found")))
    marked = _then(found, lambda x: F.struct(x.groups.alias("groups"), x.found.alias("found"), F.transform(x.found, lambda cs: F.exists(cs, lambda c: c.usual)).alias("usual")))
    return _then(marked, read)


#: Country codes; none begins another.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key) -> Column:
    """Numbers of the North American plan stay in it, other ten digits stay out of it; other countries keep their code."""

    def ten_digits(d):
        area, middle = F.substring(d, -10, 3).cast("long"), F.substring(d, -7, 3).cast("long")
        line = F.substring(d, -4, 4).cast("long")
        rest = middle * 10000 + line
        inside = permuted(area - 200, rest - 2_000_000, 800, 8_000_000, key, "phone")
        valid = _then(inside, lambda p: F.concat((p.l + 200).cast("string"), (p.r + 2_000_000).cast("string")))
        # The 3.6 billion others in a row: areas below 200, then exchanges below 200.
        place = F.when(area < 200, area * 10_000_000 + rest).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + rest)
        outside = _then(place, lambda x: permuted(F.floor(x / 60_000), x % 60_000, 60_000, 60_000, key, "phone_other"))
        other = _then(
            _then(outside, lambda p: p.l * 60_000 + p.r),
            lambda x: F.when(x < 2_000_000_000, _padded(x, 10)).otherwise(
                F.concat((F.floor((x - 2_000_000_000) / 2_000_000) + 200).cast("string"), _padded((x - 2_000_000_000) % 2_000_000, 7))
            ),
        )
        return F.when((area >= 200) & (middle >= 200), valid).otherwise(other)

    def foreign(d, country):
        n = F.length(d) - F.length(country)
        half = F.floor(n / 2).cast("int")
        number = F.substring(d, F.length(country) + 1, n)
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = permuted(F.substring(number, F.lit(1), half), F.substring(number, half + 1, n - half), ten(half), ten(n - half), key, "phone_abroad")
        return _then(pair, lambda p: F.concat(country, _padded(p.l, half), _padded(p.r, n - half)))

    def swap(d):
        lead = F.when(F.length(d) == 11, F.lit("1")).otherwise("")
        home = ~m.startswith("+") | d.rlike("^1[0-9]{10}$")
        return F.when(home, F.concat(lead, ten_digits(d))).otherwise(_then(F.regexp_extract(d, _COUNTRY, 0), lambda c: foreign(d, c)))

    # The (0) of a number that is also given with its country code is not part of it.
    bare = F.when(m.startswith("+"), F.replace(m, F.lit("(0)"), F.lit("(#)"))).otherwise(m)
    return F.replace(_then(_digits(bare), lambda d: _refilled(bare, _then(d, swap))), F.lit("(#)"), F.lit("(0)"))


def _social(m: Column, key) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = permuted(area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "social")

    def shown(p):
        number = p.l + 1
        rest = p.r
        between = F.substring(m, 4, 1)
        return F.concat(
            _padded(number + (number >= 666).cast("long"), 3), between, _padded(F.floor(rest / 9999) + 1, 2), between, _padded(rest % 9999 + 1, 4)
        )

    return F.when(valid, _then(pair, shown)).otherwise(m)


def _address(m: Column, key) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def swap(o):
        at = lambda i: F.element_at(o, i)
        pair = permuted(at(1) * 256 + at(2), at(3) * 256 + at(4), 65536, 65536, key, "address")
        parts = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
        new = _then(pair, lambda p: F.concat_ws(".", *parts(p.l), *parts(p.r)))
        return F.when(F.array_max(o) < 256, new).otherwise(m)

    return _then(octets, swap)


def _date(m: Column, key) -> Column:
    a, b = DAYS

    def moved(layout):
        def swap(d):
            pair = permuted(F.floor(d / b), d % b, a, b, key, "date")
            new = _then(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p.l * b + p.r).cast("int")), layout))
            return F.when((d >= 0) & (d < a * b), new).otherwise(m)

        return swap

    out = F.when(m.rlike("^(?:1[3-9]|[23][0-9])/(?:0[1-9]|1[0-2])/"), _day_first(m, key)).otherwise(m)
    layouts = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^(?:0[1-9]|1[0-2])/", "MM/dd/yyyy"))
    for form, layout in layouts:
        day = F.datediff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        out = F.when(m.rlike(form), _then(day, moved(layout))).otherwise(out)
    return out


def _day_first(m: Column, key) -> Column:
    """Dates as 25/12/1999 whose day is no month; they change places with such dates only, so all texts stay distinct.

    Days 13 to 28 move with month and year. Later days keep their number, as not every month has them.
    """
    day, month, year = (F.substring(m, i, n).cast("long") for i, n in ((1, 2), (4, 2), (7, 4)))
    first, years = YEARS
    shown = lambda d, mo, y: F.concat_ws("/", _padded(d, 2), _padded(mo, 2), y.cast("string"))

    def among(months):
        listed = F.array(*[F.lit(x).cast("long") for x in months])
        pair = permuted(F.array_position(listed, month) - 1, year - first, len(months), years, key, f"date_{len(months)}")
        return _then(pair, lambda p: shown(day, F.get(listed, p.l.cast("int")), p.r + first))

    early = permuted((day - 13) * 12 + month - 1, year - first, 16 * 12, years, key, "date_first")
    early = _then(early, lambda p: shown(F.floor(p.l / 12) + 13, p.l % 12 + 1, p.r + first))
    leap = F.floor((year - first - 4) / 4)  # 49 leap years from 1904 to 2096
    leap = _then(permuted(F.floor(leap / 7), leap % 7, 7, 7, key, "date_leap"), lambda p: shown(day, month, (p.l * 7 + p.r) * 4 + first + 4))
    valid = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull()
    later = F.when(month == 2, leap).when(day == 31, among([1, 3, 5, 7, 8, 10, 12])).otherwise(among([1, *range(3, 13)]))
    return F.when(valid, F.when(day <= 28, early).otherwise(later)).otherwise(m)


def _rest_97(text: Column) -> Column:
    """The number that letters (A is 10) and digits write, modulo 97."""

    def add(rest, c):
        value = F.ascii(c) - 48
        return F.when(value < 10, (rest * 10 + value) % 97).otherwise((rest * 100 + value - 7) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(m: Column, key) -> Column:
    """Country, letters and the length stay; digits behind the check digits are permuted, and those computed anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def swap(x):
        country, body = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        numbers = _digits(body)
        half = F.floor(F.length(numbers) / 2).cast("int")
        width = F.length(numbers) - half
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = permuted(F.substring(numbers, F.lit(1), half), F.substring(numbers, half + 1, width), ten(half), ten(width), key, "iban")
        made = _then(pair, lambda p: _refilled(body, F.concat(_padded(p.l, half), _padded(p.r, width))))
        whole = _then(made, lambda b: F.concat(country, _padded(98 - _rest_97(F.concat(b, country, F.lit("00"))), 2), b))
        spaced = _then(whole, lambda w: F.when(m.contains(" "), F.trim(F.regexp_replace(w, "(.{4})", "$1 "))).otherwise(w))
        valid = (_rest_97(F.concat(body, F.substring(x, 1, 4))) == 1) & (F.length(numbers) >= 4)
        return F.when(valid, spaced).otherwise(m)

    return _then(plain, swap)


def _email(m: Column, key) -> Column:
    return F.concat(F.lit("u"), F.substring(_hash(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@mail.invalid"))


def _key_id(m: Column, key) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(_hash(key, F.lit("key_id"), m), 1, 16)))


def _secret(m: Column, key) -> Column:
    lead = F.regexp_extract(m, r"^[A-Za-z_]+\s?[=:]\s?\"?", 0)
    tail = F.when(m.endswith('"'), F.lit('"')).otherwise("")
    value = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(tail))
    hashed = F.repeat(_hash(key, F.lit("secret"), value), F.ceil(F.length(value) / 64).cast("int"))
    return F.concat(lead, F.substring(hashed, F.lit(1), F.length(value)), tail)


_SWAPS = {"email": _email, "key_id": _key_id, "secret": _secret, "iban": _iban, "date": _date, "address": _address, "social": _social, "phone": _phone}


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _swapped(m: Column, kind: Column, key) -> Column:
    out = m
    for name in reversed(_SWAPS):
        out = F.when(kind == name, _SWAPS[name](m, key)).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting; where it is unset, a random one that the session keeps.

    So a run links equal values, and runs that shall be linked with one another name the same key.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(frame: DataFrame, key: str, text: str = "text", out: str = "text", found: str = "pii") -> DataFrame:
    """``frame`` with pseudonyms in ``out`` and ``found``: an array of (kind, match, pseudonym) in order.

    Columns named ``out`` or ``found`` are replaced. Only matches whose pseudonym
    stands for them are listed; what does not validate is left in the text. The key is a
    table of one row that the expressions look up, so no plan shows it.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = frame.sparkSession.createDataFrame(pa.table({"key": [key]})).scalar()
    names = []
    for base in ("_key", "_rows", "_new"):
        while base in frame.columns or base in (out, found):
            base += "_"
        names.append(base)
    key_, rows_, new_ = names
    frame, key = frame.withColumn(key_, secret), F.col(key_)
    raw = F.when(F.col(text).rlike("[0-9@=:]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    matches = F.coalesce(raw, F.array().cast("array<string>"))

    def single(m, k):
        row = lambda new: F.struct(k.alias("kind"), m.alias("match"), new.alias("pseudonym"))
        return _then(_swapped(m, k, key), lambda new: F.struct(new.alias("text"), F.array(row(new)).alias("listed")))

    def row(m):
        run = lambda: _then(_cards(m, key), lambda c: F.struct(c.text.alias("text"), c.cards.alias("listed")))
        return _then(_kind(m), lambda k: F.when(k == "card", run()).otherwise(single(m, k)))

    rows = frame.withColumn(rows_, F.transform(matches, row))
    new = F.array_join(
        F.zip_with(
            F.split(F.col(text), ANY, -1),
            F.transform(rows_, lambda r: r.text),
            lambda piece, name: F.concat(piece, F.coalesce(name, F.lit(""))),
        ),
        "",
    )
    rows = rows.withColumn(new_, F.when(F.size(rows_) > 0, new).otherwise(F.col(text)))
    listed = F.filter(F.flatten(F.transform(rows_, lambda r: r.listed)), lambda r: r.pseudonym != r.match)
    return rows.withColumns({found: listed, out: F.col(new_)}).drop(*names)


def private_data(documents: DataFrame, key: str) -> DataFrame:
    """One row per document: its whole text with pseudonyms and the number found of each kind."""
    done = pseudonymise(documents.select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii", lambda r: r.kind == kind)).cast("long")
    return done.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in KINDS])


def protect(documents: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts; ``n_chars`` follows a changed text."""
    columns = documents.columns
    rows = documents.select(F.struct("*").alias("row"), "text")
    done = pseudonymise(rows, key)
    values = {c: F.col("row")[c] for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        values["n_chars"] = F.when(F.size("pii") > 0, F.length("text").cast(kind)).otherwise(F.col("row")["n_chars"])
    return done.select(*[v.alias(c) for c, v in values.items()])
