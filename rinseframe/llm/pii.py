"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Card, phone and social security numbers, addresses (IPv4 and e-mail) and dates are found, validated, and permuted
within their own format by a keyed Feistel network: a valid number becomes another valid number, and equal values
become equal pseudonyms in every document, so that they stay linked. Each permutation is one-to-one: the values of a
format are split into a left part of A and a right part of B values, and rounds add a keyed digest of one part to the
other, modulo A and modulo B in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "date", "ip", "ssn", "card", "phone")
ROUNDS = 8

# The forms in which the kinds are written.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_YEAR_FIRST, _YEAR_LAST = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Cards as they are mostly written, and as longer and shorter ones are.
_USUAL = r"[0-9]{4}[ -](?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{6}[ -][0-9]{4,5})"
_CARD_FORMS = (
    r"^(?:[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5}))$",
    r"^[0-9]{4}([ -])(?:[0-9]{4}\1){2}(?:[0-9]{4}\1)?[0-9]{1,3}$",
    r"^[0-9]+(?:(?:-[0-9]+)*|(?: [0-9]+)*)$",
)
_NANP = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_NANP_PLAIN = r"\+1[0-9]{10}"
_ABROAD = rf"\+[2-9][0-9](?:(?:[ .-](?!{_USUAL}(?![0-9])))?\(?[0-9]\)?){{6,12}}"
_FORMED = (
    f"{_EMAIL}|(?<![0-9.])(?:{_IP})(?![0-9]|\\.[0-9])|(?<![0-9./-])(?:{_YEAR_FIRST}|{_YEAR_LAST})(?![0-9]|[./-][0-9])"
    f"|(?<![0-9-])(?:{_SSN})(?![0-9]|-[0-9])|(?<![0-9])(?:{_NANP}|{_NANP_PLAIN}|{_ABROAD})(?![0-9])"
)
#: Groups of digits with single blanks or hyphens between them, up to where another kind begins.
_RUN = f"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_FORMED})[0-9]++)*+"
_CANDIDATE = f"{_FORMED}|{_RUN}"
LEAST_CARD, MOST_CARD = 13, 19
#: Dates from 1800 to 2199 make one cycle of the calendar of 4,800 months. Days up to the 12th (240 * 240 of them) and
#: later ones (9 * 9,833) are permuted among themselves, so that what can only be read as month first stays so.
_FIRST_YEAR, _FIRST_DAY, _LAST_DAY, _MONTHS, _EARLY = 1800, "1800-01-01", "2199-12-31", 4800, 12
_EARLY_SIDE, _LATE_LEFT, _LATE_RIGHT = 240, 9, 9833


def _digest(key: str, kind: str | Column, turn: Column, value: Column) -> Column:
    """60 bits of a keyed digest as a long."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def _permuted(key: str, kind: str | Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): the permutation of (left, right) in [0, a) x [0, b)."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + F.pmod(_digest(key, kind, i, acc["r"]), a)) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + F.pmod(_digest(key, kind, i, acc["l"]), b)) % b).alias("r"),
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pad(value: Column, width: Column | int) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _part(x: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (F.lit(v) if isinstance(v, int) else v for v in (start, length))
    return F.substr(x, start, length)


def _number(x: Column, start: Column | int, length: Column | int) -> Column:
    """A run of digits as a long, 0 where there is none."""
    return F.coalesce(_part(x, start, length).try_cast("bigint"), F.lit(0).cast("bigint"))


def _refill(x: Column, digits: Column) -> Column:
    """The digits of x, from the last one on, replaced by those given; what stands between and before stays."""

    def put(acc: Column, c: Column) -> Column:
        takes = c.rlike("[0-9]") & (acc["left"] > 0)
        return F.struct(
            F.concat(F.when(takes, _part(digits, acc["left"], 1)).otherwise(c), acc["out"]).alias("out"),
            (acc["left"] - F.when(takes, 1).otherwise(0)).alias("left"),
        )

    start = F.struct(F.lit("").alias("out"), F.length(digits).alias("left"))
    return F.aggregate(F.reverse(F.split(x, "")), start, put, lambda acc: acc["out"])


def _halved(key: str, kind: str | Column, digits: Column) -> Column:
    """A permutation of all strings of so many digits."""

    def made(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        out = _permuted(key, F.concat(F.lit(kind) if isinstance(kind, str) else kind, n.cast("string")), _number(d, 1, h), _number(d, h + 1, n - h), _power(h), _power(n - h))
        return _let(out, lambda p: F.concat(_pad(p["l"], h), _pad(p["r"], n - h)))

    return _let(digits, made)


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled, starting with the last but one."""

    def add(total: Column, i: Column) -> Column:
        d = _part(digits, F.length(digits) - i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(key: str, x: Column) -> Column:
    """First digit and length stay, the check digit is made anew."""

    def made(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(_part(d, 1, 1), _halved(key, F.concat(F.lit("card"), _part(d, 1, 1)), _part(d, 2, n - 2)))
        return _let(body, lambda c: F.concat(c, ((10 - luhn_sum(F.concat(c, F.lit("0"))) % 10) % 10).cast("string")))

    return _refill(x, _let(_digits(x), made))


def _cards(key: str, x: Column) -> Column:
    """struct(out, n): a run of groups with its cards replaced, and their number.

    A card is a stretch of whole groups of 13 to 19 digits with a right check digit. Of those that begin with a group the
    one of the most usual form counts, then the longest; it gives way to one of a more usual form that it overlaps.
    """

    def stretch(tokens: Column, i: Column, k: Column) -> Column:
        written = F.regexp_replace(F.array_join(F.slice(tokens, i + 1, k), ""), "[ -]$", "")
        form = F.lit(len(_CARD_FORMS))
        for at, pattern in reversed([*enumerate(_CARD_FORMS)]):
            form = F.when(written.rlike(pattern), at).otherwise(form)
        return F.struct(form.alias("form"), (-k).alias("k"), written.alias("card"))

    def valid(w: Column) -> Column:
        return _let(_digits(w["card"]), lambda d: F.length(d).between(LEAST_CARD, MOST_CARD) & (luhn_sum(d) % 10 == 0))

    def best(tokens: Column) -> Column:
        def at(i: Column) -> Column:
            lengths = F.sequence(F.lit(1), F.least(F.lit(MOST_CARD), F.size(tokens) - i))
            return F.array_min(F.filter(F.transform(lengths, lambda k: stretch(tokens, i, k)), valid))

        return F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), at)

    def made(tokens: Column) -> Column:
        def replaced(found: Column) -> Column:
            def put(acc: Column, i: Column) -> Column:
                w = F.get(found, i)
                inner = F.slice(found, i + 2, F.greatest(-w["k"] - 1, F.lit(0)))
                takes = w.isNotNull() & ~F.coalesce(F.exists(inner, lambda o: o.isNotNull() & (o["form"] < w["form"])), F.lit(False))
                token = F.get(tokens, i)
                card = F.concat(_card(key, w["card"]), F.regexp_extract(F.get(tokens, i - w["k"] - 1), "[ -]$", 0))
                return (
                    F.when(i < acc["end"], acc)
                    .when(takes, F.struct(F.concat(acc["out"], card).alias("out"), (acc["n"] + 1).alias("n"), (i - w["k"]).alias("end")))
                    .otherwise(F.struct(F.concat(acc["out"], token).alias("out"), acc["n"].alias("n"), acc["end"].alias("end")))
                )

            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, put)

        return _let(best(tokens), replaced)

    return _let(F.regexp_extract_all(x, F.lit("[0-9]+[ -]?"), F.lit(0)), made)


def _nanp(key: str, x: Column) -> Column:
    """Ten digits; whether area and exchange begin with 0 or 1 stays."""

    def made(d: Column) -> Column:
        area, rest = _number(d, 1, 3), _number(d, 4, 7)
        a, b = F.when(area < 200, 0).otherwise(200), F.when(rest < 2_000_000, 0).otherwise(2_000_000)
        kind = F.when((a > 0) & (b > 0), "nanp").otherwise(F.concat_ws(".", F.lit("nanp"), a.cast("string"), b.cast("string")))
        out = _permuted(key, kind, area - a, rest - b, F.when(a > 0, 800).otherwise(200), F.when(b > 0, 8_000_000).otherwise(2_000_000))
        return _let(out, lambda p: F.concat(_pad(p["l"] + a, 3), _pad(p["r"] + b, 7)))

    return _refill(x, _let(F.right(_digits(x), F.lit(10)), made))


def _abroad(key: str, x: Column) -> Column:
    """The two digits after the plus sign stay."""
    return _refill(x, _let(_digits(x), lambda d: _halved(key, F.concat(F.lit("abroad"), _part(d, 1, 2)), _part(d, 3, F.length(d) - 2))))


def _ssn(key: str, x: Column) -> Column:
    def made(d: Column) -> Column:
        area = _number(d, 1, 3)
        left = F.when(area < 666, area - 1).otherwise(area - 2)
        right = (_number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1
        out = _permuted(key, "ssn", left, right, F.lit(898), F.lit(99 * 9999))
        area_of = lambda l: F.when(l < 665, l + 1).otherwise(l + 2)  # noqa: E731, E741
        return _let(out, lambda p: F.concat(_pad(area_of(p["l"]), 3), F.lit("-"), _pad(F.floor(p["r"] / 9999) + 1, 2), F.lit("-"), _pad(p["r"] % 9999 + 1, 4)))

    return _let(_digits(x), made)


def _ip(key: str, x: Column) -> Column:
    def made(p: Column) -> Column:
        pair = lambda i: F.get(p, F.lit(i)).cast("bigint") * 256 + F.get(p, F.lit(i + 1)).cast("bigint")
        out = _permuted(key, "ip", pair(0), pair(2), F.lit(65536), F.lit(65536))
        return _let(out, lambda q: F.concat_ws(".", *(v.cast("bigint").cast("string") for side in ("l", "r") for v in (F.floor(q[side] / 256), q[side] % 256))))

    return _let(F.split(x, r"\."), made)


def _read(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, _pad(month, 2), _pad(day, 2)).try_cast("date")


def _as_date(x: Column) -> Column:
    """struct(date, month_first): year first, else day first, else month first where only that is a date."""

    def made(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        day_first = F.when(F.length(a) == 4, _read(a, b, c)).otherwise(_read(c, b, a))
        month_first = F.when(F.length(a) < 4, _read(c, a, b))
        return F.struct(F.coalesce(day_first, month_first).alias("date"), day_first.isNull().alias("month_first"))

    return _let(F.split(x, "[./-]"), made)


def _month_start(month: Column) -> Column:
    return F.make_date((F.floor(month / 12) + _FIRST_YEAR).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


def _late_before(month: Column) -> Column:
    """Days after the 12th in the months before."""
    return F.datediff(_month_start(month), F.lit(_FIRST_DAY).cast("date")) - _EARLY * month


def _date(key: str, x: Column) -> Column:
    def early(month: Column, day: Column) -> Column:
        at, side = month * _EARLY + day - 1, F.lit(_EARLY_SIDE)
        out = _permuted(key, "date", F.floor(at / _EARLY_SIDE), at % _EARLY_SIDE, side, side)
        return _let(_let(out, lambda p: p["l"] * _EARLY_SIDE + p["r"]), lambda k: F.date_add(_month_start(F.floor(k / _EARLY)), (k % _EARLY).cast("int")))

    def late(month: Column, day: Column) -> Column:
        at = _late_before(month) + day - 1 - _EARLY
        out = _permuted(key, "date.late", F.floor(at / _LATE_RIGHT), at % _LATE_RIGHT, F.lit(_LATE_LEFT), F.lit(_LATE_RIGHT))

        def day_of(k: Column) -> Column:
            near = F.floor(k * _MONTHS / (_LATE_LEFT * _LATE_RIGHT)).cast("int")  # true to a month or two
            months = F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(_MONTHS - 1)))
            month = F.array_max(F.filter(months, lambda m: _late_before(m) <= k))
            return _let(month, lambda m: F.date_add(_month_start(m), (k - _late_before(m) + _EARLY).cast("int")))

        return _let(_let(out, lambda p: p["l"] * _LATE_RIGHT + p["r"]), day_of)

    def made(old: Column) -> Column:
        month, day = (F.year(old["date"]) - _FIRST_YEAR) * 12 + F.month(old["date"]) - 1, F.dayofmonth(old["date"])
        new = F.when(day <= _EARLY, early(month, day)).otherwise(late(month, day))
        return _let(new, lambda d: written(d, old["month_first"]))

    def written(d: Column, month_first: Column) -> Column:
        short = x.rlike("(?<![0-9])[0-9](?![0-9])")
        year, month, day = (F.date_format(d, form) for form in ("yyyy", "MM", "dd"))
        month, day = (F.when(short, F.regexp_replace(v, "^0", "")).otherwise(v) for v in (month, day))
        between = F.regexp_replace(x, "[0-9]", "")
        one, two = _part(between, 1, 1), _part(between, 2, 1)
        year_last = F.when(month_first, F.concat(month, one, day, two, year)).otherwise(F.concat(day, one, month, two, year))
        return F.when(x.rlike("^[0-9]{4}"), F.concat(year, one, month, two, day)).otherwise(year_last)

    return _let(_as_date(x), made)


def _shifted(key: str, turn: int, half: Column, other: Column) -> Column:
    """Every letter and digit of a half moved within its alphabet by a keyed digest of the other half and its place."""

    def moved(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        by = _digest(key, "email", F.concat_ws(".", F.lit(turn).cast("string"), i.cast("string")), other)
        turned = lambda first, size: F.chr((code - first + F.pmod(by, F.lit(size))) % size + first)
        return F.when(c.rlike("[a-z]"), turned(97, 26)).when(c.rlike("[A-Z]"), turned(65, 26)).when(c.rlike("[0-9]"), turned(48, 10)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), moved), "")


def _left_turn(key: str, turn: int) -> Callable[[Column], Column]:
    return lambda p: F.struct(_shifted(key, turn, p["l"], p["r"]).alias("l"), p["r"].alias("r"))


def _right_turn(key: str, turn: int) -> Callable[[Column], Column]:
    return lambda p: F.struct(p["l"].alias("l"), _shifted(key, turn, p["r"], p["l"]).alias("r"))


def _email(key: str, x: Column) -> Column:
    """Letters and digits of the part before the @ change within their alphabets; the domain stays."""
    local = F.substring_index(x, "@", 1)

    def made(s: Column) -> Column:
        h = F.floor(F.length(s) / 2).cast("int")
        halves = F.struct(_part(s, 1, h).alias("l"), _part(s, h + 1, F.length(s) - h).alias("r"))
        for turn in range(4):
            halves = _let(halves, _left_turn(key, turn) if turn % 2 == 0 else _right_turn(key, turn))
        return _let(halves, lambda p: F.concat(p["l"], p["r"]))

    return F.concat(_let(local, made), F.lit("@"), F.substring_index(x, "@", -1))


def _kind(x: Column) -> Column:
    """What a candidate is, null if it is not valid; ``card`` is a run of digits that may hold cards."""
    octets = F.forall(F.split(x, r"\."), lambda o: o.cast("int") < 256)
    dated = _as_date(x)["date"].between(F.lit(_FIRST_DAY).cast("date"), F.lit(_LAST_DAY).cast("date"))
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike(f"^(?:{_IP})$"), F.when(octets, "ip"))
        .when(x.rlike(f"^(?:{_YEAR_FIRST}|{_YEAR_LAST})$"), F.when(dated, "date"))
        .when(x.rlike(f"^(?:{_SSN})$"), F.when(~x.rlike("^(?:000|666|9..)|-00-|-0000$"), "ssn"))
        .when(x.rlike(f"^(?:{_NANP}|{_NANP_PLAIN}|{_ABROAD})$"), "phone")
        .otherwise("card")
    )


def _pseudonym(key: str, x: Column) -> Column:
    """struct(kind, value, n): what takes the place of a candidate, and for how many values."""
    abroad = x.rlike(r"^\+[2-9]")
    new = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn}

    def made(kind: Column) -> Column:
        value = F.when(kind == "phone", F.when(abroad, _abroad(key, x)).otherwise(_nanp(key, x)))
        for name, make in new.items():
            value = value.when(kind == name, make(key, x))
        one = F.struct(kind.alias("kind"), value.otherwise(x).alias("value"), F.lit(1).alias("n"))
        run = _let(_cards(key, x), lambda r: F.struct(F.when(r["n"] > 0, "card").alias("kind"), r["out"].alias("value"), r["n"].alias("n")))
        return F.when(kind == "card", run).otherwise(one)

    return _let(_kind(x), made)


def pseudonymize(docs: DataFrame, key: str, *, text: str = "text", counts: bool = True) -> DataFrame:
    """The documents with every valid number, address and date in ``text`` replaced by its pseudonym under ``key``.

    With ``counts``, a column ``n_<kind>`` each for what was replaced (it takes the place of one of that name). Numbers
    that fail validation stay as they are. A null text stays null and counts nothing; other columns and the number
    and order of rows are untouched. No shuffle, no state: equal values give equal pseudonyms by the key alone.
    """
    has = F.col(text).rlike("[0-9@]")
    found, kinds = "__found", "__kinds"
    none = "array<struct<kind:string,value:string,n:int>>"
    names = docs.columns
    looked = docs.withColumn(found, F.when(has, F.transform(F.regexp_extract_all(F.col(text), F.lit(_CANDIDATE), F.lit(0)), lambda x: _pseudonym(key, x))).otherwise(F.array().cast(none)))
    gaps = F.split(F.col(text), _CANDIDATE, -1)
    pieces = F.zip_with(gaps, F.col(f"{found}.value"), lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    new = F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    out = looked.withColumns({text: new, kinds: F.col(found)})
    made = [F.coalesce(F.aggregate(F.filter(kinds, _is(kind)), F.lit(0), lambda total, k: total + k["n"]), F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in KINDS] if counts else []
    taken = {f"n_{kind}" for kind in KINDS} if counts else set()
    return out.select(*(F.col(f"`{name}`") for name in names if name not in taken), *made)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k["kind"] == F.lit(kind)
