"""Dates, money, hashes and JSON as column expressions: what cannot be read is null, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese numerals in sums of money.
CAPITAL_DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CAPITAL_UNITS = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000}


def parse_instant(c: Column) -> Column:
    """An ISO date, or date and time, with or without a zone; other text is null. Without a zone: the session's."""
    s = F.trim(c)
    sound = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(sound, F.try_to_timestamp(F.regexp_replace(s, r"\s+(Z|[+-])", "$1")))


def day_bounds(day: Column) -> Column:
    """struct(start, end) of a date, end not included, in the session's zone."""
    return F.struct(F.to_timestamp(day).alias("start"), F.to_timestamp(F.date_add(day, 1)).alias("end"))


def in_day(ts: Column, day: Column) -> Column:
    return (ts >= F.to_timestamp(day)) & (ts < F.to_timestamp(F.date_add(day, 1)))


def iso_week(c: Column) -> Column:
    """The ISO week as 2026-W34."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def week_start(key: Column) -> Column:
    """The Monday of an ISO week key."""
    jan4 = F.make_date(F.left(key, F.lit(4)).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.weekday(jan4)), 7 * (F.right(key, F.lit(2)).cast("int") - 1))


def previous_week(day: Column) -> Column:
    """struct(start, end) of the calendar week before that of the day."""
    start = F.date_sub(F.date_sub(day, F.weekday(day)), 7)
    return F.struct(start.alias("start"), F.date_add(start, 6).alias("end"))


def normalise_date(c: Column) -> Column:
    """A date in one of five forms; a bare month is its first day."""
    s = F.trim(c)
    forms = [
        ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{4}/\\d{1,2}/\\d{1,2}$", "yyyy/M/d"),
        ("^\\d{4}\\.\\d{1,2}\\.\\d{1,2}$", "yyyy.M.d"), ("^\\d{4}年\\d{1,2}月\\d{1,2}日$", "yyyy年M月d日"), ("^\\d{4}年\\d{1,2}月$", "yyyy年M月"),
    ]
    return F.coalesce(*[F.when(s.rlike(p), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for p, f in forms])


def first_date(c: Column) -> Column:
    """The first date anywhere in a text."""
    at = lambda g: F.regexp_extract(c, r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", g)
    return F.when(at(1) != "", F.to_date(F.try_to_timestamp(F.concat_ws("-", at(1), F.lpad(at(2), 2, "0"), F.lpad(at(3), 2, "0")), F.lit("yyyy-MM-dd"))))


def url_date(c: Column) -> Column:
    """A date that an address holds as /2026/08/17/, /20260817 or 2026-08-17."""
    for_ = lambda p: F.when(F.regexp_extract(c, p, 1) != "", F.concat_ws("-", *[F.regexp_extract(c, p, k) for k in (1, 2, 3)]))
    return F.to_date(F.try_to_timestamp(F.coalesce(for_(r"(20\d{2})[-/](\d{2})[-/](\d{2})"), for_(r"(20\d{2})([01]\d)([0-3]\d)")), F.lit("yyyy-MM-dd")))


def clock(c: Column) -> Column:
    """A time of day as HH:mm:ss where the text names one, else null."""
    at = lambda g: F.regexp_extract(c, r"(\d{1,2})[时:：](\d{2})(?:[分:：](\d{2}))?", g)
    return F.when(at(1) != "", F.concat_ws(":", F.lpad(at(1), 2, "0"), at(2), F.when(at(3) == "", "00").otherwise(at(3))))


def deadline_instant(c: Column) -> Column:
    """An instant where the text names both day and time."""
    return F.when(clock(c).isNotNull() & first_date(c).isNotNull(), F.try_to_timestamp(F.concat_ws(" ", first_date(c).cast("string"), clock(c))))


def excel_date(c: Column) -> Column:
    """A spreadsheet serial number as a date from 2000 to 2100, else null."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.bround(c.cast("double"), 0).cast("int"))
    return F.when(F.year(day).between(2000, 2100), day)


def normalise_amount(c: Column) -> Column:
    """A sum in yuan as decimal(24,4), with 万 and 亿 counted in; null where no number stands."""
    p = r"([0-9][0-9,]*(?:\.[0-9]{1,4})?)\s*(万元|元|万|亿|元整|圆)?"
    num, unit = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    factor = F.when(unit.isin("万", "万元"), 10_000).when(unit == "亿", 100_000_000).otherwise(1).cast("decimal(10,0)")
    return F.when(num != "", (F.replace(num, F.lit(","), F.lit("")).cast("decimal(20,4)") * factor).cast("decimal(24,4)"))


def capital_amount(c: Column) -> Column:
    """A sum written in Chinese numerals (壹佰贰拾叁万元整), by one fold over its characters; null if none stands."""
    s = F.regexp_extract(c, "([零壹贰叁肆伍陆柒捌玖一二两三四五六七八九拾十佰百仟千万亿]+)[元圆]", 1)
    digit = F.create_map(*[F.lit(x) for kv in CAPITAL_DIGITS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in CAPITAL_UNITS.items() for x in kv])
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("total", "part", "digit")])

    def step(a, x):
        d, u = F.try_element_at(digit, x), F.try_element_at(unit, x)
        big = F.when(x == "万", 10_000).when(x == "亿", 100_000_000)
        one = F.when((a["digit"] == 0) & (a["part"] == 0), 1).otherwise(a["digit"])
        part = a["part"] + a["digit"]
        total = F.when(x == "亿", (a["total"] + part) * 100_000_000).otherwise(a["total"] + part * big)
        put = lambda t, p, g: F.struct(t.cast("long").alias("total"), p.cast("long").alias("part"), g.cast("long").alias("digit"))
        zero = F.lit(0)
        return (
            F.when(d.isNotNull(), put(a["total"], a["part"], d)).when(u.isNotNull(), put(a["total"], a["part"] + one * u, zero))
            .when(big.isNotNull(), put(total, zero, zero)).otherwise(a)
        )

    return F.when(s != "", F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), start, step, lambda a: a["total"] + a["part"] + a["digit"]))


def first_number(c: Column) -> Column:
    """The first number of a text as double, else null."""
    found = F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def relative_gap(a: Column, b: Column, of_zeros: float = 0.0) -> Column:
    """|a - b| by the larger of both, null unless both are known; of_zeros for two zeros."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(top == 0, F.lit(of_zeros)).otherwise((F.abs(a - b) / top).cast("double")))


def content_hash(c: Column, length: int = 16) -> Column:
    """The start of a SHA-1 over the text without white space; '' for none."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{3000}\x{a0}]+", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.left(F.sha1(bare.cast("binary")), F.lit(length)))


def joined_hash(*parts: Column, length: int = 16) -> Column:
    """The start of a SHA-256 over parts joined by |, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(length))


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a struct's JSON, whose fields keep the order that the caller gives them."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}).cast("binary"), 256)


def field_state(payload: Column, path: str) -> Column:
    """struct(value, missing) of a field of a JSON text; an empty text, a null and a lack are all missing."""
    value = F.get_json_object(payload, path)
    return F.struct(F.nullif(F.trim(value), F.lit("")).alias("value"), (F.coalesce(F.trim(value), F.lit("")) == "").alias("missing"))


def overlay(base: Column, revision: Column) -> Column:
    """A map in which the revision's entries replace those of the base; either may be null."""
    empty = F.create_map().cast("map<string,string>")
    base, revision = F.coalesce(base, empty), F.coalesce(revision, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(revision, k)), revision)


def derive_value(kind: Column, quote: Column) -> Column:
    """The value that a quote states for a field of a kind, as text; null where it states none."""
    percent = F.regexp_extract(quote, r"(\d+(?:\.\d+)?)\s*[%％]", 1)
    days = F.regexp_extract(quote, r"(\d+)\s*(?:个)?(?:日历天|日历日|天|日)", 1)
    return (
        F.when(kind == "amount", normalise_amount(quote).cast("string")).when(kind == "percent", F.nullif(percent, F.lit("")))
        .when(kind == "duration", F.nullif(days, F.lit(""))).when(kind == "date", first_date(quote).cast("string"))
        .when(kind == "clause", F.nullif(F.trim(quote), F.lit("")))
    )


def quote_at(text: Column, quote: Column) -> Column:
    """struct(start, end) of a quote in a text, counted from 0; null where it does not stand there as it is."""
    at = F.position(quote, text)
    return F.when((at > 0) & (F.length(quote) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def round_trips(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether the text holds the quote at these places."""
    return F.coalesce(F.substr(text, start + 1, end - start) == quote, F.lit(False))


def keyword_places(tokens: Column, text: Column) -> Column:
    """Where each token first stands in the text, from 1; 0 where it does not."""
    return F.transform(tokens, lambda t: F.position(t, text))


def keyword_score(places: Column, length: Column) -> Column:
    """Tokens found by the root of the text's length, more for an early first hit; 0 for none.

    It takes the places as a column of their own, so that the text is searched once.
    """
    hits = F.size(F.filter(places, lambda p: p > 0))
    first = F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)) - 1, length)
    return F.when(hits <= 0, 0.0).otherwise(hits / F.sqrt(F.greatest(length, F.lit(1))) * (1 + 1 / (1 + first / 200.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pool_size(top_k: int, configured: int = 60) -> int:
    """Candidates to rerank: three times those asked for, at most as configured, never fewer than asked for."""
    return max(top_k, min(3 * top_k, configured))


def mapped(c: Column, names: Sequence[str]) -> Column:
    """The place of a value in a fixed order, after all others if it is not there."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(names) + 1).otherwise(place).cast("int")


def lookup_order(c: Column, order: dict) -> Column:
    """The number that a fixed order gives a value; 99 where it gives none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), c), F.lit(99))
