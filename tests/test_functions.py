"""Functions on literal values; all cases of a family run as one row."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import calendars, collections as lists, dates, hashing, lookup, maths, nulls, strings, variant

L = lambda *xs: F.array(*map(F.lit, xs))


@pytest.fixture(autouse=True)
def constants(spark):
    """Columns need a session, so these are made late."""
    globals().update(NONE=F.lit(None).cast("string"), NO_INT=F.lit(None).cast("int"), EMPTY=F.array().cast("array<int>"))


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def check(spark, cases):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for i, (_, want) in enumerate(cases):
        got = row[i]
        if isinstance(want, float) and not math.isnan(want):
            assert got == pytest.approx(want, rel=1e-12), i
        elif isinstance(want, float):
            assert math.isnan(got), i
        else:
            assert got == want, (i, got, want)


def fails(spark, column, text=""):
    with pytest.raises(Exception, match=text):
        spark.range(1).select(column).collect()


def test_null_rules(spark):
    check(spark, [
        (nulls.equal(NONE, NONE), True), (nulls.equal(F.lit("a"), NONE), False), (nulls.equal(NONE, "a", optional=False), None),
        (nulls.equal(None, None), True), (nulls.equal(NONE, None), True), (nulls.equal("a", None), False),
        (nulls.not_equal(NONE, "a"), True), (nulls.not_equal("a", "a"), False), (nulls.not_equal_ansi(NONE, "a"), None),
        (nulls.less_than(NO_INT, 1), False), (nulls.less_than(0, 1), True), (nulls.greater_than_equal(1, NO_INT), False),
        (nulls.between(NO_INT, 1, 2), False), (nulls.between(2, 1, 2), True), (nulls.in_(F.lit(1), []), False),
        (nulls.in_(NO_INT, [1]), False), (nulls.in_(F.lit(1), [1, None]), True), (nulls.in_(1, L(1, 2)), True),
        (nulls.compare(1, 2), -1), (nulls.compare("b", "a"), 1), (nulls.compare(1, "a", "number", "string"), -1),
        (nulls.xor(True, False), True), (nulls.and_(True, False), False), (nulls.or_(True, False), True), (nulls.not_(False), True),
        (nulls.if_(NONE.isNull(), "x", "y"), "x"), (nulls.match(F.lit(3), (F.lit(3) > 5, "big"), (F.lit(3) > 2, "mid"), default="low"), "mid"),
        (nulls.is_empty(NONE), True), (nulls.is_not_empty("a"), True), (nulls.coalesce(NONE, "z"), "z"),
        (nulls.to_one(L(7), is_list=True), 7), (nulls.to_one(7), 7), (nulls.to_one_many(L(1, 2)), [1, 2]), (nulls.sql_true(), True), (nulls.sql_null(), None),
    ])
    fails(spark, nulls.to_one(L(1, 2), is_list=True), "size 2")
    fails(spark, nulls.to_one_many(EMPTY))


def test_strings(spark):
    check(spark, [
        (strings.ascii_("A"), 65), (strings.char(66), "B"), (strings.chunk("abcde", 2), ["ab", "cd", "e"]), (strings.contains(NONE, "a"), False),
        (strings.starts_with("abc", "ab"), True), (strings.ends_with(NONE, "b"), False), (strings.encode_base64("hi"), "aGk="), (strings.decode_base64("aGk"), "hi"),
        (strings.index_of("banana", "an"), 2), (strings.index_of("banana", "zz"), 0), (strings.index_of("banana", "an", 3), 4),
        (strings.join_strings(L("a", "b"), "-"), "a-b"), (strings.join_strings(F.array().cast("array<string>"), "-"), ""), (strings.join_strings(L("a", "b"), "[", ",", "]"), "[a,b]"),
        (strings.make_string(F.array(F.lit("a"), NONE), ","), "a,TDSNull"), (strings.left("abc", 2), "ab"), (strings.right("abc", 2), "bc"), (strings.length("héé"), 3),
        (strings.levenshtein_distance("kitten", "sitting"), 3), (strings.lpad("a", 3, "xy"), "xya"), (strings.lpad("abc", 2, ""), "ab"), (strings.rpad("a", 3), "a  "),
        (strings.rpad("a", 3, ""), "a"), (strings.trim(" a "), "a"), (strings.ltrim(" a "), "a "), (strings.rtrim(" a "), " a"),
        (strings.matches("abc", "a.c"), True), (strings.matches("xabc", "a.c"), False), (strings.parse_integer("12"), 12), (strings.parse_float("1.5"), 1.5),
        (strings.parse_boolean("true"), True), (strings.parse_decimal("3.14D"), Decimal("3.14")), (strings.parse_date("2014-05"), dt.datetime(2014, 5, 1)),
        (strings.parse_date("2014-05-06T07:08:09+0200"), dt.datetime(2014, 5, 6, 5, 8, 9)), (strings.regexp_count("banana", "an"), 2), (strings.regexp_count("BANANA", "an", "i"), 2),
        (strings.regexp_extract("a1b22", "[0-9]+", True), ["1", "22"]), (strings.regexp_extract("a1b22", "[0-9]+"), ["1"]), (strings.regexp_extract("a1b2", "([a-z])([0-9])", True, 2), ["1", "2"]),
        (strings.regexp_index_of("abc", "c"), 2), (strings.regexp_index_of("abc", "z"), -1), (strings.regexp_index_of("xxab", "(a)(b)", 2), 3),
        (strings.regexp_like("ABC", "b", "i"), True), (strings.regexp_replace("banana", "a", "$"), "b$n$n$"), (strings.regexp_replace("banana", "a", "o", False), "bonana"),
        (strings.regexp_replace("xyz", "a", "o", False), "xyz"), (strings.repeat_string("ab", 2), "abab"), (strings.replace("a.c", ".", "-"), "a-c"), (strings.reverse_string("abc"), "cba"),
        (strings.split("a.b.c", "."), ["a", "b", "c"]), (strings.split_part("a,b", ",", 1), "b"), (strings.split_part("ab", "", 0), "ab"), (strings.split_part("ab", "", 1), None),
        (strings.substring("abcdef", 3), "cdef"), (strings.substring("abcdef", 0, 2), "ab"), (strings.to_lower("AB"), "ab"), (strings.to_upper_first_character("ab"), "Ab"),
        (strings.to_lower_first_character("AB"), "aB"), (strings.to_string(stamp("2020-01-02 03:04:05"), "datetime"), "2020-01-02T03:04:05.000+0000"), (strings.to_string(5), "5"),
        (strings.to_representation("it's"), "'it\\'s'"), (strings.to_representation(dt.date(2020, 1, 2), "date"), "%2020-01-02"),
        (strings.format_("%s is %d, %.2f %r %%", "x", 5, 1.234, "q"), "x is 5, 1.23 'q' %"), (strings.format_("%t{yyyy-MM}", stamp("2020-03-04 00:00:00")), "2020-03"), (strings.format_("%05d", 42), "00042"),
        (strings.jaro_winkler_similarity("MARTHA", "MARHTA"), 0.9611111111111111), (strings.jaro_winkler_similarity(NONE, "x"), None), (strings.jaro_winkler_similarity("abc", "xyz"), 0.0),
        (strings.is_numeric("12"), True), (strings.is_numeric("a1"), False), (F.length(strings.generate_guid()), 36),
    ])


def test_maths(spark):
    check(spark, [
        (maths.abs_(-2), 2), (maths.acos(1.0), 0.0), (maths.asin(0.0), 0.0), (maths.sqrt(9), 3.0), (maths.atan2(1, 1), math.pi / 4), (maths.cbrt(27), 3.0), (maths.ceiling(1.2), 2),
        (maths.floor(-1.2), -2), (maths.cosh(0.0), 1.0), (maths.cot(1.0), 1 / math.tan(1)), (maths.log10(100), 2.0), (maths.pow_(2, 10), 1024.0), (maths.pi(), math.pi), (maths.sign(-3), -1),
        (maths.divide(1, 4), 0.25), (maths.divide(1, 0), math.inf), (maths.divide(-1, 0), -math.inf), (maths.divide(0, 0), math.nan), (maths.divide(2, 3, 2), Decimal("0.67")),
        (maths.mod(5, -3), -1), (maths.mod(-5, 3), 1), (maths.rem(-5, 3), -2.0), (maths.round_(2.5), 2), (maths.round_(-3.5), -4), (maths.round_(F.lit(2.345), 2), 2.34),
        (maths.bit_and(6, 3), 2), (maths.bit_or(6, 3), 7), (maths.bit_xor(6, 3), 5), (maths.bit_not(0), -1), (maths.bit_shift_left(1, 10), 1024), (maths.bit_shift_right(1024, 3), 128),
        (maths.minus(5), -5), (maths.minus(5, 2, 1), 2), (maths.plus(1, 2, 3), 6), (maths.times(2, 3, 4), 24), (maths.max_(1, 3), 3), (maths.min_(1, 3), 1),
        (maths.to_decimal(F.lit(5), True), Decimal(5)), (maths.to_degrees(math.pi), 180.0), (maths.wide_plus(F.lit(2**63 - 1), 1), Decimal(2**63)), (maths.tanh(0.0), 0.0),
    ])
    for bad in (maths.acos(2.0), maths.asin(-2.0), maths.sqrt(-1), maths.rem(1, 0), maths.bit_shift_left(1, 63)):
        fails(spark, bad)


def test_dates(spark):
    a, b = stamp("2019-12-31 23:00:00"), stamp("2020-01-01 01:00:00")
    leap, sunday, old = stamp("2020-02-29 12:34:56.789"), stamp("2020-01-05 00:00:00"), stamp("1969-12-28 05:00:00")
    check(spark, [
        (dates.date_diff(a, b, "YEARS"), 1), (dates.date_diff(a, b, "MONTHS"), 1), (dates.date_diff(a, b, "DAYS"), 1), (dates.date_diff(a, b, "HOURS"), 2), (dates.date_diff(b, a, "HOURS"), -2),
        (dates.date_diff(a, b, "MINUTES"), 120), (dates.date_diff(b, a, "DAYS"), -1), (dates.date_diff(stamp("2020-01-04 00:00:00"), sunday, "WEEKS"), 1), (dates.date_diff(sunday, stamp("2020-01-06 00:00:00"), "WEEKS"), 0),
        (dates.date_diff(a, stamp("2019-12-31 23:59:59.9"), "MINUTES"), 59), (dates.day_of_week(leap), "Saturday"), (dates.month(leap), "February"), (dates.quarter(leap), 1),
        (dates.day_of_week_number(sunday), 7), (dates.day_of_week_number(sunday, "Sunday"), 1), (dates.first_day_of_week(sunday), dt.date(2019, 12, 30)), (dates.first_day_of_quarter(leap), dt.date(2020, 1, 1)),
        (dates.first_hour_of_day(leap), dt.datetime(2020, 2, 29)), (dates.first_millisecond_of_second(leap), dt.datetime(2020, 2, 29, 12, 34, 56)), (dates.most_recent_day_of_week("Sunday", sunday), dt.date(2020, 1, 5)),
        (dates.previous_day_of_week("Sunday", sunday), dt.date(2019, 12, 29)), (dates.adjust(leap, 1, "YEARS"), dt.datetime(2021, 2, 28, 12, 34, 56, 789000)), (dates.adjust(dt.date(2020, 2, 29), 2, "DAYS", True), dt.date(2020, 3, 2)),
        (dates.adjust(leap, -90, "MINUTES"), dt.datetime(2020, 2, 29, 11, 4, 56, 789000)), (dates.time_bucket(leap, 6, "HOURS"), dt.datetime(2020, 2, 29, 12)), (dates.time_bucket(old, 1, "WEEKS"), dt.datetime(1969, 12, 22)),
        (dates.time_bucket(old, 5, "MONTHS"), dt.datetime(1969, 8, 1)), (dates.time_bucket(dt.date(2020, 1, 5), 2, "YEARS", True), dt.date(2020, 1, 1)), (dates.to_epoch_value(b), 1577840400),
        (dates.to_epoch_value(b, "MILLISECONDS"), 1577840400000), (dates.from_epoch_value(1577840400), dt.datetime(2020, 1, 1, 1)), (dates.is_on_day(a, b), False), (dates.is_before_day(a, b), True),
        (dates.is_after_day(a, b), False), (dates.is_on_or_after_day(b, b), True), (dates.is_on_or_before_day(a, b), True), (dates.date(2014), "2014"), (dates.date(2014, 5), "2014-05"), (dates.date(2014, 5, 6), dt.date(2014, 5, 6)),
        (dates.date(2014, 5, 6, 7, 8), dt.datetime(2014, 5, 6, 7, 8)), (dates.date_part(leap), dt.date(2020, 2, 29)), (dates.hour(leap), 12), (dates.second(leap), 56), (dates.week_of_year(leap), 9), (dates.day_of_year(leap), 60),
        (dates.format_date(leap, "dd.MM.yyyy"), "29.02.2020"), (dates.convert_date_format("03/04/2020", "dd/MM/yyyy"), dt.date(2020, 4, 3)), (dates.convert_time_zone_format(b, "America/New_York", "HH:mm"), "20:00"),
        (dates.has_day(dates.DateLiteral("%2014-05")), False), (dates.has_month(dates.DateLiteral("%2014-05")), True), (dates.has_subsecond_with_at_least_precision(dates.DateLiteral("2014-05-06T01:02:03.45"), 2), True),
        (dates.DateLiteral("2014-05").column(), "2014-05"), (dates.DateLiteral("2014-05-06T07:08").column(), dt.datetime(2014, 5, 6, 7, 8)), (dates.max_(a, b), dt.datetime(2020, 1, 1, 1)),
        (dates.first_day_of_this_year() <= dates.today(), True), (dates.now().isNotNull(), True),
    ])
    fails(spark, dates.time_bucket(F.lit(dt.date(2020, 1, 1)), 1, "HOURS", True))


def test_lists_and_maps(spark):
    c = L(3, 1, 2, 1)
    m = F.create_map(F.lit("a"), F.lit(1))
    check(spark, [
        (lists.at(c, 1), 1), (lists.add(c, 9), [3, 1, 2, 1, 9]), (lists.add(c, 9, 1), [3, 9, 1, 2, 1]), (lists.first(EMPTY), None), (lists.last(c), 1), (lists.init(c), [3, 1, 2]), (lists.tail(c), [1, 2, 1]),
        (lists.init(EMPTY), []), (lists.tail(EMPTY), []), (lists.take(c, 2), [3, 1]), (lists.take(c, -1), []), (lists.drop(c, 3), [1]), (lists.drop(c, 9), []), (lists.slice_(c, 1, 3), [1, 2]), (lists.slice_(c, 3, 1), []),
        (lists.concatenate(c, L(5)), [3, 1, 2, 1, 5]), (lists.contains(c, 2), True), (lists.contains(EMPTY, 2), False), (lists.contains(c, lambda x: x > 2), True), (lists.distinct(c), [3, 1, 2]),
        (lists.remove_duplicates_by(c, lambda x: x % 2), [3, 2]), (lists.remove_all(c, L(1)), [3, 2]), (lists.exists(EMPTY, lambda x: x > 0), False), (lists.for_all(EMPTY, lambda x: x > 0), True),
        (lists.find(c, lambda x: x < 3), 1), (lists.map_(c, lambda x: F.when(x > 1, x)), [3, 2]), (lists.fold(c, lambda x, acc: acc * 10 + x, 0), 3121), (lists.index_of(c, 2), 2), (lists.index_of(c, 7), -1),
        (lists.reverse(c), [1, 2, 1, 3]), (lists.sort(c), [1, 1, 2, 3]), (lists.sort(c, descending=True), [3, 2, 1, 1]), (lists.sort(c, lambda x: -x), [3, 2, 1, 1]), (lists.sort_by_reversed(c, lambda x: x), [3, 2, 1, 1]),
        (lists.size(EMPTY), 0), (lists.size(F.lit(None).cast("array<int>")), 0), (lists.range_(3), [0, 1, 2]), (lists.range_(0), []), (lists.range_(5, 1, -2), [5, 3]), (lists.and_(L(True, False)), False), (lists.or_(L(True, False)), True),
        (lists.is_distinct(c), False), (lists.unique_value_only(L(4, 4)), 4), (lists.unique_value_only(c), None), (lists.greatest(c), 3), (lists.min_(c), 1), (lists.max_(c, lambda a, b: b - a), 1),
        (lists.sum_(c), 7.0), (lists.sum_(EMPTY), None), (lists.average(c), 1.75), (lists.product(c), 6.0), (lists.median(c), 1.5), (lists.mode(c), 1), (lists.variance_sample(c), 0.9166666666666666), (lists.std_dev_population(L(1, 3)), 1.0),
        (lists.percentile(L(1, 2, 3, 4), 0.25), 1.75), (lists.percentile(L(1, 2, 3, 4), 0.5, True, False), 2.0), (lists.percentile(L(1, 2, 3, 4), 0.25, False), 3.25), (lists.corr(L(1, 2, 3), L(2, 4, 6)), 1.0), (lists.covar_sample(L(1, 2, 3), L(2, 4, 6)), 2.0),
        (lists.max_by(L("aa", "b"), F.length), "aa"), (F.size(lists.zip_(L(1, 2, 3), L("a", "b"))), 2), (lists.zip_(L(1), L("a"))[0]["second"], "a"), (lists.get(m, "a"), 1), (lists.get(m, "z"), None), (lists.put(m, "b", 2), {"a": 1, "b": 2}),
        (lists.keys(m), ["a"]), (lists.values(m), [1]), (lists.compact(F.array(F.lit(1), NO_INT)), [1]), (lists.is_empty(EMPTY), True), (lists.is_not_empty(c), True), (lists.list_(1, 2), [1, 2]),
        (lists.get(lists.put_all(m, F.array(lists.pair("c", 3))), "c"), 3),
    ])
    fails(spark, lists.at(c, 4), "offset 4")
    fails(spark, lists.add(c, 1, 9))


def test_variant_and_hash(spark):
    v = variant.from_json(F.lit('{"a": {"b": [1, 2]}, "s": "x"}'))
    check(spark, [
        (variant.to(variant.get(variant.get(variant.get(v, "a"), "b"), 1), "bigint"), 2), (variant.to_many(variant.get(variant.get(v, "a"), "b"), "int"), [1, 2]), (variant.to(variant.get(v, "s"), "string"), "x"),
        (variant.to(variant.get(v, "none"), "string"), None), (hashing.hash_(F.lit("a")), "0cc175b9c0f1b6a831c399e269772661"), (F.length(hashing.hash_(F.lit("a"), "SHA256")), 64), (hashing.hash_code(F.lit("a")).isNotNull(), True),
    ])


def test_lookup_by_name():
    assert lookup("jaroWinklerSimilarity") is strings.jaro_winkler_similarity
    assert lookup("dateDiff") is dates.date_diff and lookup("max", "collections") is lists.max_ and lookup("in") is nulls.in_
    with pytest.raises(KeyError):
        lookup("noSuchFunction")


def test_every_calendar_function(spark):
    calendar = calendars.plain_calendar(spark, dt.date(2018, 1, 1), dt.date(2024, 12, 31)).cache()
    days = spark.sql("SELECT explode(sequence(date'2018-06-01', date'2023-06-01', interval 1 day)) AS d")
    df = calendars.with_calendar(days, calendar, F.col("d"), F.lit(dt.date(2022, 3, 16)))
    row = df.agg(*(F.coalesce(F.sum(calendars.value(n, F.lit(1))), F.lit(0.0)).alias(n) for n in calendars.RULES)).first()
    want = {"ytd": 75, "mtd": 16, "qtd": 75, "reportEndDay": 1, "priorDay": 1, "cw": 7, "cw_fm": 7, "pw": 7, "pw_fm": 7, "pwtd": 3, "pmtd": 16, "pqtd": 75, "pytd": 75, "pymtd": 16, "pyqtd": 75, "priorYear": 365,
            "CYMinus2": 366, "CYMinus3": 365, "p4wtd": 29, "p12wtd": 85, "p52wtd": 365, "p4wa": 29 / 4, "p12wa": 85 / 12, "p52wa": 365 / 52, "p12mtd": 365, "annualized": 365 / (75 / 365), "cme": 31 / (75 / 31), "pma": 59 / 2}
    for name, n in want.items():
        assert row[name] == pytest.approx(n), name
    assert set(calendars.RULES) == set(want) | {"wtd", "pywtd", "pwa", "pywa"} and len(calendars.RULES) == 32
