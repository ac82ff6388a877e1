"""Cleaning of dirty text values. Every function maps columns to columns; what cannot be parsed is null, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must agree with.
SEX_BUCKETS = {
    "수": "수", "수컷": "수", "m": "수", "male": "수",
    "암": "암", "암컷": "암", "f": "암", "female": "암",
    "거": "거", "거세": "거", "g": "거", "gelding": "거",
}
OTHER_SEX = "기타"
SEX_CODES = {"수": 0.0, "암": 1.0, "거": 2.0}
WEATHER_CODES = {"맑음": 0.0, "흐림": 1.0, "비": 2.0, "눈": 3.0}
BURDEN_CODES = {"마령": 0.0, "별정A": 1.0, "별정B": 2.0, "핸디캡": 3.0}
CLASS_CODES = {
    "국6등급": 1.0, "국5등급": 2.0, "국4등급": 3.0, "혼4등급": 3.0, "국3등급": 4.0, "혼3등급": 4.0,
    "2등급": 5.0, "1등급": 6.0, "국OPEN": 7.0, "혼OPEN": 7.0,
}
REST_RISK_CODES = {"low": 0.0, "medium": 1.0, "high": 2.0}
POOL_CODES = {
    "단승식": "WIN", "연승식": "PLC", "복승식": "QNL", "쌍승식": "EXA", "복연승식": "QPL", "삼복승식": "TLA", "삼쌍승식": "TRI", "쌍복승식": "XLA",
    "WIN": "WIN", "PLC": "PLC", "QNL": "QNL", "EXA": "EXA", "QPL": "QPL", "TLA": "TLA", "TRI": "TRI", "XLA": "XLA",
}
SENTINELS = ["-", "--", "없음", "미상", "n/a", "na"]
MISSING_TOKENS = ["", "-", "--", "n/a", "na", "nan", "none", "null"]
WIN_ODDS_MAX, PLACE_ODDS_MAX = 300.0, 100.0


def text(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number(c: Column) -> Column:
    """A finite double, else null."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN is above infinity


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once a row, however often it is used; for what is costly to parse."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def whole(c: Column) -> Column:
    """The integer part of a number, so that '1.5' is 1."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.abs(value) < 2**31, value.cast("int"))


def positive(c: Column) -> Column:
    """``c`` if above 0."""
    return F.when(c > 0, c)


def nonnegative(c: Column) -> Column:
    """``c`` if 0 or above."""
    return F.when(c >= 0, c)


def first_present(*aliases: Column) -> Column:
    """The first alias that is not blank."""
    return F.coalesce(*[text(a) for a in aliases])


def identifier(c: Column) -> Column:
    """Trimmed text without a trailing .0."""
    return F.nullif(F.regexp_replace(text(c), r"\.0$", ""), F.lit(""))


def sentinel_to_null(c: Column) -> Column:
    """Null for words that stand for nothing."""
    return F.when(~F.lower(text(c)).isin(SENTINELS), text(c))


def date_digits(c: Column) -> Column:
    """The digits of a date if there are exactly eight."""
    digits = F.regexp_replace(sentinel_to_null(c), r"\D", "")
    return F.when(F.length(digits) == 8, digits)


def date_prefix(*candidates: Column) -> Column:
    """First eight digits of the first candidate that has eight."""
    digits = [F.regexp_replace(c.cast("string"), r"\D", "") for c in candidates]
    return F.coalesce(*[F.when(F.length(d) >= 8, F.substring(d, 1, 8)) for d in digits])


def first_digits(c: Column) -> Column:
    """The first run of digits."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("int")


def signed_in_parentheses(c: Column) -> Column:
    """The signed integer in parentheses."""
    return F.regexp_extract(c.cast("string"), r"\(([+-]?\d+)\)", 1).try_cast("int")


def bounded_delta(c: Column, least: int = -40, most: int = 40) -> Column:
    """The integer in parentheses if within bounds."""
    value = signed_in_parentheses(c)
    return F.when(value.between(least, most), value.cast("double"))


def percent_in_parentheses(c: Column) -> Column:
    """The number of '(12%)'."""
    return F.regexp_extract(c.cast("string"), r"\((\d+)%\)", 1).try_cast("double")


def leading_number(c: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(c.cast("string"), r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def nonnegative_number(c: Column) -> Column:
    """'12%', '1.5' or '7' as a number not below 0."""
    return nonnegative(number(F.regexp_replace(c.cast("string"), "%", "")))


def coded(c: Column, codes: dict) -> Column:
    """The code of a category, null for others."""
    return reduce(lambda rest, item: F.when(c == item[0], F.lit(item[1])).otherwise(rest), codes.items(), F.lit(None))


def sex_bucket(c: Column) -> Column:
    """One of the buckets; unknown words are the other bucket, blank is null."""
    value = text(c)
    return F.when(value.isNotNull(), F.coalesce(coded(F.lower(value), SEX_BUCKETS), F.lit(OTHER_SEX)))


def flag_number(c: Column) -> Column:
    """true/false as 1/0."""
    return c.cast("boolean").cast("double")


def market_odds(c: Column, most: float) -> Column:
    """Odds within (0, most]."""
    value = number(c)
    return F.when((value > 0) & (value <= most), value)


def market_flags(c: Column, name: str, most: float) -> Column:
    """Sorted flags that say why odds are missing."""
    value = number(c)
    usable = F.coalesce((value > 0) & (value <= most), F.lit(False))
    flags = [
        F.when(text(c).isNotNull() & value.isNull(), F.lit("odds_parse_failed")),
        F.when(value > most, F.lit(f"{name}_outlier")),
        F.when(~usable, F.lit("market_signal_missing")),
    ]
    if name == "win_odds":
        flags.append(F.when(~usable, F.lit("popularity_unusable")))
    return F.array_sort(F.array_compact(F.array(*flags)))


def start_time(c: Column) -> Column:
    """HHMM of a start time; three digits get a leading zero."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    padded = F.when(F.length(digits) == 3, F.concat(F.lit("0"), digits)).otherwise(digits)
    valid = (F.length(padded) == 4) & (F.substring(padded, 1, 2).try_cast("int") <= 23) & (F.substring(padded, 3, 2).try_cast("int") <= 59)
    return F.when(valid, padded)


def start_at(date_text: Column, time: Column, zone: str = "Asia/Seoul") -> Column:
    """The start as a UTC timestamp."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(date_text, start_time(time)), F.lit("yyyyMMddHHmm")), zone)


def camel_to_snake(c: Column) -> Column:
    """camelCase to snake_case."""
    step = F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(step, r"([a-z0-9])([A-Z])", "$1_$2"))


def snake_to_camel(c: Column) -> Column:
    """snake_case to camelCase."""
    parts = F.split(c, "_")
    tail = F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.concat(parts[0], F.array_join(tail, ""))


def metric_value(c: Column, least: float = 0.0, most: float = 1.0, *, maximize: bool = True) -> Column:
    """A metric on the unit interval: struct (status, issue, scale, normalized, comparable).

    Percent signs and thousands commas are read; numbers beyond the maximum but within 100 count as percent.
    """
    slack = 1e-9
    token = F.lower(F.trim(c.cast("string")))
    missing = F.coalesce(token.isin(MISSING_TOKENS), F.lit(True))
    percent = token.endswith("%")
    parsed = F.regexp_replace(F.regexp_replace(token, r"%$", ""), ",", "").try_cast("double")
    finite = F.when(~F.isnan(parsed) & (F.abs(parsed) < float("inf")), parsed)
    large = F.abs(finite) > most + slack
    scaled = F.when(percent | large, finite / 100).otherwise(finite)
    issue = (
        F.when(missing, "missing")
        .when(parsed.isNull(), "non_numeric")
        .when(finite.isNull(), "non_finite")
        .when(~percent & large & (F.abs(finite) > 100 + slack), "out_of_supported_range")
        .when((scaled < least - slack) | (scaled > most + slack), "out_of_range")
    )
    scale = F.when(missing | finite.isNull(), F.when(percent, "percent_string")).when(percent, "percent_string").when(large, F.when(F.abs(finite) > 100 + slack, "unsupported_scale").otherwise("percent_numeric")).otherwise("unit_interval")
    unit = F.round(F.least(F.greatest((scaled - least) / (most - least), F.lit(0.0)), F.lit(1.0)), 6)
    ok = issue.isNull()
    return F.struct(
        F.when(ok, "ok").when(issue == "missing", "missing").otherwise("abnormal").alias("status"),
        issue.alias("issue"),
        scale.alias("scale"),
        F.when(ok, unit).alias("normalized"),
        F.when(ok, unit if maximize else F.round(1 - unit, 6)).alias("comparable"),
    )
