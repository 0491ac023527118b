"""Spoken numbers, clock times, platforms, durations and car numbers as column expressions.

Runs of numeral characters are found first; what a run is worth is looked up in a table of spellings, built by rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spoken digits and what they are; units of a duration; words for a time of day, those of the second half last.
SPOKEN = "零〇一壹二兩貳三參叁四肆五伍六陸七柒八捌九玖洞么腰拐勾"
DIGITS = "001122233344556677889901179"
UNITS = "小時|分鐘|分秒|分|秒|公尺|公里|米"
MORNING = ("上午", "早上", "清晨", "凌晨", "中午", "正午")
LATE = ("下午", "傍晚", "夜間", "晚上")
#: A run of numeral characters, as long as there are any.
RUN = f"[0-9{SPOKEN}十]++"


def spellings() -> dict[str, int]:
    """Every way to write 0 to 99 once spoken digits are digits: by digits, and with the word for ten."""
    out = {}
    for n in range(100):
        tens, ones = divmod(n, 10)
        out |= {str(n): n, f"{n:02d}": n}
        if tens:
            out |= {f"{t}十{ones or ''}": n for t in ({"", "1"} if tens == 1 else {str(tens)})}
    return out


def number(c: Column) -> Column:
    """What a run of numerals is worth, from 0 to 99; null for any other."""
    table = ",".join(f"{k}:{n}" for k, n in spellings().items())
    return F.try_element_at(F.str_to_map(F.lit(table)), F.translate(c, SPOKEN, DIGITS)).cast("int")


def having(c: Column, words: str) -> Column:
    """Whether a text has any of the words, which are parted by bars; no pattern is tried for it."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words.split("|")])


def rewrite(c: Column, core: str, new: Callable[[Callable[[int], Column]], Column], before: str = "", after: str = "", words: str = "") -> Column:
    """Every match of ``core`` between ``before`` and ``after``, which only look, becomes ``new(group)``; null leaves it as it is.

    A text without any of the ``words``, one of which every match has, is left without trying the pattern.
    """
    at = before + core + after

    def woven(x: Column) -> Column:
        fixed = F.transform(F.regexp_extract_all(x, F.lit(at), F.lit(0)), lambda m: F.coalesce(new(lambda i: F.regexp_extract(m, core, i)), m))
        parts = F.zip_with(F.split(x, at, -1), fixed, lambda between, m: F.concat(between, F.coalesce(m, F.lit(""))))
        return F.when(having(x, words) & x.rlike(at) if words else x.rlike(at), F.array_join(parts, "")).otherwise(x)

    # The text is itself a step's result, used four times here: a lambda's variable is worked out once.
    return F.get(F.transform(F.array(c), woven), F.lit(0))


def rewrites(c: Column, core: str, new: Callable[[Callable[[int], Column]], Column], before: str = "", after: str = "", words: str = "") -> Column:
    """How many matches :func:`rewrite` changes."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(before + core + after), F.lit(0)), lambda m: new(lambda i: F.regexp_extract(m, core, i)) != m))


#: A step either rewrites a text or counts what it would change.
How = Callable[..., Column]


def padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def normalize_time(c: Column, how: How = rewrite) -> Column:
    """Spoken or mixed clock times become HH:MM; what is no time of day stays."""
    day = "|".join(MORNING + LATE)

    def clock(g: Callable[[int], Column]) -> Column:
        hour = number(g(2))
        hour = F.when(g(1).isin(*LATE) & hour.between(1, 11), hour + 12).otherwise(hour)
        minute = F.when(g(3) == "", 0).when(g(3) == "半", 30).otherwise(number(g(3)))
        return F.when((hour < 24) & (minute < 60), F.concat_ws(":", padded(hour), padded(minute)))

    return how(c, rf"(?:({day})\s*)?({RUN})\s*[時點](?:\s*({RUN}|半)\s*分?|[整鐘])?", clock, words="時|點")


def pad_station_codes(c: Column, how: How = rewrite) -> Column:
    """A line's letter with one digit gets a leading zero and the capital."""
    return how(c, "([GRgr])([0-9])", lambda g: F.concat(F.upper(g(1)), F.lit("0"), g(2)), "(?<![0-9A-Za-z])", "(?![0-9a-z])")


def counted(c: Column, what: str, how: How = rewrite) -> Column:
    """A numeral before one of ``what``: its value, a space, and the word."""
    return how(c, rf"({RUN})\s*({what})", lambda g: F.when(number(g(1)) > 0, F.concat_ws(" ", number(g(1)).cast("string"), g(2))), words=what)


def normalize_platform(c: Column, how: How = rewrite) -> Column:
    return counted(c, "月台", how)


def normalize_duration(c: Column, how: How = rewrite) -> Column:
    return counted(c, UNITS, how)


def boundary_spacing(c: Column) -> Column:
    """A space between numbers or times and the characters beside them."""

    def spaced(x: Column) -> Column:
        meet = x.rlike(r"[0-9]:[0-9]{2}[^\s0-9]|[0-9][一-鿿]|[一-鿿][0-9]")  # looking around at every character is left to texts that need it
        return F.when(meet, F.regexp_replace(x, r"(?<=[0-9]:[0-9]{2})(?=[^\s0-9])|(?<=[0-9])(?=[一-鿿])|(?<=[一-鿿])(?=[0-9])", " ")).otherwise(x)

    single = lambda x: F.when(having(x, "  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x)
    return F.get(F.transform(F.transform(F.array(c), spaced), single), F.lit(0))


STEPS = (normalize_time, pad_station_codes, normalize_platform, normalize_duration)


def normalize_numbers(c: Column) -> Column:
    for step in (*STEPS, boundary_spacing):
        c = step(c)
    return c


def number_changes(c: Column) -> Column:
    """How many numbers :func:`normalize_numbers` writes in another way, step by step; spacing doesn't count."""
    state = F.struct(c.alias("text"), F.lit(0).alias("n"))

    def after(step: How) -> Callable[[Column], Column]:
        return lambda s: F.struct(step(s["text"]).alias("text"), (s["n"] + step(s["text"], rewrites)).alias("n"))

    for step in STEPS:  # each state is a lambda's variable, so that it is worked out once
        state = F.get(F.transform(F.array(state), after(step)), F.lit(0))
    return state["n"]


def car_numbers(c: Column, how: How, spoken: bool = True) -> Column:
    """The number before a car: spoken digits (two at least) as digits, four of them as a pair, both of a pair with two digits, and a space.

    Without ``spoken`` only what is written in digits is a number.
    """
    digit = f"[0-9{SPOKEN}]" if spoken else "[0-9]"

    def named(g: Callable[[int], Column]) -> Column:
        a, b = (F.translate(g(i), SPOKEN, DIGITS) for i in (1, 2))
        pair = lambda x, y: F.concat(F.lpad(x, 2, "0"), F.lit("/"), F.lpad(y, 2, "0"))
        said = F.when(b != "", F.when(F.length(a) < 3, pair(a, b))).when(F.length(a) == 4, pair(F.left(a, F.lit(2)), F.right(a, F.lit(2)))).when(F.length(a) < 3, a)
        return F.concat_ws(" ", said, F.when(said.isNotNull(), g(3)))

    core = rf"({digit}{{2,4}}|[0-9])(?:\s*[/／]\s*({digit}{{1,2}}))?\s*(動?車門|動車|車)"
    return how(c, core, lambda g: F.nullif(named(g), F.lit("")), "(?<![0-9/／])", "(?![組站輛])")


def normalize_car_numbers(c: Column, spoken: bool = True) -> Column:
    """:func:`car_numbers`, with runs of blanks made one."""
    return F.regexp_replace(car_numbers(c, rewrite, spoken), " {2,}", " ")


def car_number_changes(c: Column, spoken: bool = True) -> Column:
    return car_numbers(c, rewrites, spoken)
