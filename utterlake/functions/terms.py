"""Key terms of radio speech, protected runs, keyword lists and the older cleaning chain, as column expressions in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers
from .text import fix_number_explosion, fix_station_codes, runs

WORD_END = r"(?![\p{L}\p{N}_])"
WORD_START = r"(?<![\p{L}\p{N}_])"
#: The kinds of key terms and what belongs to each, in any case of letters.
KEY_TERMS = {
    "station_code": r"[GgRr]\d{1,2}",
    "equipment": rf"{WORD_START}(OCC|MTC|ATP|ATO|EDRH|MCP|CBTC|NCP|ETF|VVVF|ASR|MCS|RF|AM){WORD_END}",
    "platform": r"[一二三四五12345]月台|月台門|站台|月台",
    "car_number": r"\d{1,3}\s*/\s*\d{1,3}\s*車|\d+號?車",
    "action": r"復電|斷電|清車|停準|未停準|開門|關門|引導|呼叫|通告|回報|登上",
    "comm": rf"{WORD_START}over{WORD_END}|收到|稍後|完畢",
    "station_name": r"[一-鿿]{2,4}站(?![長員務台房])",
    "track": r"上行|下行|正線|三軌|岔心|軌道",
}
#: What a kind's terms begin with, in any case, so that other characters cost one look.
FIRST = {"equipment": "AMOENCVR", "platform": "1-5一-鿿", "action": "一-鿿", "comm": "o一-鿿", "track": "一-鿿"}
#: What is only letters of the Latin alphabet, digits and slashes is compared without regard to case.
PLAIN = "^[A-Za-z0-9/]+$"
#: What comparing terms leaves out; the wide characters lie in one range, which is looked at first.
UNCOMPARED = r"[\t-\r ,.:;!?\-()\"']+|(?=[\u2014-\uff1f])[，。、：；！？—（）“”]+"


def key_terms(c: Column, patterns: dict[str, str] = KEY_TERMS) -> Column:
    """Distinct struct(category, term) of a text; terms lose white space, plain ones are in upper case. Null stays null."""

    def of(kind: str, pattern: str) -> Column:
        guard = f"(?=[{FIRST[kind]}])" if kind in FIRST and pattern == KEY_TERMS[kind] else ""
        found = F.transform(F.regexp_extract_all(c, F.lit(f"(?i){guard}(?:{pattern})"), F.lit(0)), lambda t: F.regexp_replace(t, r"\s+", ""))
        return F.transform(found, lambda t: F.struct(F.lit(kind).alias("category"), F.when(t.rlike(PLAIN), F.upper(t)).otherwise(t).alias("term")))

    return F.array_distinct(F.flatten(F.array(*[of(k, p) for k, p in patterns.items()])))


def comparable(c: Column) -> Column:
    """Without notes in brackets, speaker marks, punctuation and white space, all in one pass; null counts as empty."""
    note = "【[^】]*】"
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?m){UNCOMPARED}|^(?:{note})*[A-Z]:|{note}", "")


def occurs(term: Column, comparable_text: Column, upper: Column | None = None) -> Column:
    """Whether a text has a term; ``upper`` is the text in upper case, for many terms of one text."""
    upper = F.upper(comparable_text) if upper is None else upper
    return F.when(term.rlike(PLAIN), F.contains(upper, F.upper(term))).otherwise(F.contains(comparable_text, term))


def outside(c: Column, patterns: list[str], literals: list[str], rewrite: Callable[[Column], Column]) -> Column:
    """``rewrite`` of what no pattern and no literal covers; the rest stays as it is.

    Patterns protect in their order, then the literals; of literals that overlap the one that begins first wins, at one
    place the longest.
    """
    words = [re.escape(x) for x in sorted(filter(None, literals), key=lambda x: (-len(x), x))]
    levels = [*patterns, *(["|".join(words)] if words else [])]

    def walk(x: Column, left: list[str]) -> Column:
        return runs(x, left[0], lambda kept: kept, lambda y: walk(y, left[1:])) if left else rewrite(x)

    return walk(c, levels)


def keyword_lines(c: Column) -> Column:
    """array(keyword, level) of lines ``keyword,level``: highest level first, then as listed; of repeats the first counts.

    Blanks go and a wide comma is a comma. Lines with ``#`` in front, without digits after the comma or with keywords of
    under 2 or over 12 characters go; levels above 5 count as 5.
    """
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: F.replace(F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("，"), F.lit(",")), F.lit(" "), F.lit("")))
    lines = F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(",")))

    def parsed(x: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(x, "^[^,]*,", ""), "[^0-9]", "")
        level = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 1, 5).otherwise(F.least(F.lit(5), F.right(digits, F.lit(1)).try_cast("int")))
        return F.struct(F.regexp_replace(F.regexp_extract(x, "^([^,]*),", 1), r"^\s+|\s+$", "").alias("keyword"), F.when(digits != "", level).alias("level"))

    known = F.filter(F.transform(lines, parsed), lambda x: F.length(x["keyword"]).between(2, 12) & x["level"].isNotNull())
    # Sorted by keyword and place, the first of equal ones has another before it; a lambda's variable is worked out once.
    sorted_ = F.array_sort(F.transform(known, lambda x, i: F.struct(x["keyword"].alias("keyword"), i.alias("i"), x["level"].alias("level"))))
    firsts = F.get(F.transform(F.array(sorted_), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["keyword"] != x["keyword"]))), F.lit(0))
    placed = F.array_sort(F.transform(firsts, lambda x: F.struct((-x["level"]).alias("low"), x["i"].alias("i"), x["keyword"].alias("keyword"), x["level"].alias("level"))))
    return F.transform(placed, lambda x: F.struct(x["keyword"].alias("keyword"), x["level"].alias("level")))


def legacy_clean(c: Column, corrections: dict[str, str], bold: bool = True) -> Column:
    """struct(text, corrections_applied, length_change): corrections as listed, station codes, number runs, trains, blanks.

    ``corrections_applied`` counts the listed spellings that the text has at the start. A train's spoken number of two to
    four characters becomes two digits if it is worth 1 to 99; any other stays.
    """
    given = F.coalesce(c, F.lit(""))
    out = given
    for wrong, right in corrections.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = fix_station_codes(out)
    if bold:
        out = F.regexp_replace(fix_number_explosion(out), r"(\d{2})\s*(\d{2})車", "$1/$2車")
        worth = lambda g: numbers.number(F.regexp_replace(g(1), "^零+(?=.)", ""))
        out = numbers.rewrite(out, "([零一二三四五六七八九十百]{2,4})車", lambda g: F.when(worth(g) > 0, F.concat(numbers.padded(worth(g)), F.lit("車"))))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "^ | $", "")
    applied = sum((F.contains(given, F.lit(w)).cast("int") for w in corrections), F.lit(0))
    return F.struct(out.alias("text"), applied.alias("corrections_applied"), (F.length(out) - F.length(given)).alias("length_change"))
