"""Text normalisation as column expressions; all but the cut of repetitions stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width digits and letters and their half-width forms; the whole full-width block for full_to_half.
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLOCK = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
#: Punctuation that the error rates ignore.
PUNCTUATION = "，。！？、；：「」『』（）《》〈〉—…,.!?;:\"'()\\[\\]<>~\\-_/"


def normalize_eval(c: Column) -> Column:
    """Clock marks go, full width becomes half, only letters and digits stay, in lower case."""
    c = F.regexp_replace(c, r"\[\d{1,2}:\d{2}(:\d{2})?\]", "")
    return F.lower(F.regexp_replace(F.translate(c, WIDE, NARROW), r"[^\p{L}\p{N}_]", ""))


def normalize_cer(c: Column) -> Column:
    """Speaker marks, bracketed notes, punctuation and white space go."""
    c = F.regexp_replace(c, r"(?m)^[A-Z?]:\s*", "")
    return F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]|【[^】]*】", ""), f"[{PUNCTUATION}\\s]", "")


def full_to_half(c: Column) -> Column:
    return F.translate(c, BLOCK, HALF)


def strip_meta(c: Column) -> Column:
    """Notes on sounds, such as (laughter) or [noise], go, as do silences with their length; English or Chinese."""
    named = r"silence(\s*\d+(\.\d+)?s?)?|laughter|noise|music|applause|inaudible|unclear|cough|beep|笑聲|咳嗽|雜音|沉默\s*[\d一二三四五六七八九十]+(\s*秒|s)"
    return F.regexp_replace(c, rf"(?i)[(\[（【]({named})[)\]）】]|（沉默[^）]*）", "")


def apply_synonyms(c: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Variants become their canonical form: group by group, longest variant first."""
    for canonical, variants in groups:
        for v in sorted(variants, key=lambda x: (-len(x), x)):
            c = F.replace(c, F.lit(v), F.lit(canonical))
    return c


def clean_training(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[A-Z?]:\s*", ""), r"\[[^\]]*\]|【[^】]*】", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_lm(c: Column) -> Column:
    return F.regexp_replace(clean_training(c), r"\s+", "")


def clean_reference_script(c: Column) -> Column:
    """Lines without headings, clock marks, calls at their start and short asides; lines that are empty then go.

    Headings are Markdown ones and numbered chapters. A clock mark opens a line, alone or with its seconds spelled out;
    plain ones go anywhere. Asides have at most five characters.
    """
    heading = r"^(?:#+ .*|第\s*\d+\s*章節.*)$"
    opening = r"^\d+:\d+\s*(?:\d+\s*)?(?:秒|分鐘\s*\d+\s*秒)\s*"
    caller = r"^(?:[A-Za-z]+\s*呼叫\s*[A-Za-z]+\s+)?(?:這裡是\s*[A-Za-z]+\s*)?"
    anywhere = r"\d{1,2}:\d{2}(?::\d{2})?|\([^)]{0,5}\)|（[^）]{0,5}）"

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s+|\s+$", "")
        for pattern in (heading, opening, caller, anywhere):
            x = F.regexp_replace(x, pattern, "")
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    return F.array_join(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), line), lambda x: x != ""), "\n")


def strip_live_lines(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(r"^(DEBUG|INFO|WARN|ERROR)\b"))
    return F.trim(F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\[\d{2}:\d{2}:\d{2}\]", ""))), " "), " +", " "))


def runs(c: Column, pattern: str, on_match: Callable[[Column], Column], on_rest: Callable[[Column], Column]) -> Column:
    """``on_match`` of every match and ``on_rest`` of what lies between, put together again; the text is taken apart, not marked."""

    def woven(x: Column) -> Column:
        between = F.transform(F.split(x, pattern, -1), on_rest)
        found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), on_match)
        return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # A lambda's variable is worked out once, an expression that is used twice is not.
    return F.when(c.isNotNull(), F.get(F.transform(F.array(c), woven), F.lit(0)))


#: Digits as they are said over the radio, and their figures.
SPOKEN_DIGITS, FIGURES = "零洞一腰么二兩三四五六七拐八九勾鉤", "00111223456778999"


def fix_station_codes(c: Column, strict: bool = False) -> Column:
    """``G 0 7``, ``g7`` and ``R 洞拐`` become ``G07`` and ``R07``; ``strict`` asks that no letter stands before.

    One pass over letter and digits: two digits or two spoken ones, or a digit alone, next to a capital or anywhere after
    a small letter.
    """
    spoken = f"[{SPOKEN_DIGITS}]"
    codes = [rf"[GR]\s*\d\s*\d", r"[GR]\d", r"[gr]\s*\d\d?", rf"[GRgr]\s*{spoken}\s*{spoken}"]
    guard = r"(?<![\p{L}\p{N}_])" if strict else ""

    def code(x: Column) -> Column:
        x = F.translate(F.upper(F.regexp_replace(x, r"\s", "")), SPOKEN_DIGITS, FIGURES)
        return F.when(F.length(x) == 2, F.concat(F.left(x, F.lit(1)), F.lit("0"), F.right(x, F.lit(1)))).otherwise(x)

    return runs(c, f"{guard}(?:{'|'.join(codes)})", code, lambda x: x)


def fix_number_explosion(c: Column, mark: str = "[number?]") -> Column:
    """Digit runs of 15 and more: what begins with 0, 1 or 2 keeps two digits, others become a mark."""
    return F.regexp_replace(F.regexp_replace(c, r"(^|[^0-9])([012]\d)\d{13,}", "$1$2"), r"\d{15,}", mark)


def tail_copies(text: str, unit: int) -> int:
    """How many copies of its last ``unit`` characters a text ends with: the reversed text's longest match with itself, moved by ``unit``."""
    v = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1]
    same = v[unit:] == v[: len(v) - unit]
    border = len(same) if same.all() else int(same.argmin())
    return 1 + border // unit


def truncate_repetition(c: Column, least: int = 2, most: int = 30, times: int = 5) -> Column:
    """If the tail repeats a unit of ``least`` to ``most`` characters ``times`` times or more, keep one copy; the smallest unit wins.

    What stays loses white space at its end if a copy was cut. Time is linear in the text.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            for k in range(least, min(most, len(x) // times) + 1) if x else ():
                tail = x[-k * times :]
                if tail == tail[:k] * times:
                    return x[: len(x) - k * (tail_copies(x, k) - 1)].rstrip(" ")
            return x

        return texts.map(one)

    return cut(c)


def parse_inline_tags(c: Column) -> Column:
    """struct(tags in order of first find, text without them)."""
    tags = F.array_distinct(F.regexp_extract_all(c, F.lit(r"<\|([A-Za-z_]+)\|>"), F.lit(1)))
    return F.struct(tags.alias("tags"), F.trim(F.regexp_replace(c, r"<\|[A-Za-z_]+\|>", "")).alias("text"))


def dominant(tags: Column, ranks: list[str]) -> Column:
    """Of the tags in ``ranks`` the one that is last there; null without any."""
    ordered = F.array(*[F.lit(r) for r in ranks])
    return F.try_element_at(F.filter(ordered, lambda r: F.array_contains(tags, r)), F.lit(-1))


def like_pattern(words: str) -> str:
    """A LIKE pattern for texts that have the words as they are."""
    return "%" + "".join("\\" + c if c in "\\%_" else c for c in words) + "%"


def filename_datetime(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(F.regexp_replace(c, r"(20\d{6})_(\d{6})", "$1$2"), r"(20\d{12})", 1), F.lit("yyyyMMddHHmmss"))


def safe_name(c: Column, most: int = 60, other: str = "untitled") -> Column:
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\n\r\t]', "")), r"\s+", "_")
    return F.coalesce(F.nullif(F.left(c, F.lit(most)), F.lit("")), F.lit(other))


def clean_for_eval(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"[{PUNCTUATION}]", ""), r"\s+", "")


def parse_numeral(c: Column) -> Column:
    """CJK numerals from 0 to 99, or digits, as an int; null for anything else."""
    digits = "零一二三四五六七八九"
    names = {}
    for n in range(100):
        t, o = divmod(n, 10)
        names[digits[n] if n < 10 else (digits[t] if t > 1 else "") + "十" + (digits[o] if o else "")] = n
    names |= {"兩": 2, "〇": 0}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.when(c.rlike(r"^\d{1,9}$"), c.try_cast("int")))


def word_chars(words: Column, vocabulary: Column) -> Column:
    """Each word as one character by its place in ``vocabulary``, past the surrogates, so that levenshtein counts words."""
    code = lambda n: n + F.when(n < 0xD800, 0).otherwise(0x800)
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(code(F.array_position(vocabulary, w))), 8, "0")), "UTF-32")), "")


def logprob_confidence(logprob: Column) -> Column:
    return F.coalesce(F.round(F.exp(logprob.cast("double")), 4), F.lit(1.0))


#: Words after which radio speech is cut, and how a call begins.
SAID_LAST = r"(?<![\p{L}\p{N}_])(?i:over)(?![\p{L}\p{N}_])|收到|完畢|稍後|回報"
SAID_FIRST = r"[GgRr]\d{1,2}\s*(?:呼叫|站長|回報|通告)|OCC\s*(?:呼叫|通告|回報|回復)|站長\s*(?:回報|呼叫)"
#: Stands for a cut until the text is taken apart.
CUT = "\x01"


def split_sentences(c: Column, most: int = 40, least: int = 2) -> Column:
    """Sentences: every end mark, closing word, opening call and line end is marked as a cut, and the text taken apart once.

    What is still longer than ``most`` characters is filled up to the last space that fits, or cut where there is none.
    Pieces of under ``least`` characters go.
    """
    cuts = [("【[^】]*】", ""), (r"[。！？!?\n]+", CUT), (SAID_LAST, f"$0{CUT}"), (f"(?={SAID_FIRST})", CUT), ("[ \t]+", " ")]
    for pattern, mark in cuts:
        c = F.regexp_replace(c, pattern, mark)
    whole = F.transform(F.split(c, CUT), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.flatten(F.transform(whole, lambda x: F.regexp_extract_all(x, F.lit(rf"(?s)\S.{{0,{most - 1}}}(?=\s|\z)|\S{{1,{most}}}"), F.lit(0))))
    return F.filter(F.transform(lines, F.trim), lambda x: F.length(x) >= least)


def parse_bundle(c: Column, mark: str = r"\d{2}:\d{2}:\d{2}") -> Column:
    """array(name, body) of a text in which ``【mark】`` opens each record."""
    parts = F.filter(F.split(c, f"(?m)(?=^【{mark}】)"), lambda x: x.rlike(f"^【{mark}】"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, f"^【({mark})】", 1).alias("name"), F.trim(F.regexp_replace(x, f"^【{mark}】", ""), F.lit(" \n")).alias("body")))


def window_share(samples: Column, width: int, speech: Callable[[Column], Column]) -> Column:
    """Share of a signal's whole windows of ``width`` samples that ``speech`` accepts, what is left at the end aside.

    A signal shorter than a window is judged as a whole; of one that is null or empty nothing is known, which counts as speech.
    """
    n = F.size(samples)
    starts = F.sequence(F.lit(1), n - width + 1, F.lit(width))
    judged = F.transform(starts, lambda at: F.coalesce(speech(F.slice(samples, at, width)), F.lit(False)))
    whole = F.coalesce(speech(samples), F.lit(False)).cast("int").cast("double")
    return F.when(samples.isNull() | (n == 0), 1.0).when(n < width, whole).otherwise(F.round(F.size(F.filter(judged, lambda j: j)) / F.size(judged), 6))
