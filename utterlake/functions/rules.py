"""Rule tables compiled to column expressions. Rules are few and known before the data is read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def replace_all(c: Column, rules: dict[str, str], longest_first: bool = True) -> Column:
    """Literal replaces in order: longest key first, or as listed."""
    keys = sorted(rules, key=lambda k: (-len(k), k)) if longest_first else list(rules)
    for k in keys:
        c = F.replace(c, F.lit(k), F.lit(rules[k]))
    return c


def replace_log(c: Column, rules: dict[str, str], stage: str, longest_first: bool = True) -> Column:
    """The change log of the same: array of (stage, from, to, count) of the rules that changed something."""
    keys = sorted(rules, key=lambda k: (-len(k), k)) if longest_first else list(rules)
    log = []
    for k in keys:
        log.append(F.struct(F.lit(stage).alias("stage"), F.lit(k).alias("from"), F.lit(rules[k]).alias("to"), count_of(c, k).alias("count")))
        c = F.replace(c, F.lit(k), F.lit(rules[k]))
    return F.filter(F.array(*log), lambda x: x["count"] > 0)


@dataclass(frozen=True)
class Contextual:
    """``wrong`` becomes ``right`` between ``prefix`` and ``suffix``, each at most ``gap`` characters away."""

    prefix: str
    wrong: str
    suffix: str
    right: str
    gap: int = 0


def context_pattern(r: Contextual) -> str:
    before = f"(?<={re.escape(r.prefix)})" if r.prefix else ""
    after = f"(?={re.escape(r.suffix)})" if r.suffix else ""
    return f"{before}(.{{0,{r.gap}}}){re.escape(r.wrong)}(.{{0,{r.gap}}}){after}"


def contextual(c: Column, rules: list[Contextual]) -> Column:
    for r in rules:
        if r.right != r.wrong:
            c = F.regexp_replace(c, context_pattern(r), f"$1{r.right}$2")
    return c


def contextual_changes(c: Column, rules: list[Contextual]) -> Column:
    """How many places the rules change, each rule in the text that the one before leaves."""
    n = F.lit(0)
    for k, r in enumerate(rules):
        if r.right != r.wrong:
            n = n + F.regexp_count(contextual(c, rules[:k]), F.lit(context_pattern(r)))
    return n


def by_engine(engine: Column, c: Column, rules: dict[str, str], overlays: dict[str, dict[str, str | None]]) -> Column:
    """Literal replaces by ``rules`` as each engine's overlay changes them: a new key is added, a known one replaced, one with None removed."""
    out = None
    for name, overlay in overlays.items():
        mine = {k: v for k, v in (rules | overlay).items() if v is not None}
        fixed = replace_all(c, mine)
        out = F.when(engine == name, fixed) if out is None else out.when(engine == name, fixed)
    return replace_all(c, rules) if out is None else out.otherwise(replace_all(c, rules))


#: Stages of ``post_process`` in their order; all are on unless switched off.
STAGES = ("terms", "car", "number", "dict", "context")


def post_process(df: DataFrame, text_col: str, terms: dict[str, str], dictionary: dict[str, str], context: list[Contextual], off: tuple[str, ...] = (), spoken_cars: bool = True) -> DataFrame:
    """``df`` with ``after_<stage>`` for each stage, ``final`` (the last of them) and ``changes``.

    ``changes`` is a map from stage to count: replacements by literal and contextual rules, and numbers that are written in
    another way. A stage in ``off`` passes the text on; without ``spoken_cars`` car numbers are those in digits alone. Null stays null, without changes.
    """
    steps = {
        "terms": lambda c: replace_all(c, terms), "car": lambda c: numbers.normalize_car_numbers(c, spoken_cars), "number": numbers.normalize_numbers,
        "dict": lambda c: replace_all(c, dictionary, longest_first=False), "context": lambda c: contextual(c, context),
    }
    summed = lambda log: F.aggregate(log, F.lit(0), lambda s, x: s + x["count"])
    counted = {
        "terms": lambda c: summed(replace_log(c, terms, "terms")), "car": lambda c: numbers.car_number_changes(c, spoken_cars), "number": numbers.number_changes,
        "dict": lambda c: summed(replace_log(c, dictionary, "dict", longest_first=False)), "context": lambda c: contextual_changes(c, context),
    }
    before, counts = F.col(text_col), []
    for stage in STAGES:
        after = before if stage in off else steps[stage](before)
        df = df.withColumn(f"after_{stage}", after)
        after = F.col(f"after_{stage}")
        counts += [F.lit(stage), F.lit(0) if stage in off else F.coalesce(counted[stage](before), F.lit(0))]
        before = after
    return df.withColumn("final", before).withColumn("changes", F.create_map(*counts))
