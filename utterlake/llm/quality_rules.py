"""Weak supervision by quality rules, in DataFrame functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). A latent-class model without gold labels is
fitted by expectation-maximisation: documents are good, or bad in one of as many ways as there are rules, and of
each class the fit estimates its share and how each rule votes on it (its accuracies). A document's posterior
probability of being good replaces "all rules must pass". With one bad class alone, junk of a rarer kind that only
one rule knows would be outvoted by the rules that look for other kinds. A bad class belongs to its rule by the prior
alone; how that rule votes on it is estimated like all else.

The votes of all documents enter the fit as counts of vote patterns (at most 3 to the power of the number of
rules, whatever the input); the rounds of EM run over that small array in one expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words, written

SYMBOLS, WORD_CHAR = "[#*$%&|<>]", "[^\\x20\\x09-\\x0D]"
RULES = ("symbols", "word_length", "repetition", "duplicate_lines", "upper_case", "sentences")


def repeated_words(w: Column) -> Column:
    """Words in windows of three words that are found twice or more in ``w``, the first find included."""

    def covered(h: Column) -> Column:
        # Equal windows stand side by side once (hash, position) is sorted.
        def runs(s: Column) -> Column:
            same = lambda i, j: s[i]["h"] == s[j]["h"]
            last = F.size(s) - 1
            hit = F.filter(F.sequence(F.lit(0), last), lambda i: F.when((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), True).otherwise((i < last) & same(F.least(i + 1, last), i)))
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(s[i]["p"], s[i]["p"] + 1, s[i]["p"] + 2)))))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(pairs), runs))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, covered)).cast("long")


def features(text: Column) -> Column:
    """A struct of what the rules look at; for null as for the empty text."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))

        def counted(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
                F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("n_stops"),
            )

        return let(words(t), counted)

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """The vote of each rule. Without words every rule abstains."""
    n, chars = f["n_words"], f["word_chars"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    length, symbols = chars / n, f["n_symbols"] / chars
    repeat, dup, upper = f["n_repeat_words"] / n, f["lines"]["dup"] / f["lines"]["all"], f["n_upper"] / chars
    return {
        "symbols": vote(symbols > 0.05, symbols <= 0.005),
        "word_length": vote((length > 7) | (length < 3), (length >= 4.2) & (length <= 6.3)),
        "repetition": vote(repeat > 0.3, repeat < 0.1),
        "duplicate_lines": vote(dup > 0.4, dup < 0.05),
        "upper_case": vote(upper > 0.25, upper < 0.1),
        "sentences": vote((f["n_stops"] > 0.6 * n) | ((f["n_stops"] == 0) & (n > 100)), (f["n_stops"] > 0) & (f["n_stops"] < 0.3 * n)),
    }


M = len(RULES)
#: How rules vote on good documents before any data, and a rule on the kind of junk it looks for: against, abstain, for.
GOOD, JUNK = (0.02, 0.18, 0.8), (0.9, 0.05, 0.05)
#: Weight of these priors, in documents; share of good documents before any data.
STRENGTH, PRIOR = 50.0, 0.8


@dataclass(frozen=True)
class Fitted:
    """log_share: of each class, good first. log_vote: of each class and rule, for the votes -1, 0 and 1."""

    log_share: tuple[float, ...]
    log_vote: tuple[tuple[tuple[float, float, float], ...], ...]

    def posterior(self, v: list[Column]) -> Column:
        """The probability that a document with these votes is good."""

        def joint(c: int) -> Column:
            total = F.lit(self.log_share[c])
            for x, (against, none, good) in zip(v, self.log_vote[c], strict=True):
                total = total + F.when(x == -1, against).when(x == 1, good).otherwise(none)
            return total

        first = joint(0)
        odds = sum((F.exp(joint(c) - first) for c in range(1, M + 1)), F.lit(1.0))
        return 1 / odds


def _prior(c: int, j: int) -> tuple[float, float, float]:
    return JUNK if c == j + 1 else GOOD


def _round(patterns: Column, acc: Column) -> Column:
    """One round of EM. patterns: struct(v array<int>, n double); acc: struct(share array, vote array<array<array>>), as logarithms."""
    classes, rules = F.sequence(F.lit(0), F.lit(M)), F.sequence(F.lit(0), F.lit(M - 1))
    add = lambda a, x: a + x

    def shared_out(p: Column) -> Column:
        joint = F.transform(classes, lambda c: acc["share"][c] + F.aggregate(rules, F.lit(0.0), lambda s, j: s + acc["vote"][c][j][p["v"][j] + 1]))

        def scaled(x: Column) -> Column:
            top = F.array_max(x)
            return let(F.transform(x, lambda y: F.exp(y - top)), lambda e: F.transform(e, lambda y: p["n"] * y / F.aggregate(e, F.lit(0.0), add)))

        return F.struct(p["v"].alias("v"), let(joint, scaled).alias("w"))

    def estimated(q: Column) -> Column:
        total = F.aggregate(patterns, F.lit(0.0), lambda s, p: s + p["n"])
        weight = lambda c: F.aggregate(q, F.lit(0.0), lambda s, p: s + p["w"][c])
        before = lambda c: F.when(c == 0, PRIOR).otherwise((1 - PRIOR) / M)
        share = F.transform(classes, lambda c: F.log((weight(c) + STRENGTH * before(c)) / (total + STRENGTH)))

        def vote(c: Column, j: Column, k: Column) -> Column:
            seen = F.aggregate(q, F.lit(0.0), lambda s, p: s + F.when(p["v"][j] + 1 == k, p["w"][c]).otherwise(0.0))
            prior = F.when(c == j + 1, F.array(*map(F.lit, JUNK))[k]).otherwise(F.array(*map(F.lit, GOOD))[k])
            return F.log((seen + STRENGTH * prior) / (weight(c) + STRENGTH))

        votes = F.transform(classes, lambda c: F.transform(rules, lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: vote(c, j, k))))
        return F.struct(share.alias("share"), votes.alias("vote"))

    return let(F.transform(patterns, shared_out), estimated)


def fit(features_of: DataFrame, f: Column, rounds: int = 25) -> Fitted:
    """EM over the vote patterns of all rows, ``f`` being their features; an empty table gives the priors."""
    v = let(f, lambda f: F.array(*votes(f).values()))
    counted = features_of.select(v.alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    # One row per pattern, 3 ** M at most.
    patterns = counted.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    log = lambda x: F.log(F.lit(x))
    share = F.array(log(PRIOR), *[log((1 - PRIOR) / M)] * M)
    vote = F.array(*[F.array(*[F.array(*map(log, _prior(c, j))) for j in range(M)]) for c in range(M + 1)])
    start = F.struct(share.alias("share"), vote.alias("vote"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda acc, _: _round(F.col("p"), acc))
    r = patterns.select(done.alias("r")).first()["r"]
    return Fitted(tuple(r["share"]), tuple(tuple(tuple(x) for x in c) for c in r["vote"]))


def verdict(f: Column, model: Fitted, least: float = 0.5) -> Column:
    """A struct: base_failed, posterior and kept."""
    good = let(F.array(*votes(f).values()), lambda v: model.posterior([v[j] for j in range(M)]))
    failed = base_failed(f)
    return let(good, lambda p: F.struct(failed.alias("base_failed"), p.alias("posterior"), (~failed & (p >= least)).alias("kept")))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, the base features, the posterior and the verdict.

    Null and empty texts have no words and fail the base. Equal texts get equal verdicts. Other columns are ignored,
    whatever their names. An empty table gives no rows. The features, a few numbers per row, are written once, so
    that the fit and the verdicts don't read the texts twice.
    """
    r = written(docs.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("f")), "quality-features")
    r = r.withColumn("v", verdict(F.col("f"), fit(r, F.col("f")), least))
    base = [F.col(f"f.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols")]
    return r.select(F.col("id").alias(id_col), *base, F.col("f.lines.dup").alias("n_dup_lines"), F.col("f.n_repeat_words"), F.col("v.base_failed"), F.col("v.posterior"), F.col("v.kept"))


def keep(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with their columns. Reads the texts twice rather than write them."""
    model = fit(docs, features(F.col(text_col)))
    return docs.where(let(features(F.col(text_col)), lambda f: verdict(f, model, least))["kept"])
