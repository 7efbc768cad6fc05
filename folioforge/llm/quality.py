"""Quality rules combined by weak supervision. DataFrame and SQL functions only.

Each rule votes for or against a document, or abstains. A label model in the manner of Dawid and Skene takes the true
quality as hidden and, by expectation-maximisation, estimates for each rule how often it gives each vote to good and to
bad documents. A document is kept if the posterior probability that it is good is at least one half. So a rule whose
votes against come with those of other rules counts for much, and one that hits good documents too counts for little:
no single rule need pass.

The model is fitted on the counts of vote patterns over all documents that pass the base checks; there are at most
3 ** rules patterns, whatever the size of the corpus, and only they reach the driver. Its result is a weight per rule
and vote, so scoring is a sum of literals. Weak priors fix which hidden class is the good one; nothing overrides the
posterior.

Features come from one row alone: no row is exploded and no text is shuffled. Where a text repeats many windows of
words, they are found by a sort, so the cost stays near-linear in its length.

Nulls: a null text has no words, and so fails the base; a null doc_id changes nothing. Repeated rows each give a row.
An empty table gives an empty result. ``score`` keeps all columns of the input and puts its own in one struct column
(``quality``, or another name that you give), so names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, only

_SPACE = r"[ \t-\r]+"
_STRIP = "' \\t\\n\\u000b\\f\\r'"
#: Up to so many distinct repeated windows, a text's words are marked by lookups, beyond by a sort.
FEW = 48


@dataclass(frozen=True)
class Rule:
    """Votes against where ``bad`` holds, else for where ``good`` holds; both are SQL over the features."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "n_symbols >= 0.3 * n_words", "n_symbols <= 0.05 * n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 7.5 * n_words", "word_chars between 3.8 * n_words and 6.8 * n_words"),
    Rule("letterless_words", "n_letterless > 0.2 * n_words", "n_letterless <= 0.05 * n_words"),
    Rule("line_ends", "n_closed_lines < 0.3 * n_lines", "n_closed_lines >= 0.7 * n_lines"),
    Rule("repeated_lines", "n_dup_lines > 0.4 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("repeated_windows", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("capitals", "n_upper > 0.5 * word_chars", "n_upper <= 0.2 * word_chars"),
)

_HASHES = "if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
_TWICE = "transform(array(sort_array(hs)), s -> array_distinct(filter(s, (x, i) -> i > 0 and x = s[i - 1])))[0]"
_BY_LOOKUP = "filter(sequence(0, size(hs) - 1), i -> array_contains(ds, hs[i]))"
_BY_SORT = (
    "sort_array(transform(array(sort_array(transform(hs, (x, i) -> struct(x as x, i as i)))), t -> transform(filter(t, (v, k) -> "
    "if(k > 0, t[greatest(k - 1, 0)].x = v.x, false) or if(k < size(t) - 1, t[least(k + 1, size(t) - 1)].x = v.x, false)), v -> v.i))[0])"
)
#: Words in windows of three words that are found twice: each marked window adds the words that the last didn't hold.
_REPEATED = (
    f"transform(array({_HASHES}), hs -> if(size(array_distinct(hs)) = size(hs), 0L, transform(array({_TWICE}), ds -> "
    f"aggregate(if(size(ds) <= {FEW}, {_BY_LOOKUP}, {_BY_SORT}), struct(-3 as p, 0L as n), (a, p) -> struct(p as p, a.n + least(3, p - a.p) as n), a -> a.n))[0]))[0]"
)


def _features(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    first = {
        "t": F.coalesce(text, F.lit("")),
        "words": F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != ""),
        "lines": F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""),
    }
    then = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_closed_lines": F.size(F.filter("lines", lambda x: F.right(F.rtrim(x), F.lit(1)).isin(".", "!", "?", ":", '"', "”", "»", "…", ")"))).cast("long"),
        "n_letterless": F.regexp_count("t", F.lit(r"(?<![^ \t-\r])[^ \t-\rA-Za-z\x{80}-\x{10FFFF}]+(?![^ \t-\r])")).cast("long"),
        "n_upper": F.regexp_count("t", F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long"),
        "n_repeat_words": F.expr(_REPEATED).cast("long"),
    }
    return first, then


def _vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), 2).when(F.expr(rule.good), 1).otherwise(0).alias(f"v_{rule.name}")


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (named so that nothing clashes), and the features."""
    first, then = _features(docs["text"])
    kept = [F.col(f"`{c}`") for c in keep]
    # inline() makes a row of each row; unlike a projection, no later filter or projection is folded into it, which
    # would split the text again for each of its words
    out = docs.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in first.items()]))))
    out = out.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in then.items()]))))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the features of each document."""
    return _with_features(only(documents, "doc_id", "text"), ["doc_id"])


def fit(found: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 300) -> tuple[float, list[list[float]]]:
    """The log-odds of a bad document before any vote, and what each vote (none, for, against) of each rule adds."""
    counts = found.filter("not base_failed").select(*[_vote(r) for r in rules]).groupBy(*[f"v_{r.name}" for r in rules]).count()
    patterns = {tuple(r)[:-1]: r["count"] for r in counts.collect()}
    bad = {p: 0.9 if 2 in p else 0.05 for p in patterns}
    prior = ((2.0, 8.0, 0.5), (2.0, 4.0, 2.0))
    odds, weights = 0.0, [[0.0, 0.0, 0.0] for _ in rules]
    for _ in range(rounds):
        n, b = sum(patterns.values()), sum(c * bad[p] for p, c in patterns.items())
        odds = math.log((b + 1) / (n - b + 9))
        seen = [[list(prior[0]), list(prior[1])] for _ in rules]
        for p, c in sorted(patterns.items()):
            for j, v in enumerate(p):
                seen[j][1][v] += c * bad[p]
                seen[j][0][v] += c * (1 - bad[p])
        weights = [[math.log(s[1][v] / sum(s[1])) - math.log(s[0][v] / sum(s[0])) for v in range(3)] for s in seen]
        now = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(w[v] for w, v in zip(weights, p)))))) for p in patterns}
        moved = max((abs(now[p] - bad[p]) for p in patterns), default=0.0)
        bad = now
        if moved < 1e-10:
            break
    return odds, weights


def verdict(found: DataFrame, model: tuple[float, list[list[float]]], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds p_good (posterior probability) and kept to the features."""
    odds, weights = model
    votes = found.withColumns({f"v_{r.name}": _vote(r) for r in rules})
    total = F.lit(odds)
    for r, w in zip(rules, weights):
        v = F.col(f"v_{r.name}")
        total = total + F.when(v == 2, w[2]).when(v == 1, w[1]).otherwise(w[0])
    votes = votes.withColumn("p_good", F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total)))))
    return votes.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def score(documents: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "quality") -> DataFrame:
    """The documents with all their columns and a struct of the features, p_good and kept. The texts are read twice:
    for the pattern counts and for the scores."""
    model = fit(features(documents), rules)
    names = documents.columns
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text").alias("text"))
    found = verdict(_with_features(packed, ["__row"]), model, rules)
    own = [c for c in found.columns if c != "__row"]
    return found.select(*[F.col("__row").getField(c).alias(c) for c in names], F.struct(*own).alias(column))


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns."""
    (column,) = fresh(documents, "__quality")
    return score(documents, rules, column).filter(F.col(column).kept).drop(column)


def weights_by_rule(model: tuple[float, list[list[float]]], rules: tuple[Rule, ...] = RULES) -> Mapping[str, dict[str, float]]:
    return {r.name: {"abstain": w[0], "for": w[1], "against": w[2]} for r, w in zip(rules, model[1])}
