"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes keep (1), reject (-1) or abstains (0).  Nobody labels texts: expectation
maximisation estimates how each rule votes on good and on bad texts, and every text gets the posterior
probability of being good.  A text that breaks one rule but convinces the others stays.

Texts that fail the base are decided already and are no part of the estimate, so that the two classes found are those of
the texts in question.

The main path is DataFrame expressions only.  EM sees one row per distinct vote pattern, of which there are at most
3 ** rules whatever the input, so these counts may go to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import SPACE_CLASS, at_places, fresh, located, words_of
from assaylake.session import materialise

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_shouts",
)


@dataclass(frozen=True)
class Rule:
    """Conditions over COUNTS in plain SQL.  Where neither holds, the rule abstains; ``reject`` is asked first."""

    name: str
    reject: str
    keep: str = "FALSE"


#: Several rules look at one fault from different sides, by which estimates can tell a fault from a chance reject; some
#: know only what is bad and abstain without it.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words", "50 * n_symbols <= n_words"),
    Rule("marks", "100 * n_symbols > 4 * word_chars", "200 * n_symbols <= word_chars"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 7 * n_words)",
         "n_words > 0 AND word_chars >= 4 * n_words AND 2 * word_chars <= 13 * n_words"),
    Rule("variety", "10 * n_distinct < 3 * n_words AND n_words >= 20", "10 * n_distinct > 6 * n_words AND n_words >= 20"),
    Rule("capitals", "2 * n_upper > word_chars"),
    Rule("shouts", "4 * n_shouts > n_words"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: A text counts as good from this posterior on.
KEEP_FROM = 0.5
ROUNDS = 20
@dataclass(frozen=True)
class Prior:
    """Where EM starts, and that counts in every estimate as ``texts`` texts of each class.

    ``good`` is the share of good texts; a rule votes keep and reject on good and on bad texts as often as ``rates`` says.
    A few texts only keep rates off 0 and 1.  Where every fault is seen by one rule alone, votes cannot tell faults from
    chance rejects, and what is known of the rules has to come in here, with more texts.
    """

    good: float
    rates: tuple[tuple[str, float], ...]
    texts: float

    def of(self, rate: str) -> float:
        return dict(self.rates)[rate]


PRIOR = Prior(0.8, (("keep_good", 0.9), ("keep_bad", 0.6), ("reject_good", 0.02), ("reject_bad", 0.3)), 20.0)


def counts(text: Column) -> Column:
    """The struct of COUNTS of a text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(*[v.cast("long").alias(k) for k, v in _counts(body, words_of(text)).items()])


def _counts(body: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.regexp_replace(body, SPACE_CLASS, "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.lit(0),
        "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", "")),
        "n_shouts": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
    }


def with_counts(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with the struct ``column`` of COUNTS.

    Repeated windows are found without leaving the row: window hashes and positions packed into longs, sorted, and
    neighbours compared.  As many low bits hold the position as the text needs, the others the hash; windows with equal
    hashes are then compared word by word.
    """
    words, packed, starts = (fresh(docs, f"{column}_{x}") for x in ("words", "packed", "starts"))
    out = docs.withColumn(words, words_of(F.col("text")))
    n = F.size(words)
    bits = F.ceil(F.log2(n + F.lit(1))).cast("int")
    bits_col = fresh(docs, f"{column}_bits")
    out = out.withColumn(bits_col, bits)
    # Three words of w from i on, hashed; the low bits give way to i.
    pack = F.expr(
        f"CASE WHEN size(`{words}`) >= 3 THEN sort_array(transform(slice(`{words}`, 1, size(`{words}`) - 2), (w, i) -> "
        f"shiftleft(xxhash64(w, `{words}`[i + 1], `{words}`[i + 2]), `{bits_col}`) | cast(i AS bigint))) "
        f"ELSE array() END"
    )
    out = out.withColumn(packed, pack)
    mask = f"(shiftleft(1L, `{bits_col}`) - 1)"
    at = lambda k: f"cast(`{packed}`[{k}] & {mask} AS int)"
    same = lambda a, b: (
        f"(shiftright(`{packed}`[{a}], `{bits_col}`) = shiftright(`{packed}`[{b}], `{bits_col}`) AND "
        + " AND ".join(f"`{words}`[{at(a)} + {j}] = `{words}`[{at(b)} + {j}]" for j in range(3)) + ")"
    )
    found = F.expr(
        f"CASE WHEN size(array_distinct(transform(`{packed}`, p -> shiftright(p, `{bits_col}`)))) = size(`{packed}`) "
        f"THEN cast(array() AS array<int>) ELSE "
        f"sort_array(transform(filter(transform(`{packed}`, (p, k) -> "
        f"CASE WHEN (k > 0 AND {same('k - 1', 'k')}) OR (k < size(`{packed}`) - 1 AND {same('k', 'k + 1')}) "
        f"THEN cast(p & {mask} AS int) END), x -> x IS NOT NULL), x -> x)) END"
    )
    out = out.withColumn(starts, found)
    covered = F.expr(
        f"CASE WHEN size(`{starts}`) = 0 THEN 0L ELSE aggregate(transform(`{starts}`, (s, k) -> "
        f"CASE WHEN k = size(`{starts}`) - 1 THEN 3 ELSE least(3, `{starts}`[k + 1] - s) END), 0L, (a, x) -> a + x) END"
    )
    parts = _counts(F.coalesce(F.col("text"), F.lit("")), F.col(words)) | {"n_repeat_words": covered}
    return out.withColumn(column, F.struct(*[parts[k].cast("long").alias(k) for k in COUNTS])).drop(
        words, bits_col, packed, starts
    )


def votes(rules: Sequence[Rule], source: str | None = None) -> list[Column]:
    """One column per rule: 1, -1 or 0, from the counts in the struct column ``source``."""
    return [F.expr(_bound(vote_sql(r), source)).alias(r.name) for r in rules]


def vote_sql(rule: Rule) -> str:
    return f"CASE WHEN {rule.reject} THEN -1 WHEN {rule.keep} THEN 1 ELSE 0 END"


def _bound(sql: str, source: str | None) -> str:
    if source is None:
        return sql
    return re.sub(rf"\b({'|'.join(COUNTS)})\b", lambda name: f"`{source}`.{name[0]}", sql)


@dataclass(frozen=True)
class LabelModel:
    """``good``: share of good texts; ``rates``: per rule the chances named in ``Prior.rates``."""

    good: float
    rates: tuple[dict[str, float], ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds to start from, and what a keep and a reject vote of each rule add; to abstain adds nothing."""
        return math.log(self.good / (1 - self.good)), [
            (math.log(r["keep_good"] / r["keep_bad"]), math.log(r["reject_good"] / r["reject_bad"])) for r in self.rates
        ]


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS, prior: Prior = PRIOR) -> LabelModel:
    """EM over (votes, number of texts)."""
    drawn = lambda seen, of, at: (seen + prior.texts * at) / (of + prior.texts)
    rates = dict(prior.rates)
    model = LabelModel(prior.good, (rates,) * n_rules)
    for _ in range(rounds):
        start, odds = model.weights()
        mass = {"good": 0.0, "bad": 0.0}
        seen = [dict.fromkeys(rates, 0.0) for _ in range(n_rules)]
        for pattern, n in patterns:
            score = start + sum(o[0] if v > 0 else o[1] if v < 0 else 0.0 for v, o in zip(pattern, odds))
            p = 1 / (1 + math.exp(-score))
            for kind, part in (("good", n * p), ("bad", n * (1 - p))):
                mass[kind] += part
                for v, s in zip(pattern, seen):
                    if v:
                        s[f"{'keep' if v > 0 else 'reject'}_{kind}"] += part
        model = LabelModel(
            drawn(mass["good"], mass["good"] + mass["bad"], prior.good),
            tuple({k: drawn(s[k], mass[k.split("_")[1]], at) for k, at in rates.items()} for s in seen),
        )
    return model


def posterior(model: LabelModel, rules: Sequence[Rule], source: str | None = None) -> Column:
    """The probability of being good, as an expression of the counts."""
    start, odds = model.weights()
    score = F.lit(start)
    for vote, (keep, reject) in zip(votes(rules, source), odds):
        score = score + F.when(vote > 0, F.lit(keep)).when(vote < 0, F.lit(reject)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, column: str = "quality", carry: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with a struct ``column``: COUNTS, ``base_failed``, ``p_good`` and ``kept``.

    ``kept`` is false where the base fails (under 50 words, or over half of the words in windows said twice), else
    ``p_good >= KEEP_FROM``.  A null text counts as empty and so fails.  Repeated rows are judged each, and those that pass
    the base count each in EM.  If ``docs`` has a column of that name, give another.  An empty table gives no rows.

    Counts are taken once and written, as EM and the verdict both read them; with ``carry`` only those columns of
    ``docs`` are written with them and returned.  Without it, the places of the rows are written and joined with ``docs``
    in the end, so that no copy of the texts stays on disk.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {column}; name another")
    rows = located(docs, "quality-input") if carry is None else docs
    counted = with_counts(rows, column)
    seen = materialise(counted.select(*(["_llm_file", "_llm_row"] if carry is None else carry), column), "quality")
    failed = F.expr(_bound(BASE_FAILED, column))
    patterns = seen.where(~failed).select(*votes(rules, column)).groupBy(*[r.name for r in rules]).count().collect()
    model = fit(sorted((tuple(row[:-1]), row[-1]) for row in patterns), len(rules))
    p_good = posterior(model, rules, column)
    judged = seen.withColumn(column, F.struct(
        f"{column}.*", failed.alias("base_failed"), p_good.alias("p_good"),
        (~failed & (p_good >= KEEP_FROM)).alias("kept"),
    ))
    return at_places(rows, judged, docs.columns, column) if carry is None else judged
