"""Quality rules: a decision list learned by sequential covering.

Statistics of whole texts are counted in Arrow batches; the list is learned from a bounded
number of labelled rows (``max_rows``, the rows with the smallest md5 of their id, so the choice is
the same on every run) and applied as an ordered Spark conditional expression.

A rule is a conjunction of thresholds. It is grown on two thirds of the rows by the condition with
the largest information gain until it covers no good row, pruned on the remaining third to the prefix
with the best (p - n) / (p + n), and dropped rows it covers are removed before the next one is grown.
Learning ends when a rule is wrong for more than ``max_error`` of the pruning rows it covers.

Null and empty texts have zero in every statistic and fail the base rule. Repeated rows are
treated one by one. A document without a finite statistic cannot occur; all ratios divide by at
least one. With no labelled row of either class the list is empty and the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import BYTE_CODES, LEADS, NOT_SPACE, Texts, covered, lines_of, mix, repeats, totals, words_of
from cutsites.llm.common import per_text

WINDOW = 8
MAX_ROWS = 20_000
_b = np.arange(256)
_SYMBOLS = np.isin(_b, list(b"#*$%&|<>"))
_UPPER = (_b >= 65) & (_b <= 90)
_EXCLAIM = np.isin(_b, list(b"!?"))

STATISTICS = [
    T.StructField(n, T.LongType(), False)
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
]

#: The numbers that conditions compare, as SQL over the statistics.
RATIOS = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaim / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def text_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """Counts per text; see ``STATISTICS``."""
    inside = NOT_SPACE[texts.data]
    words = words_of(texts, NOT_SPACE, BYTE_CODES)
    at, window = words.windows(WINDOW)
    again, _ = repeats(mix(window ^ mix(words.text[at] + 1)))
    repeated = covered(at[again], at[again] + WINDOW, len(words))
    lines = lines_of(texts)
    holds = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(inside, out=holds[1:])
    wordy = holds[lines.end] > holds[lines.start]
    _, earlier = repeats(mix(lines.hash[wordy] ^ mix(lines.text[wordy] + 1)))
    duplicate = np.zeros(len(lines), bool)
    duplicate[wordy] = earlier
    return {
        "n_words": words.counts,
        "word_chars": texts.count(inside & LEADS[texts.data]),
        "n_symbols": texts.count(_SYMBOLS[texts.data]),
        "n_dup_lines": totals(duplicate, lines.first),
        "n_repeat_words": totals(repeated, words.first),
        "n_lines": totals(wordy, lines.first),
        "n_upper": texts.count(_UPPER[texts.data]),
        "n_exclaim": texts.count(_EXCLAIM[texts.data]),
    }


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return per_text(docs, text_statistics, STATISTICS, keep)


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"({RATIOS[self.ratio]}) {'>' if self.above else '<='} {self.limit!r}D"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    flags = np.ones(n, bool)
    for c in rule:
        flags &= x[c.ratio] > c.limit if c.above else x[c.ratio] <= c.limit
    return flags


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition with the largest gain of bad rows, weighted by how many it keeps."""
    p0, n0 = bad.sum(), (~bad).sum()
    base, best = np.log2(p0 / (p0 + n0)), None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        ends = np.flatnonzero(v[1:] != v[:-1])  # a threshold between unequal neighbours
        if not len(ends):
            continue
        p, n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
        for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int = 4) -> Rule:
    rule: Rule = ()
    rows = np.arange(len(bad))
    while len(rule) < max_conditions and (~bad[rows]).any() and bad[rows].any():
        found = _best({k: v[rows] for k, v in x.items()}, bad[rows])
        if found is None or found[0] <= 1e-9:
            break
        rule += (found[1],)
        rows = rows[_holds((found[1],), {k: v[rows] for k, v in x.items()}, len(rows))]
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of the rule that is worth most on rows it was not grown on."""
    worth = []
    for k in range(1, len(rule) + 1):
        hit = _holds(rule[:k], x, len(bad))
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        worth.append((p - n) / (p + n) if p + n else -1.0)
    return rule[: int(np.argmax(worth)) + 1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_error: float = 0.05, least: int = 3) -> list[Rule]:
    """Rules, first match first, whose match means that the document is rejected."""
    rules: list[Rule] = []
    rows = np.arange(len(bad))
    while len(rules) < max_rules and bad[rows].any() and (~bad[rows]).any():
        grows, prunes = rows[rows % 3 != 0], rows[rows % 3 == 0]
        if not bad[grows].any():
            break
        sub = lambda r: ({k: v[r] for k, v in x.items()}, bad[r])
        rule = grow(*sub(grows))
        if rule and len(prunes):
            rule = prune(rule, *sub(prunes))
        if not rule:
            break
        hit = _holds(rule, {k: v[rows] for k, v in x.items()}, len(rows))
        p, n = (hit & bad[rows]).sum(), (hit & ~bad[rows]).sum()
        if p < least or n > max_error * (p + n):
            break
        rules.append(rule)
        rows = rows[~hit]
    return rules


def rejects(rules: list[Rule]) -> F.Column:
    """The list as one conditional: number of the first rule that holds, 0 for none."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(F.expr(" and ".join(c.sql() for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled rows.

    Rows of one id with equal statistics count once. Rows without id or label are ignored; an id labelled twice counts with its smaller label.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
        .withColumn("__order", F.expr("md5(cast(doc_id as string))")).orderBy("__order", "doc_id").limit(max_rows)
    )
    # At most max_rows ids and marks: the bound that allows the broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    rows = (
        statistics(chosen, ["__quality", "__order"]).dropDuplicates(["__order", *[f.name for f in STATISTICS]])
        .orderBy("__order", *[f.name for f in STATISTICS]).limit(max_rows)
        .selectExpr("__quality", *[f"{sql} as {name}" for name, sql in RATIOS.items()]).toPandas()
    )
    return learn({n: rows[n].to_numpy(float) for n in RATIOS}, rows["__quality"].to_numpy() == 0)


def apply(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (0 if none matched) and ``kept`` for every row."""
    return (
        statistics(docs, keep)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("rule", rejects(rules))
        .withColumn("kept", F.expr("not base_failed and rule = 0"))
    )
