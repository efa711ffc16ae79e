"""Quality rules as a decision list learned by sequential covering.

Every text gives a row of statistics. From labelled rows a list of rules for the rejected class is
learned one rule at a time: a conjunction of thresholds grows on two thirds of the rows by the
information it gains, is pruned on the other third, and the rows that it covers leave. The list is
emitted as one Spark expression, when(rule, verdict).when(...).otherwise(default).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, rows, strings, written

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_ends", "n_lines")
#: What the rules may test: name and (numerator, denominator) of the counts.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "ends_per_word": ("n_ends", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
FEATURES = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that are learned from, at most (by a hash of the id). A rule stands if
    on the pruning rows it is right in `precision` of what it covers, and covers `least` rows."""

    sample: int = 12_000
    conditions: int = 4
    rules: int = 24
    precision: float = 0.8
    least: int = 2
    splits: int = 256
    seed: int = 7


def repeated_words(words: list[bytes], width: int) -> int:
    """How many words lie in a window of `width` words that the text holds twice or more.

    Windows are told apart exactly: words are numbered, then numbers of twice the length come from
    pairs of numbers (and of overlapping pairs for the rest of the width)."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    length = 1
    while length < width:
        step = min(length, width - length)
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length += step
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts_of(text: str, width: int = 8) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.encode().split()  # splits bytes at [\x20\x09-\x0D]
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, width),
        len(set(words)),
        upper,
        sum(map(text.count, "0123456789")),
        sum(map(text.count, ".!?")),
        len(lines),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, COUNTS as long, FEATURES as double), one row for each row of docs.

    A null text has no words. A text is held whole in a task, however long, and texts are taken in
    slices of bounded size. A ratio over nothing is 0."""
    of = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                schema = pa.schema([part.schema.field(0), *((c, pa.int64()) for c in COUNTS)])
                found = [counts_of(t) for t in strings(part.column(1))]
                yield rows(schema, doc_id=part.column(0), **dict(zip(COUNTS, zip(*found))))

    made = of.mapInArrow(run, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return made.select("*", *(ratio(a, b).alias(name) for name, (a, b) in RATIOS.items()))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.col(self.feature).cast("double")
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order: the first that holds rejects; no rule, kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def rejected(self, x: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([_holds(r, x) for r in self.rules]) if self.rules else np.zeros(len(x), dtype=bool)

    def _chain(self, verdict, default) -> Column:
        found = None
        for i, rule in enumerate(self.rules):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            found = F.when(test, verdict(i)) if found is None else found.when(test, verdict(i))
        return default if found is None else found.otherwise(default)

    def column(self) -> Column:
        """The list as an ordered conditional over statistics(): true where a document is kept."""
        return self._chain(lambda i: F.lit(False), F.lit(True))

    def reason(self) -> Column:
        """The first rule that holds, as text; null where none does."""
        return self._chain(lambda i: F.lit(" and ".join(map(str, self.rules[i]))), F.lit(None).cast("string"))


def _holds(rule: Iterable[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _bits(p, n):
    return np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9))


def _best_condition(x: np.ndarray, y: np.ndarray, splits: int) -> Condition | None:
    """The threshold whose side gains most: positives kept times the bits saved on each of them."""
    before, best, found = _bits(y.sum(), (~y).sum()), 1e-9, None
    for f, name in enumerate(FEATURES):
        order = np.argsort(x[:, f], kind="stable")
        v, positive = x[order, f], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts) > splits:
            cuts = cuts[np.linspace(0, len(cuts) - 1, splits).astype(int)]
        if not len(cuts):
            continue
        p = np.cumsum(positive)[cuts]
        n = cuts + 1 - p
        for above, pos, neg in ((False, p, n), (True, y.sum() - p, (~y).sum() - n)):
            gain = pos * (_bits(pos, neg) - before)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return found


def _grown(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < s.conditions and (~y[inside]).any():
        c = _best_condition(x[inside], y[inside], s.splits)
        if c is None:
            break
        rule.append(c)
        inside &= c.holds(x)
    return tuple(rule)


def _worth(rule: tuple[Condition, ...], x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """(p - n) / (p + n) on these rows, and how many are covered."""
    inside = _holds(rule, x)
    p, n = int(y[inside].sum()), int((~y[inside]).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p + n


def _pruned(rule: tuple[Condition, ...], x: np.ndarray, y: np.ndarray) -> tuple[Condition, ...]:
    """The rule without its last conditions, as many as leaves it most right on the pruning rows."""
    worth = [_worth(rule[:k], x, y)[0] for k in range(1, len(rule) + 1)]
    return rule[: 1 + int(np.argmax(worth))]


def learn(x: np.ndarray, rejected: np.ndarray, settings: Settings = Settings()) -> DecisionList:
    """Sequential covering over x[row, FEATURES]; rejected marks the rows that rules are learned for."""
    made, s = DecisionList(), settings
    random = np.random.default_rng(s.seed)
    for _ in range(s.rules):
        if not rejected.any():
            break
        part = random.permutation(len(x)) % 3 > 0
        rule = _grown(x[part], rejected[part], s)
        if not rule:
            break
        rule = _pruned(rule, x[~part], rejected[~part])
        worth, covered = _worth(rule, x[~part], rejected[~part])
        if covered < s.least or worth < 2 * s.precision - 1:
            break
        made.rules.append(rule)
        left = ~_holds(rule, x)
        x, rejected = x[left], rejected[left]
    return made


def sampled(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and the rejected mark of at most settings.sample labelled rows, chosen by a hash of
    the id. labels: (doc_id, quality); quality 1 anywhere makes a document good, null counts for nothing."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = stats.join(marks, "doc_id").select(*FEATURES, "quality", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS[:1]).limit(settings.sample)
    table = drawn.select(*(F.col(f).cast("double").alias(f) for f in FEATURES), (F.col("quality") != 1).alias("rejected")).toArrow()
    return np.stack([table[f].to_numpy() for f in FEATURES], axis=1).reshape(-1, len(FEATURES)), table["rejected"].to_numpy().astype(bool)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs -> statistics, base_failed, kept, and reason: the rule that rejected a text.

    Texts are scanned once: their statistics are written to the shared folder, of which labelled rows
    are learned from and all are judged. Without labelled rows no rule is learned. Repeated rows are
    judged alike; an empty table gives an empty one; other columns of docs are not read."""
    stats = written(statistics(docs.select("doc_id", "text")), "quality-statistics")
    rules = learn(*sampled(stats, labels, settings), settings)
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & rules.column()).alias("kept"), rules.reason().alias("reason"))
