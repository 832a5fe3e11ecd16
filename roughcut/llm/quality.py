"""Quality rules: counts of a text, and a decision list of threshold conjunctions learned from labels."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import stored, text_or_empty

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Counts of a text, in output order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_letters", "n_upper", "n_digits", "n_marks", "n_distinct")
#: The base rule: fewer words than this, or a larger percentage of repeated words, fails.
LEAST_WORDS = 50
MOST_REPEATED = 50

_BLANK, _OTHER, _LETTER, _UPPER, _DIGIT, _SYMBOL, _MARK = range(7)


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane (those beyond count as others)."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in map(chr, range(0x10000)):
        if c.isalpha():
            out[ord(c)] = _UPPER if c.isupper() else _LETTER
        elif c.isdigit():
            out[ord(c)] = _DIGIT
    for group, kind in ((BLANKS, _BLANK), (SYMBOLS, _SYMBOL), ("!?", _MARK)):
        out[[ord(c) for c in group]] = kind
    return out


def repeated_words(codes: np.ndarray, size: int) -> int:
    """Words inside windows of three words that occur twice or more; ``codes`` below ``size``."""
    if len(codes) < 4:
        return 0
    pair = codes[:-1] * size + codes[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    seen, window, count = np.unique(pair[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k:len(codes) - 2 + k] |= again
    return int(covered.sum())


def count_text(text: str, classes: np.ndarray) -> tuple[int, ...]:
    """The :data:`COUNTS` of one text."""
    kinds = np.bincount(classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=7)
    words = text.encode().split()  # parts at exactly the six blanks
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - int(kinds[_BLANK]), int(kinds[_SYMBOL]), len(lines) - len(set(lines)),
            repeated_words(codes, len(known)), len(lines), int(kinds[_LETTER] + kinds[_UPPER]),
            int(kinds[_UPPER]), int(kinds[_DIGIT]), int(kinds[_MARK]), len(known))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the :data:`COUNTS` of every whole text.

    Words are parted by the six ASCII blanks; ``word_chars`` counts code points in words,
    ``n_symbols`` characters of :data:`SYMBOLS`, ``n_dup_lines`` lines with a word (parted by
    line feeds) that equal an earlier one, ``n_repeat_words`` words in windows of three words
    found twice or more in the text. A null text counts as empty. Rows stay as they are: null
    and repeated ids, one row each; an empty table gives an empty result. Other columns are
    not read.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes()
        for batch in batches:
            rows = np.array([count_text(t.as_py(), classes) for t in batch.column(1)], np.int64)
            columns = [pa.array(c) for c in rows.reshape(-1, len(COUNTS)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *COUNTS])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(counted, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COUNTS]]))


def base_failed() -> Column:
    """Whether a row of counts fails the base rule."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


#: What rules speak of, from the counts; shares are 0 where there is nothing to divide by.
#: Shares have thresholds at (k / 64)**2, sizes at 2**(k / 4) - 1, for every whole k.
SHARES = {"symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "n_letters"),
          "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "word_chars"),
          "letter_share": ("n_letters", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
          "repeat_share": ("n_repeat_words", "n_words"), "distinct_share": ("n_distinct", "n_words")}
SIZES = {"words": ("n_words", None), "word_length": ("word_chars", "n_words"), "line_words": ("n_words", "n_lines")}
FEATURES = (*SHARES, *SIZES)


def feature(name: str) -> Column:
    if name in SHARES:
        return _share(*SHARES[name])
    part, whole = SIZES[name]
    return F.col(part).cast("double") if whole is None else _share(part, whole)


def _bin(name: str) -> Column:
    """Number of the last threshold that the feature reaches (0: none but the least)."""
    x = feature(name)
    return (F.floor(F.sqrt(x) * 64) if name in SHARES else F.floor(F.log2(x + 1) * 4)).cast("int")


def _threshold(name: str, k: int) -> float:
    return (k / 64) ** 2 if name in SHARES else 2.0 ** (k / 4) - 1


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold k`` or ``feature < threshold k``."""
    name: str
    at_least: bool
    k: int

    def column(self) -> Column:
        t = F.lit(_threshold(self.name, self.k))
        return feature(self.name) >= t if self.at_least else feature(self.name) < t

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {_threshold(self.name, self.k):.4g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and the labelled rows of the pruning part that it hits."""
    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Rules in order; the first that holds decides, and a text that none holds for is kept."""
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """Number of the first rule that holds, from 1; 0 for none."""
        out = F
        for number, rule in enumerate(self.rules, 1):
            out = out.when(rule.column(), F.lit(number))
        return out.otherwise(F.lit(0)) if self.rules else F.lit(0)


def _gain(p: int, n: int, whole_p: int, whole_n: int) -> float:
    """FOIL's gain: bad rows kept, times the bits by which their share grew."""
    return p * (math.log2(p / (p + n)) - math.log2(whole_p / (whole_p + whole_n))) if p else 0.0


def _best_condition(hist: dict[tuple[int, int], np.ndarray], whole: np.ndarray,
                    least: int) -> tuple[Condition | None, np.ndarray]:
    """The condition of the largest gain, with the counts of the rows it leaves. ``hist``
    has counts [grow bad, grow good, prune bad, prune good] by feature and bin."""
    best, found, left = 1e-9, None, whole
    for f, name in enumerate(FEATURES):
        bins = sorted(k for g, k in hist if g == f)
        below = np.zeros(4, np.int64)
        for k in bins[1:]:
            below = below + hist[f, bins[bins.index(k) - 1]]
            for at_least, part in ((True, whole - below), (False, below)):
                gain = _gain(int(part[0]), int(part[1]), int(whole[0]), int(whole[1]))
                if part[0] >= least and gain > best:
                    best, found, left = gain, Condition(name, at_least, k), part
    return found, left


def learn_rules(labelled: DataFrame, bad_col: str = "bad", max_rules: int = 12, max_conditions: int = 4,
                min_hits: int = 5, min_precision: float = 0.9) -> DecisionList:
    """Learn a decision list for ``bad_col`` (boolean; null rows are left out) from rows of counts.

    Sequential covering: a rule grows by the condition of the largest FOIL gain until no
    condition gains, is cut back to the prefix that does best on the pruning third of the
    rows, and the rows it covers leave before the next rule grows. Learning ends with
    a rule that hits fewer than ``min_hits`` bad rows of the pruning part or is right on less
    than ``min_precision`` of them (that rule is dropped), or when no bad row is left.

    All labelled rows take part: each step is one aggregation of them into counts by feature
    and bin, some thousand rows whatever the table's size, which is all that reaches the
    driver. Rows are dealt to growing and pruning by a hash of their counts and id, and
    thresholds lie on a fixed grid, so equal tables give equal rules. Without labels of both kinds
    the list is empty.
    """
    part = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(3)) == 0
    rows = stored(labelled.where(F.col(bad_col).isNotNull()).select(
        F.col(bad_col).alias("__bad"), part.alias("__prune"), *COUNTS,
        F.array(*[_bin(f) for f in FEATURES]).alias("__bins")), "labelled")

    def counts(df: DataFrame) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
        table = (df.select("__bad", "__prune", F.posexplode("__bins").alias("f", "k"))
                 .groupBy("f", "k", "__bad", "__prune").count())
        hist: dict[tuple[int, int], np.ndarray] = {}
        for f, k, bad, prune, n in table.collect():  # features x bins x 4 rows
            hist.setdefault((f, k), np.zeros(4, np.int64))[2 * prune + (not bad)] += n
        return hist, sum((v for (f, _), v in hist.items() if f == 0), np.zeros(4, np.int64))

    learned = DecisionList()
    left = rows
    while len(learned.rules) < max_rules:
        hist, whole = counts(left)
        if not whole[0] or not whole[1]:
            break
        conditions: list[Condition] = []
        after: list[np.ndarray] = []
        inside, now = left, whole
        while len(conditions) < max_conditions and now[1]:
            found, now = _best_condition(hist, now, min_hits)
            if found is None:
                break
            conditions.append(found)
            after.append(now)
            if len(conditions) < max_conditions and now[1]:
                inside = inside.where(found.column())
                hist, now = counts(inside)
        if not conditions:
            break
        # the prefix with the best (bad - good) / (bad + good) on the pruning part; ties: the shorter
        worth = [(x[2] - x[3]) / max(x[2] + x[3], 1) for x in after]
        keep = int(np.argmax(worth)) + 1
        hits, misses = int(after[keep - 1][2]), int(after[keep - 1][3])
        if hits < min_hits or hits < min_precision * (hits + misses):
            break
        rule = Rule(tuple(conditions[:keep]), hits, misses)
        learned.rules.append(rule)
        left = left.where(~rule.column())
    return learned


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id_col: str = "doc_id", quality_col: str = "quality") -> tuple[DataFrame, DecisionList]:
    """The :data:`COUNTS` of every row of ``docs`` with ``base_failed``, ``rule`` (number of the
    learned rule that drops it, 0 for none) and ``kept``; and the rules.

    Learns from all rows of ``docs`` whose id has a label: quality 0 is bad, other values are
    good, null ones are left out; an id labelled more than once counts with its lowest
    quality. Null ids have no label. Rows with equal texts get equal verdicts; an empty table gives an
    empty result, and without labels only the base rule decides. See :func:`text_counts`.
    """
    counts = stored(text_counts(docs, id_col, text_col), "counts")
    bad = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(label_id_col).alias("__id")) \
        .agg((F.min(quality_col) == 0).alias("bad"))
    learned = learn_rules(counts.join(bad, F.col("doc_id") == F.col("__id")).drop("__id"))
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", learned.column())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), learned
