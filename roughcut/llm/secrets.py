"""Secret scanning: fixed patterns, and the guess cost of values in credential context."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import stored, text_or_empty

# Fixed patterns of the base kinds, with the least length of what each must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "guess")

# Credential context: a name, a copula or sign, and a value without spaces.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|auth[_ -]?key|"""
    r"""private[_ -]?key|credentials?|login)["']?[ \t]{0,4}(?:is|was|=>|->|:=|[:=])[ \t]{0,4}["'`]?"""
    r"""([^\s"'`]{6,})""", re.ASCII | re.IGNORECASE)
# the same for Java, in lower-case text, with the value
CONTEXT_JAVA = r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_ -]?key|auth[_ -]?key|""" \
    r"""private[_ -]?key|credentials?|login)["']?[ \t]{0,4}(?:is|was|=>|->|:=|[:=])[ \t]{0,4}["'`]?[^\s"'`]{6,}"""
_KEYWORDS = ("pass", "pwd", "secret", "token", "key", "credential", "login")

#: Values that take at least 10**MIN_GUESSES guesses are secrets.
MIN_GUESSES = 10.0
#: Words that guessers try first, most common first.
COMMON_WORDS = (
    "password", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "secret",
    "user", "test", "guest", "hello", "love", "sunshine", "princess", "football", "baseball",
    "iloveyou", "shadow", "superman", "batman", "trustno", "access", "default", "changeme",
    "example", "sample", "root", "system", "server", "database", "service", "token", "key",
    "pass", "pwd", "your", "my", "the", "here", "none", "null", "true", "false", "value",
    "string", "required", "public", "private", "local", "host", "summer", "winter", "spring",
    "autumn", "january", "monday", "company", "office", "money", "secure", "security", "super")
#: Words of prose are counted over the corpus: at most so many, each in at least so many
#: different texts outside credential context, of at least so many letters.
MOST_WORDS = 50_000
LEAST_TEXTS = 2
LEAST_LETTERS = 4
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz",
         "qazwsxedcrfvtgbyhnujmikolp", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
LEET = str.maketrans("4@8301!|5$7+2", "aabeoiiisstt" + "z")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")

_BRUTE = 1.0  # log10 of the guesses for a character that nothing explains
_SPLIT = 0.7  # log10 of the guesses that each further segment costs
_PAIRS = {w[i:i + 2] for walk in WALKS for w in (walk, walk[::-1]) for i in range(len(walk) - 1)}


class Words:
    """A ranked word list, most common first."""

    def __init__(self, words: Sequence[str]) -> None:
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


COMMON = Words(COMMON_WORDS)


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS,
                 least_texts: int = LEAST_TEXTS) -> list[str]:
    """The words (letters only, in lower case) that most rows of ``docs`` have, most frequent
    first (ties in code point order): the most frequent ones that are at most ``most`` (words as
    frequent as the first that does not fit stay out with it), each in at least
    ``least_texts`` (up to 64) different texts.

    What follows a credential name is left out, so a secret is no word however often it was
    copied, and equal texts count as one for the least number (texts fall into 64 classes by
    hash, of which a word must meet so many). All texts are counted, map-side first; only
    the list, bounded by ``most``, and how many words there are by frequency (some 1,500
    steps) reach the driver.
    """
    text = F.lower(text_or_empty(text_col))
    bare = F.regexp_replace(text, CONTEXT_JAVA, " ")
    found = F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"\p{{L}}{{{LEAST_LETTERS},}}"), 0))
    rows = docs.select(F.pmod(F.xxhash64(text), F.lit(64)).cast("int").alias("kind"), found.alias("found")) \
        .select("kind", F.explode("found").alias("word"))
    counted = rows.groupBy("word").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, kind)")).alias("kinds"))
    # exact up to 1,024 rows, then 16 steps an octave
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 16))
    counted = stored(counted.where(F.bit_count("kinds") >= least_texts).select("word", "n", step.alias("step")), "words")
    room, cut = most, None
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        cut = r["step"]
    if cut is None:
        return []
    return [r["word"] for r in sorted(counted.where(F.col("step") >= cut).collect(), key=lambda r: (-r["n"], r["word"]))]


def guess_cost(value: str, words: Words | Sequence[str] = COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    Segments are words (by rank, with letter case and look-alike digits at a
    surcharge), dates, repeats of one character or of a short block, keyboard or
    alphabet walks, and brute-force characters. ``best[i]`` is the least cost of
    the first i characters, ``forced[i]`` the least of those that end in brute
    force (which the next character continues without a split); every rule adds
    edges into later positions, so the time is linear in the length for a given
    word list.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    known = words if isinstance(words, Words) else Words(words)
    rank, longest = known.rank, known.longest
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i] in "0123" and (m := _DATE.match(low, i)):
            dates.setdefault(i, []).append(m.end())
    best = [0.0] + [math.inf] * n
    forced = [math.inf] * (n + 1)

    def relax(at: int, cost: float) -> None:
        if cost < best[at]:
            best[at] = cost

    run = 1  # length of the run of one character that ends here, and of the walk
    walk = 1
    for i in range(n):
        base = best[i]
        forced[i + 1] = _BRUTE + min(forced[i], base + (_SPLIT if i else 0.0))
        relax(i + 1, forced[i + 1])
        joint = _SPLIT if i else 0.0
        for end in range(i + 3, min(n, i + longest) + 1):
            word = low[i:end] if low[i:end] in rank else plain[i:end]  # as it is, or with look-alikes
            r = rank.get(word)
            if r:
                piece = value[i:end]
                cost = math.log10(r) + 0.3
                cost += 0.0 if piece == low[i:end] else 0.3 if piece[1:] == low[i + 1:end] else 1.0
                cost += 0.3 * sum(a != b for a, b in zip(low[i:end], word))
                relax(end, base + joint + cost)
        for end in dates.get(i, ()):
            relax(end, base + joint + (2.1 if end - i == 4 else 4.3))
        # runs and walks that end at position i + 1, from where they began
        run = run + 1 if i and low[i] == low[i - 1] else 1
        walk = walk + 1 if i and low[i - 1:i + 1] in _PAIRS else 1
        for length in (run, walk):
            if length >= 3:
                start = i + 1 - length
                relax(i + 1, best[start] + (_SPLIT if start else 0.0) + 1.7 + math.log10(length))
        # blocks of 2 to 8 characters that repeat the ones just before them
        for b in range(2, 9):
            if i + b <= n and i >= b and low[i - b:i] == low[i:i + b]:
                relax(i + b, base + 0.3)
    return best[n]


def is_guarded(value: str, words: Words | Sequence[str] = COMMON,
               min_guesses: float = MIN_GUESSES) -> bool:
    """Whether a value in credential context is hard to guess: what is not in ``words`` is
    dear, in letters of one case as well."""
    return guess_cost(value, words) >= min_guesses


def find_secrets(text: str | None, words: Words | Sequence[str] = COMMON,
                 min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` in code points, end exclusive, by start and kind order."""
    if not text:
        return []
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_MIN]
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_MIN]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}>")
            if len(value) >= 6 and is_guarded(value, words, min_guesses):
                found.append((m.start(1), m.start(1) + len(value), "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_spans(text: Column, words: Words | Sequence[str] = COMMON,
                 min_guesses: float = MIN_GUESSES) -> Column:
    """Struct of counts, the digest of the base spans and all spans for a text column."""
    words = words if isinstance(words, Words) else Words(words)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                spans = find_secrets(t, words, min_guesses)
                base = [s for s in spans if s[2] != "guess"]
                rows.append([sum(s[2] == k for s in spans) for k in KINDS]
                            + [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)])
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess",
                                              "base_sha256", "spans"])
    return run(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: Words | Sequence[str] | None = None,
                 min_guesses: float = MIN_GUESSES) -> DataFrame:
    """One row per row of ``docs``:
    ``doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` of every match over the whole text. The
    base kinds are fixed patterns; ``guess`` is the value after a credential name
    ("password is ...") whose guess cost is at least ``10**min_guesses``, whatever
    letters it has. Words are cheap to guess: the fixed :data:`COMMON_WORDS` first,
    then ``words`` by rank, by default those of the corpus itself (:func:`corpus_words`); a word
    that the corpus uses nowhere else counts as a secret from ten letters on. Spans
    of different kinds may overlap. A null or empty text has no spans (the digest
    is that of the empty string). No shuffle; repeated rows get equal answers; an
    empty table gives an empty result; other columns are not read.
    """
    if words is None:
        words = Words([*COMMON_WORDS, *corpus_words(docs, text_col)])
    got = docs.select(F.col(id_col).alias("doc_id"),
                      secret_spans(F.col(text_col), words, min_guesses).alias("s"))
    return got.select("doc_id", "s.*")
