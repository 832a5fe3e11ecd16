"""Periodic run detection: the stretches of a text in which the same words come again and again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import text_or_empty
from roughcut.llm.runs import runs

#: A run has at least this many words and at least so many periods.
RUN_WORDS = 24
RUN_TIMES = 3
#: Words whose suffixes are sorted together; a longer text is sorted by itself.
BATCH_WORDS = 1 << 19

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _of_texts(texts: list[list[bytes]], least: int, times: int) -> list[tuple[np.ndarray, ...]]:
    """Runs of each text, given as its words."""
    codes, first = [], np.zeros(len(texts) + 1, np.int64)
    base = 0
    for t, text in enumerate(texts):
        known: dict[bytes, int] = {}
        part = np.array([known.setdefault(w, len(known)) for w in text] + [len(known)], np.int64)
        codes.append(part + base)  # the last code closes the text and occurs once
        base += len(known) + 1
        first[t + 1] = first[t] + len(part)
    start, length, period = runs(np.concatenate(codes), np.repeat(first[:-1], np.diff(first)), least, times)
    cut = np.searchsorted(start, first)
    return [(start[a:b] - f, length[a:b], period[a:b]) for a, b, f in zip(cut[:-1], cut[1:], first)]


def _collapsed(text: list[bytes], found: tuple[np.ndarray, ...]) -> bytes:
    """The words that no run contains after its first period."""
    start, length, period = found
    if not len(start):
        return b" ".join(text)
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join([text[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text",
                  least: int = RUN_WORDS, times: int = RUN_TIMES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    Words are parted by blanks, tabs, line feeds, vertical tabs, form feeds and carriage
    returns. ``runs`` holds ``(start, length, period)`` of every maximal stretch of words
    that repeats with a smallest period, is at least ``least`` words long and spans the
    period at least ``times`` (three or more) times, by start, then period; words are
    numbered from 0. ``collapsed`` joins by one blank the words that stay when of each
    run only the first period is kept (a word inside any run after its first period goes).

    A null text has no words; a text without words has no runs and collapses to the empty
    string. Ids are carried along, null, repeated or not, and every row is judged by itself,
    so equal rows get equal results. An empty table gives an empty result. Other columns are
    not read.

    Whole texts are used, of any length. The words of several texts are sorted as one suffix
    array, each text closed by a code of its own so that nothing matches across texts; see
    :func:`roughcut.llm.runs.runs`. No row meets another in a shuffle.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            each = _of_texts(texts, least, times)
            offsets = np.cumsum([0] + [len(e[0]) for e in each])
            parts = [pa.array(np.concatenate([e[k] for e in each]), pa.int64()) for k in range(3)]
            structs = pa.StructArray.from_arrays(parts, fields=list(_RUNS.value_type))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs).cast(_RUNS),
                 pa.array([_collapsed(t, e) for t, e in zip(texts, each)], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            texts, words, at = [], 0, 0
            for i in range(batch.num_rows):
                # bytes.split() parts at exactly the six separators
                texts.append(batch.column(1)[i].as_buffer().to_pybytes().split())
                words += len(texts[-1])
                if words >= BATCH_WORDS:
                    yield result(batch.column(0).slice(at, len(texts)), texts)
                    texts, words, at = [], 0, i + 1
            if texts:
                yield result(batch.column(0).slice(at, len(texts)), texts)

    text = text_or_empty(text_col) if isinstance(text_col, str) else F.coalesce(text_col, F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(found, f"doc_id {kind}, n_words long, "
                                  "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs_col: str = "runs") -> Column:
    """Of an array of runs the one with the most periods (exact length / period); of ties the
    one that starts first, then the one with the shorter period. Null for an empty array."""
    def better(best: Column, run: Column) -> Column:
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (a > b), run).otherwise(best)  # runs come by start, then period
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs_col, none, better)


def with_repeated_tail(text: Column, key: Column) -> Column:
    """Test texts: where the checksum h of the key's decimal form is divisible by 10, each
    word from the a-th on becomes word ``a + (i - a) % p``, with g = floor(h / 10), n words,
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, those without words and
    those of null keys stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def repeated(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    tail = F.get(F.transform(F.array(words), lambda w: repeated(w, F.floor(h / 10))), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), tail).otherwise(text)
