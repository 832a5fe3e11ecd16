"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roughcut.llm.common import numbered, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating; null last
BUDGET = 1.5  # words to mix, as a share of all words
MAX_REPEAT = 2.0  # a source's target stops at this many times its size
CHUNK_ROWS = 4096  # rows that meet in one flight
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source, source_size, n, target`` from ``source, size`` rows.

    The budget is shared by weight; what a source cannot take (its target stops
    at ``max_repeat`` times its size) is shared again by weight among the rest.
    That ends where every open source gets ``level`` times its weight, so the
    level comes from running sums over the sources in order of ``cap / weight``.
    The windows run over one row per source, in one task: sources are few.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"),
                                      F.count("*").alias("n"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = per.withColumn("rank", F.row_number().over(
        W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(w, F.col("rank") % len(weights))) \
        .withColumn("cap", F.col("source_size") * float(max_repeat))
    fill = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    done, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    t = (ranked.withColumn("all", F.sum("source_size").over(everything) * float(budget))
         .withColumn("level", F.try_divide(
             F.col("all") - F.coalesce(F.sum("cap").over(done), F.lit(0.0)),
             F.sum("weight").over(rest)))
         # the first source whose cap is above the level: it and all after it are open
         .withColumn("open_level", F.min(F.when(
             F.col("cap") / F.col("weight") >= F.col("level"), F.struct(
                 F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]))
    return t.select("source", "source_size", "n", F.when(
        F.col("open_level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("weight") * F.col("open_level"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator,
           constraints: int = 2) -> np.ndarray:
    """Cube flight phase: move ``p`` until at most ``constraints`` entries are fractional.

    Each step takes as many undecided units as there are constraints, plus one,
    and moves them along the null space of (number of units, sum of sizes) until
    one of them is decided; the two directions are drawn so that every unit's
    expectation stays its probability. With ``constraints=1`` only the sum of
    sizes is kept.
    """
    p = p.copy()
    todo = np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist()[::-1]
    draws, at = rng.random(max(len(todo), 1)), 0
    held: list[int] = []
    while True:
        while len(held) <= constraints and todo:
            held.append(todo.pop())
        if len(held) <= constraints:
            break
        if constraints == 2:
            a, b, c = (float(size[i]) for i in held)
            u = (c - b, a - c, b - a)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        else:
            a, b = (float(size[i]) for i in held)
            u = (b, -a) if a or b else (1.0, -1.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for i, x in zip(held, u):
            p[i] += step * x
            if p[i] < _EPS or p[i] > 1 - _EPS:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]
    return p


def _fly(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "size", "crc"], kind="stable", ignore_index=True)
        name = pdf["source"].iloc[0]
        seed = [zlib.crc32(b"" if name is None else name.encode()), name is None,
                int(pdf["chunk"].iloc[0]), level]
        rng = np.random.default_rng(seed)
        size = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), size, rng)
        if last:  # landing: give up the number of units, then draw for the one that is left
            p = flight(p, size, rng, constraints=1)
            left = (p > _EPS) & (p < 1 - _EPS)
            p[left] = rng.random(int(left.sum())) < p[left]
        pdf["p"] = p
        return pdf
    return run


def cube_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights: Sequence[float] = WEIGHTS,
             budget: float = BUDGET, max_repeat: float = MAX_REPEAT,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per row of ``docs``:
    ``doc_id, size, source_size, target, taken, copies, source``.

    ``size`` counts the words of the text (null: 0). A source whose target is r
    times its size takes each of its documents floor(r) times and draws the rest
    by balanced sampling: all documents start at the fraction of r as inclusion
    probability, and the flight keeps, source by source, both the expected
    number of documents and the expected number of words. ``taken`` is ``size``
    times ``copies``.

    Flights run over chunks of ``chunk_rows`` rows of one source, in the order of a hash of
    id, size and checksum; equal rows follow each other and are dealt to chunks like any
    others, so a hot source or row has many chunks and none holds more. Each leaves
    at most two undecided rows; those meet 1,024 chunks at a time in the next
    round, until one chunk per source is left, where the landing decides. Draws
    are seeded by source, chunk and round and rows are ordered by hash and id, so
    reruns agree. A null source is a source of its own. Ids may repeat or be null;
    sources without words take none. An empty table gives an empty result. Other
    columns are not read.
    """
    text = text_or_empty(text_col)
    fields = ["doc_id", "source", "size", "crc", "order", "source_size", "target", "base", "p", "chunk"]
    sizes = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc")), "sizes")
    targets = stored(source_targets(sizes, weights, budget, max_repeat).withColumn(
        "chunks", F.ceil(F.col("n") / chunk_rows)), "targets")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    dealt = numbered(sizes.withColumn("order", F.xxhash64("doc_id", "size", "crc")), ["source"],
                     ["order", "doc_id", "size", "crc"], "nr", "dealt")
    rows = (dealt.join(targets.select(F.col("source").alias("s"), "source_size", "target", "chunks"),
                  F.col("source").eqNullSafe(F.col("s")))
            .withColumn("base", F.floor(ratio).cast("long"))
            .withColumn("p", ratio - F.floor(ratio))
            .withColumn("chunk", F.floor(F.col("nr") / chunk_rows))
            .select(*fields))
    most = targets.agg(F.max("chunks")).first()[0] or 1
    decided, level = [], 0
    while True:
        last = most <= 1
        out = rows.groupBy("source", "chunk").applyInPandas(_fly(level, last), rows.schema)
        if last:
            decided.append(out)
            break
        out = stored(out, f"flight{level}")
        decided.append(out.where("p = 0 OR p = 1"))
        most = -(-most // 1024)
        rows = out.where("p > 0 AND p < 1").withColumn("chunk", F.floor(F.col("chunk") / 1024))
        level += 1
    union = decided[0]
    for d in decided[1:]:
        union = union.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("long")
    return union.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")
