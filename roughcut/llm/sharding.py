"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import hash60, numbered, text_or_empty

SHARDS = 24
#: Slots follow the ranges of the key's hash (KEY_BUCKETS), in each the checksum class of
#: the text (SPLITS), then hash, id, checksum and size.
KEY_BUCKETS = 4096
SPLITS = 8


def _score(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score: -weight / ln(u), u uniform from (key, shard)."""
    u = (hash60(F.concat(key, F.lit(f":{shard}"))).cast("double") + 0.5) / float(1 << 60)
    return F.lit(float(weight)) * -1.0 / F.log(u)


def _best(key: Column, weights: Sequence[float]) -> Column:
    return F.array_max(F.array(*[
        F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("neg")) for s, w in enumerate(weights)]))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number 0..len(weights)-1 of a string key; ties go to the smaller."""
    return (-_best(key, weights)["neg"]).cast("int")


def rendezvous_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shards: int = SHARDS, weights: Sequence[float] | None = None,
                      new_weight: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The key alone decides the shard: the shard whose score for the key is the
    largest. ``weights`` (default: all 1) set each shard's share of the keys.
    With one shard more (of weight ``new_weight``) every score stays as it is,
    so ``grown_shard`` differs from ``shard`` only for rows that move into the
    new shard. ``slot`` numbers a shard's rows from 0 without gaps, by
    (key hash range, checksum class, key hash, id, checksum, size). Rows are sorted once by
    range and numbered part by part, so neither a shard nor a key that very many rows
    share is one task's; what is carried along is shuffled once.

    A null id is one key of its own (the empty string); repeated keys go to one
    shard and get slots of their own. A null text has no bytes and checksum 0.
    An empty table gives an empty result. The columns named in ``keep`` follow as they
    are (one whose name is taken gives way); others are not read.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards or any(w <= 0 for w in weights):
        raise ValueError("one positive weight for each shard")
    text = text_or_empty(text_col).cast("binary")
    taken = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    kept = [F.col(c).alias(f"__keep_{c}") for c in keep if c not in taken]
    slim = docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), *kept)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    best = slim.withColumn("best", _best(key, weights)).withColumn("new", _score(key, shards, new_weight))
    placed = best.select(
        "doc_id", "size", "text_crc32", (-F.col("best.neg")).cast("int").alias("shard"),
        F.when(F.col("new") > F.col("best.score"), F.lit(shards)).otherwise(-F.col("best.neg"))
        .cast("int").alias("grown_shard"),
        hash60(key).alias("kh"), *[c for c in slim.columns if c.startswith("__keep_")]) \
        .withColumn("bucket", F.floor(F.col("kh") / ((1 << 60) // KEY_BUCKETS)).cast("int")) \
        .withColumn("part", (F.col("text_crc32") % SPLITS).cast("int"))
    order = ["bucket", "part", "kh", "doc_id", "text_crc32", "size"]
    if kept:  # rows that differ in what they carry only come in its order
        placed = placed.withColumn("__carried", F.xxhash64(*[c for c in placed.columns if c.startswith("__keep_")]))
        order.append("__carried")
    return numbered(placed, ["shard"], order, "slot", "placed", few=True).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
        *[F.col(f"__keep_{c}").alias(c) for c in keep if c not in taken])


def sharding_sql(source: str = "documents", shards: int = SHARDS) -> str:
    """DuckDB SQL for :func:`rendezvous_shards` with equal weights. DuckDB has no
    CRC-32, so it is computed byte by byte from its defining polynomial."""
    def h60(expr: str) -> str:
        return f"CAST('0x' || substr(md5({expr}), 1, 15) AS BIGINT)"
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    score = f"-1.0 / ln((CAST({h60("k.key || ':' || CAST(s.s AS VARCHAR)")} AS DOUBLE) + 0.5) / {1 << 60}.0)"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(
         list_concat([i], range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT row_number() OVER () AS r, doc_id, {key} AS key, strlen(coalesce(text, '')) AS n,
             hex(coalesce(text, '')) AS hx FROM {source}),
c AS (SELECT r, doc_id, key, n + 8 AS size, xor(4294967295, list_reduce(
         list_concat([4294967295], list_transform(range(n),
           lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM k, tab),
p AS (SELECT k.r, s.s, {score} AS score FROM k, range(0, {shards + 1}) AS s(s)),
b AS (SELECT r, arg_max(s, score) FILTER (s < {shards}) AS shard, arg_max(s, score) AS grown
      FROM p GROUP BY r),
j AS (SELECT c.*, b.shard, b.grown, {h60("c.key")} AS kh FROM c JOIN b USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard
         ORDER BY kh // {(1 << 60) // KEY_BUCKETS}, text_crc32 % {SPLITS}, kh,
                  doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM j
"""
