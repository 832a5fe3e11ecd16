"""Exact deduplication by two passes over a Bloom filter of text hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import stored, text_or_empty

#: Bits of the filter for each row, hashes that a row sets in it, and the most bits that one
#: filter has (what is broadcast: a million 64-bit words). With more rows the hash space is
#: cut into ranges with a filter each, so the share of rows that shuffle without need does
#: not grow: of rows whose text occurs once, about (1 / BITS_PER_ROW) ** HASHES.
BITS_PER_ROW = 16
HASHES = 2
MAX_FILTER_BITS = 1 << 26
#: Characters that equality ignores: tab, line feed, vertical tab, form feed,
#: carriage return, space.
IGNORED = " \t\n\x0b\x0c\r"


def possibly_repeated(digest: DataFrame, bits_per_row: int = BITS_PER_ROW,
                      max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``digest`` (``sha``, and ``hash`` of it) with ``maybe``: whether the row's slots in the
    filter of its hash range are all hit by more than one row. False means that no other
    row has the same ``sha``; rows that share one are always True."""
    n = digest.count()
    ranges = max(1, -(-n * bits_per_row // max_filter_bits))
    bits = max(1 << 10, -(-n * bits_per_row // ranges))
    cuts = [-(1 << 63) + (1 << 64) * r // ranges for r in range(ranges)]

    def tested(r: int) -> DataFrame:
        rows = digest
        if r:
            rows = rows.where(F.col("hash") >= cuts[r])
        if r + 1 < ranges:
            rows = rows.where(F.col("hash") < cuts[r + 1])
        slots = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(bits)) for k in range(HASHES)]
        hit = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), s.alias("slot")) for k, s in enumerate(slots)])).alias("s"))
        filters = (hit.groupBy("s.k", "s.slot").agg(F.count("*").alias("c")).where("c > 1")
                   .groupBy("k", F.floor(F.col("slot") / 64).alias("word"))
                   .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("set_bits")))
        # one filter for each hash; at most HASHES * max_filter_bits / 64 words are broadcast
        maybe = F.lit(True)
        for k, s in enumerate(slots):
            own = F.broadcast(filters.where(F.col("k") == k).select(F.col("word").alias(f"__w{k}"), F.col("set_bits").alias(f"__b{k}")))
            rows = rows.join(own, F.floor(s / 64) == F.col(f"__w{k}"), "left")
            maybe = maybe & (F.getbit(F.coalesce(F.col(f"__b{k}"), F.lit(0).cast("long")), (s % 64).cast("int")) == 1)
        return rows.select(*digest.columns, maybe.alias("maybe"))
    return reduce(DataFrame.unionByName, [tested(r) for r in range(ranges)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = BITS_PER_ROW,
                max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after deleting :data:`IGNORED`. Of equal
    texts the one with the most code points stays, then the smallest id (a null
    id comes last), then the first row read, so one row stays even where whole
    rows repeat. A null text counts as empty, and all empty texts are equal. An
    empty table gives an empty result. Other columns are not read.

    Pass 1 reads each text once, stores a slim table of digests (sorted by hash, so that a
    range of the hash space is few pages) and finds the filter slots hit more than once.
    Pass 2 tests each digest against the broadcast filter of its range: only rows whose
    slots are all repeated shuffle on the whole hash, the rest pass through. The hot group of one
    text is counted map-side first, and the join back to its rows leaves Spark free to
    split the skewed side.
    """
    text = text_or_empty(text_col)
    digest = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, IGNORED, "").cast("binary"), 256)).alias("sha"),
        F.length(text).cast("long").alias("points"),
        F.monotonically_increasing_id().alias("row")).withColumn("hash", F.xxhash64("sha"))
        .sortWithinPartitions("hash"), "digest")
    tested = possibly_repeated(digest, bits_per_row, max_filter_bits)
    maybe = tested.where("maybe")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"),
                          F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = stored(maybe.groupBy("sha").agg(F.count("*").alias("size"), best.alias("b"))
                    .where("size > 1")
                    .select("sha", "size", "b.keep_id", "b.keep_row"), "groups")
    joined = (maybe.join(groups, "sha", "left")
              .select("doc_id",
                      F.when(F.col("size").isNull(), F.col("doc_id"))
                      .otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("size", F.lit(1)).alias("group_size"),
                      F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
                      "sha"))
    single = tested.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    return single.unionByName(joined).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("sha")).alias("text_sha256"))


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256,
         row_number() OVER (PARTITION BY text_sha256
                            ORDER BY points DESC, doc_id NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256
                                   ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""
