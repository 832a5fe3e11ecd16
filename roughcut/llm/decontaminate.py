"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search,
exact shingle similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import SHINGLE_WORDS, SIMILARITY, stored, text_or_empty, words, words_sql

#: Fingerprints of 64 bits within this Hamming distance are candidates. Windows of
#: similarity 0.8 differ in a few words at their ends: about 8 bits, rarely over 15.
RADIUS = 15
#: The fingerprint falls into 8 blocks of 8 bits. Within 15 bits of distance at least one
#: block differs in one bit at most, so looking up each item under every block value
#: within one bit finds all fingerprints within the radius.
BLOCKS = 8
BLOCK_BITS = 8
#: Item shingles up to this number (16 bytes each) are broadcast; beyond, they shuffle.
BROADCAST_SHINGLES = 1_000_000


def _word_hashes(text: str) -> Column:
    return F.transform(words(F.col(text)), lambda w: F.xxhash64(w))


def _runs(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words of an array of word hashes (fewer words: none)."""
    run = F.transform(F.sequence(F.lit(0), F.size(w) - k),
                      lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, run).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of word hashes: bit b is the majority of their bits b."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function(
            "shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)) \
            .otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"),
                       lambda a, x: a.bitwiseOR(x))


def _blocks(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
                     .cast("int") for i in range(BLOCKS)])


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes."""
    def times(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))
    both = F.aggregate(F.array_distinct(b), F.lit(0),
                       lambda n, h: n + F.least(times(a, h), times(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text",
                 similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and benchmark item found in it:
    ``doc_id, item_id, similarity, first_word, n_words`` (the most similar window).

    A window has as many words as the item (the whole text, where that is shorter)
    and is reported when the weighted Jaccard similarity of their 5-word shingles is
    at least ``similarity``. Items of fewer than 5 words are one shingle of all
    their words.

    Windows that cannot reach the similarity are left out first, without loss: of n
    shingles on either side at least ``2 n s / (1 + s)`` must be the item's, so the
    places of the item's shingles in a text, in order, tell where such windows can
    start. The windows left get a SimHash of their words. Item fingerprints are
    indexed under every value within ``radius // 8`` bits of each of their 8 blocks,
    which finds all fingerprints within ``radius``; these pairs are then compared
    exactly. Pairs of window and item meet by item length and block value.

    Ids name documents: rows of one id are looked at one by one and reported under
    it (null ids as null, once). Null or wordless texts and items match nothing;
    repeated items each get a row; empty tables give an empty result. Other columns
    are not read.
    """
    per_block = radius // BLOCKS
    if per_block > 2:
        raise ValueError("the radius is too large for an index of 8 blocks")
    item = stored(items.select(F.col(item_id_col).alias("item_id"), _word_hashes(item_text_col).alias("w"))
                  .where(F.size("w") > 0)
                  .select(F.monotonically_increasing_id().alias("item"), "item_id", "w",
                          F.size("w").alias("len")), "items")
    text = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    text = text.withColumn("version", F.xxhash64("t"))  # rows of one id are told apart by it
    short = item.where(F.col("len") < SHINGLE_WORDS).select("len").distinct().orderBy("len").collect()
    found = [_of_size(text, item.where(F.col("len") == r["len"]), r["len"], similarity, radius)
             for r in short]  # at most four lengths below five
    found.append(_of_size(text, item.where(F.col("len") >= SHINGLE_WORDS), SHINGLE_WORDS, similarity, radius))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _of_size(text: DataFrame, item: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    item = item.withColumn("sh", _runs(F.col("w"), k)).withColumn("n", F.size("sh"))
    owned = item.select("item", "len", "n", F.explode(F.array_distinct("sh")).alias("h"))
    count = owned.count()
    hint = F.broadcast if count <= BROADCAST_SHINGLES else (lambda df: df)

    # places of item shingles in the texts: only these leave the scan
    hashed = text.select("doc_id", "version", _word_hashes("t").alias("w")) \
        .select("doc_id", "version", "w", F.size("w").alias("total"))
    places = hashed.select("doc_id", "total", "version", F.posexplode(_runs(F.col("w"), k)).alias("pos", "h")) \
        .join(hint(owned), "h")
    places = places.groupBy("doc_id", "version", "item", "len", "n", "total").agg(
        F.array_sort(F.collect_set("pos")).alias("at"))
    # a window of m shingles holds at least `need` of the item's; its first and last of so many
    m = F.least(F.col("n"), F.col("total") - (k - 1))
    need = F.ceil((F.col("n") + m) * (similarity / (1 + similarity)) - 1e-9).cast("int")
    reach = places.withColumn("m", m).withColumn("need", F.greatest(need, F.lit(1))) \
        .where(F.size("at") >= F.col("need"))
    tight = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")),
                     lambda i: F.get("at", i + F.col("need") - 1) - F.get("at", i) < F.col("m"))
    starts = F.array_distinct(F.flatten(F.transform(tight, lambda i: F.sequence(
        F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("m") + 1),
        F.least(F.get("at", i), F.col("total") - (k - 1) - F.col("m"))))))
    spots = reach.where(F.size(tight) > 0).select("doc_id", "version", "len", F.explode(starts).alias("start")) \
        .distinct()
    spots = stored(spots.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("len", "start")).alias("spots")), "spots")

    # the windows themselves, from their texts (only texts travel; they are cut after the join)
    cut = F.transform("spots", lambda s: F.struct(
        s["len"].alias("len"), s["start"].alias("start"),
        F.slice("w", s["start"] + 1, s["len"]).alias("ww")))
    windows = text \
        .join(spots.withColumnRenamed("doc_id", "spot_doc").withColumnRenamed("version", "spot_version"),
              F.col("doc_id").eqNullSafe(F.col("spot_doc")) & (F.col("version") == F.col("spot_version"))) \
        .select("doc_id", "version", "spots", _word_hashes("t").alias("w")) \
        .select("doc_id", "version", F.inline(cut)).dropDuplicates(["doc_id", "version", "len", "start"])
    marked = stored(windows.withColumn("fp", simhash(F.col("ww")))
                    .select("doc_id", "len", "start", F.size("ww").alias("n_words"), "fp",
                            _runs(F.col("ww"), k).alias("sh")), "windows")

    # multi-index search: items under every block value within reach, windows under their own
    flips = _flips(radius // BLOCKS)
    index = item.withColumn("item_fp", simhash(F.col("w"))) \
        .select("item", "item_id", "len", "item_fp", F.col("sh").alias("item_sh"),
                F.posexplode(_blocks(F.col("item_fp"))).alias("block", "v")) \
        .withColumn("flip", F.explode(F.array(*[F.lit(x) for x in flips]))) \
        .withColumn("v", F.col("v").bitwiseXOR(F.col("flip"))).drop("flip")
    keys = marked.withColumn("own", _blocks(F.col("fp"))) \
        .select("*", F.posexplode("own").alias("block", "v")).drop("own")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = keys.join(index, ["len", "block", "v"]).where(near)
    # a pair that meets in several blocks counts in the first of them only
    same = [F.bit_count(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), BLOCK_BITS * i)
                        .bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))) <= radius // BLOCKS for i in range(BLOCKS)]
    first = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(same)])
    checked = pairs.where(F.col("block") == first) \
        .withColumn("similarity", _similarity(F.col("sh"), F.col("item_sh"))) \
        .where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b")
    return checked.groupBy("doc_id", "item", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.similarity").alias("similarity"),
        (-F.col("b.s")).cast("long").alias("first_word"), F.col("b.n_words").cast("long").alias("n_words"))


def _flips(bits: int) -> Sequence[int]:
    return [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= bits]


#: DuckDB SQL for the query (items of five words or more): every window that holds a place
#: of an item shingle, without fingerprints.
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
i AS (SELECT item_id, {words_sql("text")} AS w FROM benchmark),
ip AS (SELECT item_id, len(w) AS words, len(w) - 4 AS n, w, unnest(range(len(w) - 4)) AS pos FROM i WHERE len(w) >= 5),
s AS (SELECT item_id, words, n, w[pos + 1:pos + 5] AS sh, count(*) AS c FROM ip GROUP BY ALL),
dp AS (SELECT doc_id, len(w) AS total, w, unnest(range(len(w) - 4)) AS pos FROM d WHERE len(w) >= 5),
ds AS (SELECT doc_id, total, pos, w[pos + 1:pos + 5] AS sh FROM dp),
h AS (SELECT doc_id, total, pos, sh, item_id, words, n, c, least(n, total - 4) AS m FROM ds JOIN s USING (sh)),
o AS (SELECT DISTINCT doc_id, item_id, words, total, n, m,
             unnest(range(greatest(0, pos - m + 1), least(pos, total - 4 - m) + 1)) AS start FROM h),
k AS (SELECT o.doc_id, o.item_id, o.words, o.total, o.n, o.m, o.start, h.sh, least(count(*), any_value(h.c)) AS common
      FROM o JOIN h ON o.doc_id = h.doc_id AND o.item_id = h.item_id AND h.pos BETWEEN o.start AND o.start + o.m - 1
      GROUP BY ALL),
z AS (SELECT doc_id, item_id, words, total, start, sum(common) / (n + m - sum(common)) AS similarity
      FROM k GROUP BY doc_id, item_id, words, total, start, n, m)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, start AS first_word, least(words, total) AS n_words
FROM z WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY z.similarity DESC, start) = 1
"""
