"""The corpus pipeline: documents in, a mixed and sharded training set out.

Each stage calls one operator of :mod:`roughcut.llm` on all that the stage
before kept, and applies its decisions, row by row: ids may repeat or be null. Stages return the columns of
``documents``; the last adds the shard and the slot of every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.llm.common import numbered, stored
from roughcut.llm.decontaminate import contaminated
from roughcut.llm.langid import fit, held_out, language
from roughcut.llm.mixing import cube_mix
from roughcut.llm.near_dedup import near_duplicates
from roughcut.llm.sharding import rendezvous_shards
from roughcut.sources.tables import read_table


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row, ``__row``: in the order of the ids
    (null last), then of a hash of all columns. Equal rows cannot be told apart, so they
    are numbered, over many tasks however many they are; the keys are the same however often
    and from wherever the rows are read."""
    number = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    key = F.concat(F.coalesce(F.lpad(F.hex(number), 16, "0"), F.lit("null")),
                   F.lit(" "), F.lpad(F.hex(F.xxhash64(*docs.columns)), 16, "0"))
    keyed = docs.withColumn("__row", key)
    equal = stored(keyed.groupBy("__row").agg(F.count("*").alias("__n")).where("__n > 1")
                   .select(F.col("__row").alias("__equal")), "equal")
    if equal.isEmpty():
        return keyed
    same = F.col("__row") == F.col("__equal")
    several = numbered(keyed.join(equal, same, "left_semi"), ["__row"], [], "__n", "several") \
        .withColumn("__row", F.concat("__row", F.lit(" "), F.lpad(F.hex("__n"), 16, "0"))).drop("__n")
    return keyed.join(equal, same, "left_anti").unionByName(several)


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is not in the column ``doc_id`` of ``rows``, without it."""
    gone = rows.select(F.col("doc_id").alias("__gone")).distinct()
    return keyed.join(gone, keyed["__row"] == gone["__gone"], "left_anti").drop("__row")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: texts without letters or without a clear language go.

    A null, empty or letterless text has no language and goes; a text of any length is judged
    whole. Rows of equal text get the same decision; ids and labels decide nothing (null
    labels are not learned from; without labels every text goes). Empty in, empty out."""
    model = fit(docs.where(~held_out("doc_id")))
    return docs.where(~language(F.col("text"), model)["rejected"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class stays.

    Rows are told apart by a key of their own, so null and repeated ids are documents like
    any others; of equal rows one stays, of ties the first by id, then content. Null and empty
    texts are one class, so one of them stays. Empty in, empty out."""
    keyed = _keyed(docs)
    return _without(keyed, near_duplicates(keyed, id_col="__row").where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Decided row by row, so a null or repeated id that holds an item takes no other row with
    it. Null and empty texts hold nothing and stay; null or empty items are in nothing. Texts
    are searched whole. Empty in, empty out; without items all stay."""
    keyed = _keyed(docs)
    return _without(keyed, contaminated(keyed, read_table(spark, sf_dir, "benchmark"), id_col="__row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document appears as often as it is taken.

    A document that is taken twice is two rows. Null sources are one source; texts without words
    (null, empty) weigh nothing and are drawn by their source's rate like others. Equal rows
    are drawn each on their own. Empty in, empty out."""
    keyed = _keyed(docs)
    copies = cube_mix(keyed, id_col="__row").where("copies > 0") \
        .select(F.col("doc_id").alias("__id"), F.col("copies").cast("int").alias("__copies"))
    taken = keyed.join(copies, keyed["__row"] == copies["__id"])
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))) \
        .select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: every row gets its shard and a slot in it.

    The id decides the shard, null ids share one; repeated and equal rows get slots of their
    own. Null texts count no bytes. Adds the columns of
    :func:`roughcut.llm.sharding.rendezvous_shards`. Empty in, empty out."""
    return rendezvous_shards(docs, keep=[c for c in docs.columns if c != "doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages rest on compression, sampling and hashing that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is stored and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
