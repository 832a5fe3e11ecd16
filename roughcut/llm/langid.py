"""Language identification by compression: the dictionary that shortens a text most wins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roughcut.llm.common import text_or_empty

UNKNOWN = "und"
#: Bounds of the fit: languages, documents for each, characters of each document,
#: and bytes of each dictionary. At most MAX_LANGUAGES * SAMPLE_DOCS * SAMPLE_CHARS
#: characters reach the driver.
MAX_LANGUAGES = 100
SAMPLE_DOCS = 400
SAMPLE_CHARS = 1500
DICT_BYTES = 256 * 1024
#: Texts are compressed in blocks of this many characters, so that a long text
#: keeps leaning on the dictionary instead of on itself.
BLOCK_CHARS = 1500
LEVEL = 3
#: A block that would shrink by little is stored as it is, whatever the dictionary; this
#: tail shrinks under every dictionary, so that short texts are compressed too.
FILLER = " " * 64
#: Reject when the best size is within this share of the runner-up.
MIN_MARGIN = 0.005

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words of letters, one space around each."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language."""
    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, raw in self.dictionaries:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False,
                write_dict_id=False)))
        return out


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
        id_col: str = "doc_id") -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows of ``docs``.

    Rows with a null label or text are left out. The sample of a language is its
    first SAMPLE_DOCS rows by a hash of id and text, equal rows counted once: a threshold
    from the row count first keeps about four times as many, so the sort sees a bounded
    number of rows however many one language has, and however many lack an id.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")) \
        .where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_DOCS) / F.col("n"))
    chosen = (rows.select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
              .join(F.broadcast(counts.orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES)), "lang")
              .where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
              .dropDuplicates(["lang", "h"])
              .withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("h", "text")))
              .where(F.col("rn") <= SAMPLE_DOCS))
    texts: dict[str, list[str]] = {}
    for r in chosen.select("lang", "rn", "text").orderBy("lang", "rn").collect():
        texts.setdefault(r.lang, []).append(letters(r.text))
    made = {k: " ".join(v).encode()[-DICT_BYTES:] for k, v in texts.items()}
    return LanguageModel(tuple((k, v) for k, v in sorted(made.items()) if v))


def predict(text: str | None, compressors: list) -> tuple[str, float]:
    """Language and score; the score is the best size's distance to the runner-up,
    as a share of the latter (one language only: 1)."""
    clean = letters(text) if text else ""
    if not compressors or not any(map(str.isalpha, clean)):
        return UNKNOWN, 0.0
    blocks = [f" {clean[i:i + BLOCK_CHARS]}{FILLER}".encode() for i in range(0, len(clean), BLOCK_CHARS)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def language(text: Column, model: LanguageModel, min_margin: float = MIN_MARGIN) -> Column:
    """Struct ``lang, score, rejected`` for a text column.

    The whole text is compressed with every dictionary, block by block, and the
    sizes are added up. A null text, or one without a letter, is :data:`UNKNOWN`
    with score 0 and rejected; a text whose margin is narrower than ``min_margin``
    is rejected too, but keeps the better guess (ties: the first code).
    """
    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for batch in batches:
            got = [predict(t, compressors) for t in batch]
            yield pd.DataFrame({"lang": [g[0] for g in got], "score": [g[1] for g in got],
                                "rejected": [g[0] == UNKNOWN or g[1] < min_margin for g in got]})
    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the fit must not see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(text_or_empty(id_col).cast("binary")) % 3 == 1


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score, rejected``.

    Fits on the rows that are not held out and predicts every row from its text
    alone. Without a labelled row every prediction is :data:`UNKNOWN`. Repeated
    rows get the same answer; an empty table gives an empty result; other columns
    are not read.
    """
    model = fit(docs.where(~held_out(id_col)), lang_col, text_col, id_col)
    got = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                      language(F.col(text_col), model, min_margin).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")
