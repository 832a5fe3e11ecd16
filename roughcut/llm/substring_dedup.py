"""Substring deduplication: bytes of strings that occurred earlier are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import stored
from roughcut.llm.substrings import Rolling, repeated_classes, segments

#: Length in bytes of the strings that may occur once only.
LENGTH = 100
#: Texts are cut into segments together until they hold so many bytes (a longer one alone).
CHUNK_BYTES = 128 << 10
#: Equal segments are combined in a task before the shuffle, so many segments at a time.
COMBINE_SEGMENTS = 1 << 17
#: Segments with their bytes leave a task so many at a time.
PIECES = 20_000
#: Bytes of segments that meet in one transform, on average.
BLOCK_BYTES = 1 << 20
#: An anchor with more differing segments than this has its windows compared by hash, one
#: row each, instead of together in one block.
ANCHOR_SEGMENTS = 2000

_NO_ID = (1 << 63) - 1
_SPAN = "doc long, row long, start long, windows long"


def _encode(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _merged(doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join runs of windows that touch or overlap within a document."""
    by = np.lexsort((start, row, doc))
    doc, row, start, end = doc[by], row[by], start[by], (start + windows)[by]
    if not len(doc):
        return doc, row, start, end
    # running maximum of the ends inside each document
    other = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    group = np.cumsum(np.r_[0, other])
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = np.flatnonzero(np.r_[True, other | (start[1:] > reach[:-1])])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], row[new], start[new], reach[last] - start[new]


def _cut(length: int):
    """Segments of the texts; equal ones of a task are combined into their earliest, and the
    others come out as removed windows (their anchor spreads them over the partitions)."""
    def combine(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        doc, row, start, windows, anchor, content = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((start, row, doc, content, anchor))
        doc, row, start, windows, anchor, content = (x[by] for x in (doc, row, start, windows, anchor, content))
        same = np.r_[False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])][:len(doc)]
        one = ~same
        # the same place again (equal rows of one id) is the same occurrence
        head = np.flatnonzero(one)[np.cumsum(one) - 1]
        again = same & ((doc != doc[head]) | (row != row[head]) | (start != start[head]))
        d, r, s, w = _merged(doc[again], row[again], start[again], windows[again])
        spread = ((d + r) * 0x5DEECE66D + s).astype(np.int64)
        return pd.DataFrame({
            "anchor": np.r_[anchor[one], spread], "content": np.r_[content[one], np.zeros(len(d), np.int64)],
            "doc": np.r_[doc[one], d], "row": np.r_[row[one], r], "start": np.r_[start[one], s],
            "windows": np.r_[windows[one], w], "gone": np.r_[np.zeros(int(one.sum()), bool), np.ones(len(d), bool)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for pdf in batches:
            raw = [_encode(t) for t in pdf["text"]]
            ids, numbers = pdf["doc"].to_numpy(), pdf["row"].to_numpy()
            i = 0
            while i < len(raw):
                j, size = i, 0
                while j < len(raw) and (j == i or size + len(raw[j]) <= CHUNK_BYTES):
                    size += len(raw[j])
                    j += 1
                buf = np.frombuffer(b"".join(raw[i:j]), np.uint8)
                owner, start, windows, anchor, content = segments(
                    buf, np.cumsum([len(r) for r in raw[i:j]]), length)
                if len(owner):
                    held.append((ids[i:j][owner], numbers[i:j][owner], start, windows, anchor, content))
                    n += len(owner)
                if n >= COMBINE_SEGMENTS:
                    yield combine(held)
                    held, n = [], 0
                i = j
        if held:
            yield combine(held)
    return run


def _sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted segments in; out come removed windows (``anchor`` null), and the earliest of
    equal segments where other segments have the same anchor.

    Rows come by (anchor, content, doc, row, start). At the ends of a batch it is not known
    whether the anchor goes on, so its segments come out in any case; the block finds
    that they match nothing.
    """
    last = None  # anchor, content, doc, row and start of the first segment of the last run
    for pdf in batches:
        if not len(pdf):
            continue
        anchor, content = pdf["anchor"].to_numpy(), pdf["content"].to_numpy()
        gone = pdf["gone"].to_numpy(dtype=bool)
        doc, row, start = (pdf[c].to_numpy() for c in ("doc", "row", "start"))
        same_anchor = np.r_[False, anchor[1:] == anchor[:-1]]
        same = same_anchor & np.r_[False, content[1:] == content[:-1]]
        if last is not None and anchor[0] == last[0]:
            same_anchor[0] = True
            same[0] = content[0] == last[1]
        # the same place again (equal rows of one id) is the same occurrence
        run = np.cumsum(~same)
        heads = np.flatnonzero(~same)
        head_doc = np.r_[last[2] if last else 0, doc[heads]][run]
        head_row = np.r_[last[3] if last else 0, row[heads]][run]
        head_start = np.r_[last[4] if last else 0, start[heads]][run]
        again = same & ((doc != head_doc) | (row != head_row) | (start != head_start))
        last = (anchor[-1], content[-1], head_doc[-1], head_row[-1], head_start[-1])
        # an anchor has company when a neighbour has the same anchor and other content
        part = np.cumsum(~same_anchor)
        companions = np.bincount(part, weights=~same, minlength=part[-1] + 1)[part] > 1
        edge = (part == part[0]) | (part == part[-1])
        keep = ~same & ~gone & (companions | edge)
        gone = gone | again
        d, r, s, w = _merged(doc[gone], row[gone], start[gone], pdf["windows"].to_numpy()[gone])
        kept = pdf.loc[keep, ["anchor", "doc", "row", "start", "windows"]].astype({"anchor": "Int64"})
        yield pd.concat([kept, pd.DataFrame({
            "anchor": pd.array([None] * len(d), dtype="Int64"), "doc": d, "row": r, "start": s, "windows": w})])


def _bytes_of(length: int):
    """Bytes of the wanted segments of each text; the windows of crowded anchors (whose
    number of windows comes negative) one by one, by hash."""
    names = ["anchor", "doc", "row", "start", "windows", "raw"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc, row, text, anchors, starts, counts in zip(
                    pdf["doc"], pdf["row"], pdf["text"], pdf["anchors"], pdf["starts"], pdf["counts"]):
                raw = _encode(text)
                windows = np.abs(counts)
                single = counts < 0
                for a, s, w in zip(anchors[~single].tolist(), starts[~single].tolist(), windows[~single].tolist()):
                    out.append((a, doc, row, s, w, raw[s:s + w + length - 1]))
                if single.any():
                    at = np.concatenate([np.arange(s, s + w) for s, w in zip(
                        starts[single].tolist(), windows[single].tolist())])
                    # only the bytes from the first to the last of these windows are hashed
                    if len(at):
                        first = int(at.min())
                        buf = np.frombuffer(raw[first:int(at.max()) + length], np.uint8)
                        hashes = Rolling(buf)(at - first, length).astype(np.int64)
                        out += [(h, doc, row, a, 1, None) for h, a in zip(hashes.tolist(), at.tolist())]
                if len(out) >= PIECES:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)
    return run


def _block(length: int):
    """Removed windows among the segments of one block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = [bytes(r) for r in pdf["raw"]]
        text = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
        order, classes = repeated_classes(text, length)
        owner = np.searchsorted(begin, order, side="right") - 1
        offset = order - begin[owner]
        whole = offset < pdf["windows"].to_numpy()[owner]  # windows inside their segment
        classes, owner, offset = classes[whole], owner[whole], offset[whole]
        doc, row = pdf["doc"].to_numpy()[owner], pdf["row"].to_numpy()[owner]
        start = pdf["start"].to_numpy()[owner] + offset
        by = np.lexsort((start, row, doc, classes))
        classes, doc, row, start = classes[by], doc[by], row[by], start[by]
        heads = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        head = np.repeat(heads, np.diff(np.r_[heads, len(classes)]))
        later = (doc != doc[head]) | (row != row[head]) | (start != start[head])
        d, r, s, w = _merged(doc[later], row[later], start[later], np.ones(int(later.sum()), np.int64))
        return pd.DataFrame({"doc": d, "row": r, "start": s, "windows": w})
    return run


def _without(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            none = np.empty(0, np.int64)
            for text, begin, size in zip(pdf["text"], pdf["starts"], pdf["counts"]):
                raw = _encode(text)
                begin, size = (none, none) if begin is None else (begin, size)
                if len(begin):
                    # touching byte runs join; a run of windows covers length - 1 bytes more
                    zeros = np.zeros(len(begin), np.int64)
                    _, _, begin, size = _merged(zeros, zeros, begin, size + (length - 1))
                parts, at = [], 0
                for b, s in zip(begin.tolist(), size.tolist()):
                    parts.append(raw[at:b])
                    at = b + s
                kept = b"".join(parts) + raw[at:]
                rows.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest())
                            + ((kept,) if with_text else ()))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``,
    and ``kept`` (the remaining bytes) on request.

    Texts are UTF-8 bytes. A byte goes when a string of ``length`` bytes that covers it
    also starts earlier: in a smaller id, or further left in the same text. Strings are
    judged on the input and never cross texts. ``n_spans`` counts the maximal removed
    runs. Ids are whole numbers; null comes last. Rows of one id and text are one
    document: the same string at the same start in them is one occurrence. Differing
    texts of one id are documents of their own, in the order of a hash of the text, and
    so is every row with a null id, in the order of the rows. A null text is empty; texts shorter than ``length`` stay whole. An empty table gives an empty result.
    Other columns are not read.

    1. Every window of ``length`` bytes has an anchor (its 24-byte string of least hash);
       consecutive windows of one anchor are a segment. Equal windows have the same anchor.
       Equal segments of a task are combined before the shuffle.
    2. Segments are range-partitioned and sorted by (anchor, content), which splits an
       anchor with very many segments too. The later ones of equal segments are removed
       as a whole; an anchor whose segments are all equal is done.
    3. The others - where matches begin or end inside a segment - meet by anchor in
       blocks. A block's suffix order and Burrows-Wheeler transform give, by interval
       expansion up to ``length``, the classes of equal windows; all but the earliest go.
       An anchor too crowded for a block has its windows compared by 64-bit hash, one row
       per window, with a combined minimum.
    4. The removed windows of a document are joined with its text. Steps 3 and 4 use one
       shuffle of the texts.
    """
    if length < 2 * 24:
        raise ValueError("strings of at least 48 bytes")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.col(text_col).cast("string").alias("text"))
    # tells the documents of one id apart: negative, and not for null ids
    rows = rows.withColumn("row", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
                           .otherwise(F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)))))
    cut = rows.select("doc", "row", "text").mapInPandas(
        _cut(length), "anchor long, content long, doc long, row long, start long, windows long, gone boolean")
    sifted = stored(cut.repartitionByRange("anchor", "content")
                    .sortWithinPartitions("anchor", "content", "doc", "row", "start")
                    .mapInPandas(_sift, "anchor long, doc long, row long, start long, windows long"), "sifted")

    reps = sifted.where("anchor IS NOT NULL")
    crowded = reps.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > ANCHOR_SEGMENTS) \
        .select("anchor", F.lit(True).alias("crowded"))
    count = F.when(F.col("crowded"), -F.col("windows")).otherwise(F.col("windows"))
    wanted = reps.join(crowded, "anchor", "left").select("anchor", "doc", "row", "start", count.alias("count")) \
        .groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("w")) \
        .select("doc", "row", F.col("w.anchor").alias("anchors"), F.col("w.start").alias("starts"),
                F.col("w.count").alias("counts"))
    volume = reps.agg(F.sum(F.col("windows") + length).alias("n")).first()["n"] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))

    texts = rows.select("doc_id", "doc", "row", "text")
    pieces = stored(texts.join(wanted, ["doc", "row"]).select("doc", "row", "text", "anchors", "starts", "counts").mapInPandas(
        _bytes_of(length), "anchor long, doc long, row long, start long, windows long, raw binary"), "pieces")
    in_blocks = pieces.where("raw IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))) \
        .groupBy("block").applyInPandas(_block(length), _SPAN)
    single = pieces.where("raw IS NULL").select(F.col("anchor").alias("window"), "doc", "row", "start")
    first = stored(single.groupBy("window").agg(F.min(F.struct("doc", "row", "start")).alias("f"),
                                                F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    one_by_one = single.join(first, "window").where(
        (F.col("doc") != F.col("f.doc")) | (F.col("row") != F.col("f.row")) | (F.col("start") != F.col("f.start"))) \
        .select("doc", "row", "start", F.lit(1).cast("long").alias("windows"))
    removed = sifted.where("anchor IS NULL").drop("anchor").unionByName(in_blocks).unionByName(one_by_one)
    runs = removed.groupBy(F.col("doc").alias("of"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("start", "windows")).alias("r")) \
        .select("of", "of_row", F.col("r.start").alias("starts"), F.col("r.windows").alias("counts"))
    kept = ", kept binary" if with_text else ""
    id_type = docs.schema[id_col].dataType.simpleString()
    same = (F.col("doc") == F.col("of")) & (F.col("row") == F.col("of_row"))
    return texts.join(runs, same, "left").select("doc_id", "text", "starts", "counts").mapInPandas(
        _without(length, with_text), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")


#: DuckDB SQL for the query: every window of 100 bytes, by its md5.
SUBSTRING_DEDUP_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS hx
           FROM documents),
p AS (SELECT r, doc_id, unnest(list_transform(range(n - 99),
             lambda i: {'i': i, 'm': md5(substr(hx, 2 * i + 1, 200))})) AS u FROM d WHERE n >= 100),
w AS (SELECT r, u.i AS i, row_number() OVER (PARTITION BY u.m ORDER BY doc_id NULLS LAST, u.i) AS nth FROM p),
x AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 100, true) AS fresh FROM w WHERE nth > 1),
g AS (SELECT r, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY i) AS run FROM x),
runs AS (SELECT r, run, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY r, run),
cuts AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM runs),
kept AS (SELECT cuts.r, string_agg(substr(hx, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head,
                max(hi) AS last, sum(hi - lo) AS gone, count(*) AS spans
         FROM cuts JOIN d USING (r) GROUP BY cuts.r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(hx, 2 * last + 1), hx))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
