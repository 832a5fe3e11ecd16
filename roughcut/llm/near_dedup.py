"""Near-duplicate classes by DartMinHash signatures and banded joining."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import SIMILARITY, stored, words_sql
from roughcut.llm.components import connected_components
from roughcut.llm.shingles import chunks, jaccard, mix, shingles, weighted

#: 32 bands of 4 coordinates: a pair of similarity 0.8 shares no band in 5 of 10**8 cases.
BANDS = 32
ROWS = 4
#: What is left of a bucket is finished within one task once it has this many members, and
#: this many shingles in them, at most.
LOCAL_MEMBERS = 2000
LOCAL_SHINGLES = 4_000_000
#: Larger rests are banded again, by other coordinates: 64 bands of 6 lose one pair of
#: similarity 0.8 in 10**8, and part contents that share half their shingles 64 times finer.
AGAIN_BANDS = 64
AGAIN_ROWS = 6

_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers above 0 and at most 1."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int,
                    k: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` weighted MinHash signatures of ``k`` coordinates, and which of them are defined.

    ``hashes[i]`` is an element of set ``owner[i]`` with weight ``weight[i]``. Each
    element's weight axis is cut into regions (0, 1], (1, 2], (2, 4], ... Darts fall
    on a region as a Poisson process in rank, at a rate of the region's width, with
    ranks, weights and coordinates all hashed from (element, region, dart), so equal
    regions of different sets hold equal darts. A set keeps the darts below its
    weight whose rank is under ``theta = k (ln k + 2) / total weight``; each
    coordinate keeps its earliest dart. A set whose darts leave a coordinate empty
    (about one in eight) throws again with theta doubled, which changes no other
    coordinate. Two sets agree in a coordinate with their weighted Jaccard
    similarity as probability. Sets without elements stay undefined.
    """
    total = np.bincount(owner, weights=weight, minlength=n)
    defined = total > 0
    value = np.zeros((n, k), _U)
    theta = np.zeros(n)
    theta[defined] = k * (math.log(k) + 2) / total[defined]
    open_sets = defined.copy()
    while open_sets.any():
        mine = open_sets[owner]
        el, ow, wt = hashes[mine], owner[mine], weight[mine]
        regions = np.ceil(np.log2(np.maximum(wt, 1.0))).astype(np.int64) + 1
        pick = np.repeat(np.arange(len(el)), regions)
        region = np.arange(len(pick)) - np.repeat(np.cumsum(regions) - regions, regions)
        low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
        width = np.maximum(low, 1.0)
        state = mix(el[pick] + region.astype(_U) * _U(0xD6E8FEB86659FD93))
        ow, wt = ow[pick], wt[pick]
        rank, limit = np.zeros(len(pick)), theta[ow]
        table = np.full(n * k, np.inf)
        darts = []
        while len(state):
            state = mix(state + _U(0x9E3779B97F4A7C15))
            rank = rank - np.log(_uniform(state)) / width
            alive = rank <= limit
            state, rank, limit, ow, wt, low, width = (
                x[alive] for x in (state, rank, limit, ow, wt, low, width))
            second = mix(state ^ _U(0xA5A5A5A5A5A5A5A5))
            hit = low + _uniform(second) * width <= wt
            coordinate = mix(second[hit]) % _U(k)
            cell = ow[hit] * k + coordinate.astype(np.int64)
            np.minimum.at(table, cell, rank[hit])
            darts.append((cell, rank[hit], state[hit]))
        flat = value.reshape(-1)
        for cell, r, s in darts:
            first = r == table[cell]
            flat[cell[first]] = s[first]
        full = np.isfinite(table.reshape(n, k)).all(axis=1)
        theta[open_sets] *= 2
        open_sets &= ~full
    return value, defined


def _band_keys(h: np.ndarray, o: np.ndarray, c: np.ndarray, n: int, bands: int,
               rows: int) -> tuple[np.ndarray, np.ndarray]:
    value, defined = dart_signatures(h, o, c.astype(np.float64), n, bands * rows)
    power = np.cumprod(np.full(rows, 0x2545F4914F6CDD1D, np.uint64))
    keys = (value.reshape(n, bands, rows) * power).sum(axis=2, dtype=_U) + np.arange(bands, dtype=_U)
    return mix(keys).astype(np.int64), defined


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for part in chunks(texts):
                some = [texts[i] for i in part]
                h, o, c = weighted(*shingles(some))
                keys, defined = _band_keys(h, o, c, len(some), bands, rows)
                total = np.bincount(o, weights=c, minlength=len(some)).astype(np.int64)
                content = [np.zeros(len(some), _U) for _ in range(2)]
                for salt, sums in enumerate(content):
                    np.add.at(sums, o, mix(mix(h + _U(salt)) + c.astype(_U)))
                nodes = np.stack(content, axis=1)
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[part].to_numpy(),
                    "node": [nodes[j].tobytes() if defined[j] else None for j in range(len(some))],
                    "weight": total,
                    "keys": [list(keys[j]) if defined[j] else None for j in range(len(some))],
                    "blob": [pack.compress(t.encode("utf-8", "surrogatepass")) if d else None
                             for t, d in zip(some, defined)]})
    return run


def _band_again(level: int):
    """Band keys of contents by the coordinates of another level."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            texts = [unpack.decompress(bytes(b)).decode("utf-8", "surrogatepass") for b in pdf["blob"]]
            for part in chunks(texts):
                h, o, c = weighted(*shingles([texts[i] for i in part]))
                keys, _ = _band_keys(mix(h + _U(level)), o, c, len(part), AGAIN_BANDS, AGAIN_ROWS)
                yield pd.DataFrame({"node": pdf["node"].iloc[part].to_numpy(), "keys": [list(k) for k in keys]})
    return run


def _bag_of(unpack: zstandard.ZstdDecompressor):
    @lru_cache(maxsize=512)
    def bag(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        h, _, c = weighted(*shingles([unpack.decompress(blob).decode("utf-8", "surrogatepass")]))
        return h, c
    return bag


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bag = _bag_of(zstandard.ZstdDecompressor())
    for pdf in batches:
        sim = [jaccard(*bag(bytes(x)), *bag(bytes(y))) for x, y in zip(pdf["blob_a"], pdf["blob_b"])]
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "sim": np.array(sim, np.float64)})


def _bags(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(owner, hash)`` of the shingles of several texts, with how often each occurs."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(b).decode("utf-8", "surrogatepass") for b in blobs]
    parts = []
    for part in chunks(texts):
        h, o, c = weighted(*shingles([texts[i] for i in part]))
        parts.append((h, o + part[0], c))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices ``first[k], first[k] + 1, ...``, ``length[k]`` of them, one ``k`` after the other."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def similar_classes(h: np.ndarray, o: np.ndarray, c: np.ndarray, label: np.ndarray,
                    similarity: float) -> list[tuple[int, int]]:
    """Links ``(j, i)`` with ``j < i`` of sets that join the classes ``label`` of the sets.

    Each set, in order, gets a link to the first set before it in every class but its own
    that has one at least ``similarity`` like it (weighted Jaccard); classes that a link joins
    are one from then on. Two such sets share ``similarity`` times the larger weight, so with
    elements in one order, rarest first, the first one they share is followed by that much in
    either set: only sets that meet in such an element are compared. No pair is lost by that.
    """
    n, label, links = len(label), label.copy(), []
    _, el = np.unique(h, return_inverse=True)
    often = np.bincount(el)
    rarest = np.lexsort((el, often[el], o))
    weight = np.bincount(o, weights=c, minlength=n)
    ends = np.cumsum(np.bincount(o, minlength=n))
    starts = ends - np.bincount(o, minlength=n)
    before = np.cumsum(c[rarest]) - c[rarest]
    left = weight[o] - (before - before[np.minimum(starts, len(o) - 1)][o])
    head = rarest[(left >= similarity * weight[o] - 1e-6) & (often[el[rarest]] > 1)]
    met = head[np.lexsort((o[head], el[head]))]  # by element, in each by set
    first = np.searchsorted(el[met], np.arange(len(often)))
    place = np.arange(len(met))
    mine = np.argsort(o[met], kind="stable")
    upto = np.searchsorted(o[met][mine], np.arange(n + 1))
    count = np.zeros(len(often), np.int64)
    for i in range(n):
        at = place[mine[upto[i]:upto[i + 1]]]
        begin = first[el[met[at]]]
        others = o[met[_ranges(begin, at - begin)]]
        others = np.unique(others[label[others] != label[i]])
        others = others[np.minimum(weight[others], weight[i]) >= similarity * np.maximum(weight[others], weight[i])]
        if not len(others):
            continue
        own = slice(starts[i], ends[i])
        count[el[own]] = c[own]
        length = ends[others] - starts[others]
        theirs = _ranges(starts[others], length)
        both = np.add.reduceat(np.minimum(count[el[theirs]], c[theirs]), np.cumsum(length) - length)
        count[el[own]] = 0
        for j in others[both / (weight[others] + weight[i] - both) >= similarity].tolist():
            if label[j] != label[i]:
                links.append((j, i))
                label[label == label[i]] = label[j]
    return links


def _finish(similarity: float):
    """Links between the classes that meet in one small bucket, with the classes they join."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, classes = pdf["node"].tolist(), pdf["component"].tolist()
        size = Counter(classes)
        # the largest class first: a member of another one looks for its first link in it
        order = sorted(range(len(nodes)), key=lambda i: (-size[classes[i]], classes[i], nodes[i]))
        number = {c: k for k, c in enumerate(size)}
        label = np.array([number[classes[i]] for i in order])
        blobs = pdf["blob"].tolist()
        links = similar_classes(*_bags([bytes(blobs[i]) for i in order]), label, similarity)
        return pd.DataFrame([(nodes[order[j]], nodes[order[i]], classes[order[j]], classes[order[i]])
                             for j, i in links], columns=["a", "b", "class_a", "class_b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, n_links, kept``.

    Documents are linked when the weighted Jaccard similarity of their 5-word
    shingles is at least ``similarity``; a class is a connected component, named
    by its smallest id, and the document of that id stays. ``n_links`` counts the
    verified links that the document's content has to other contents (1 link at
    least joins every member of a class of differing contents).

    Contents with the same shingles (exact copies among them) count once from the
    sketch on. Distinct contents that share a band and are of similar length (others
    cannot be linked) meet in a bucket. Per round each bucket compares one member
    with all others - never all pairs - and drops it; one minus the similarity is a
    metric, so members whose distances to that one differ by more than
    ``1 - similarity`` cannot be linked, and the bucket splits there; buckets whose
    members are in one class already are done. What is left of a bucket, once it has
    at most :data:`LOCAL_MEMBERS` members, is finished in one task; larger rests are
    banded again by other coordinates for the next round. So the only links between
    classes that can be lost are those the bands miss, however large a bucket is.

    Texts without words, null ones included, are each a class of their own (their
    ids as class). Rows with one id are one document and stay or go together; null
    ids are one id, which comes first. An empty table gives an empty result. Other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sketch = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                    .mapInPandas(_sketch(bands, rows), f"doc_id {id_type}, node binary, weight long, "
                                 "keys array<long>, blob binary"), "sketch")
    contents = stored(sketch.where("node IS NOT NULL").groupBy("node")
                      .agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("copies"),
                           F.min("weight").alias("weight"), F.min("keys").alias("keys")), "contents")
    each = contents.select("node", "weight", F.posexplode("keys").alias("band", "key")) \
        .select("node", "weight", F.xxhash64("band", "key").alias("key"))
    shared = stored(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    # weights in a ratio of at most 1 / similarity share a step or the next
    step = F.floor(F.log(F.col("weight").cast("double")) / -math.log(similarity))
    sized = stored(each.join(shared, "key").withColumn("step", F.explode(F.array(step, step + 1)))
                   .select("node", "weight", F.xxhash64("key", "step").alias("key")), "sized")
    again = sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(sized.join(again, "key"), "members")
    # a content that meets many others is close to most of its family: the best centre
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    members = stored(members.drop("n").join(rank, "node"), "ranked")
    firsts = members.select("node").distinct().join(contents.select("node", "first.doc_id"), "node")
    # a text for each content with a bucket partner; rows of one id and content agree in it
    texts = stored(sketch.where("node IS NOT NULL").select("doc_id", "node", "blob").join(
        firsts.select(F.col("node").alias("fn"), F.col("doc_id").alias("fd")),
        (F.col("node") == F.col("fn")) & F.col("doc_id").eqNullSafe(F.col("fd")))
        .groupBy("node").agg(F.min("blob").alias("blob")), "texts")

    centers = members.groupBy("key").agg(F.max(F.struct("rank", "node"))["node"].alias("a"))
    links = component = None
    level = 0
    while True:
        rows_now = stored(members.select("key", "node", "weight", "rank").join(centers, "key")
                          .where("node <> a").withColumnRenamed("node", "b"), "rows")
        pairs = rows_now.select("a", "b").distinct()
        sims = stored(pairs.join(texts.select(F.col("node").alias("a"), F.col("blob").alias("blob_a")), "a")
                      .join(texts.select(F.col("node").alias("b"), F.col("blob").alias("blob_b")), "b")
                      .select("a", "b", "blob_a", "blob_b")
                      .mapInPandas(_verify, "a binary, b binary, sim double"), "sims")
        found = sims.where(F.col("sim") >= similarity).select("a", "b")
        links = stored(found if links is None else links.unionByName(found).distinct(), "alllinks")
        component = connected_components(links)
        members = stored(_open_buckets(rows_now, sims, component, 1.0 - similarity), "members")
        large = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("w")) \
            .where((F.col("n") > LOCAL_MEMBERS) | (F.col("w") > LOCAL_SHINGLES))
        large = stored(large.select("key"), "large")
        # equal rests of several bands are finished once
        rests = members.join(large, "key", "left_anti").groupBy("key").agg(
            F.array_sort(F.collect_list(F.struct("node", "component", "weight"))).alias("rest"))
        rests = rests.select("rest").distinct().select(
            F.xxhash64("rest").alias("key"), F.inline("rest"))
        last = stored(rests.join(texts, "node").groupBy("key")
                      .applyInPandas(_finish(similarity), "a binary, b binary, class_a binary, class_b binary"),
                      "finished")
        links = links.unionByName(last.select("a", "b")).distinct()
        if large.isEmpty():
            break
        level += 1
        rest = members.join(large, "key", "left_semi")
        keys = stored(rest.select("node").distinct().join(texts, "node")
                      .mapInPandas(_band_again(level), "node binary, keys array<long>"), "keys")
        finer = stored(rest.join(keys, "node").select(
            "node", "component", "weight", "rank", "key", F.posexplode("keys").alias("band", "part"))
            .select("node", "component", "weight", "rank", F.xxhash64("key", "band", "part").alias("key")), "finer")
        mixed = finer.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
            .where("lo <> hi").select("key")
        members = stored(finer.join(mixed, "key"), "members")
        if members.isEmpty():
            break
        # on from the best centre of a bucket's smallest class
        centers = members.groupBy("key", "component").agg(
            F.count("*").alias("n"), F.max(F.struct("rank", "node"))["node"].alias("a")) \
            .groupBy("key").agg(F.min(F.struct("n", "a"))["a"].alias("a"))

    links = stored(links, "links")
    # the classes so far, and which of them the links of the last round join
    joined = connected_components(last, "class_a", "class_b") \
        .select(F.col("node").alias("component"), F.col("component").alias("into"))
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) \
        .groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    linked = stored(contents.select("node", "first", "copies").join(component, "node", "left")
                    .join(degree, "node", "left")
                    .select("node", "first", "copies", F.coalesce("component", "node").alias("component"),
                            F.coalesce("n_links", F.lit(0)).alias("n_links"))
                    .join(joined, "component", "left")
                    .withColumn("component", F.coalesce("into", "component")).drop("into"), "linked")
    classes = linked.groupBy("component").agg(F.min("first").alias("c"), F.sum("copies").alias("class_size"))
    named = stored(linked.join(classes, "component").select("node", "c", "class_size", "n_links"), "named")
    out = sketch.select("doc_id", "node").join(named, "node", "left")
    return out.select(
        "doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("c.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("c").isNull() | F.col("doc_id").eqNullSafe(F.col("c.doc_id")), F.lit(True)).alias("kept"))


def _open_buckets(rows: DataFrame, sims: DataFrame, component: DataFrame, reach: float) -> DataFrame:
    """What is left of the buckets: without their centres, split where the distances
    to the centre leave a gap wider than ``reach``, and only where two classes meet."""
    from pyspark.sql import Window as W

    known = rows.join(sims, ["a", "b"]).select("key", F.col("b").alias("node"), "weight", "rank",
                                               (1.0 - F.col("sim")).alias("far"))
    with_class = known.join(component, "node", "left").select(
        "key", "node", "weight", "rank", "far", F.coalesce("component", "node").alias("component"))
    # most buckets hold one class now and are done before anything is sorted
    mixed = with_class.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    by_far = W.partitionBy("key").orderBy("far", "node")
    gap = F.col("far") - F.lag("far").over(by_far) > reach + 1e-9
    split = with_class.join(mixed, "key").withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")) \
        .withColumn("part", F.sum("gap").over(by_far.rowsBetween(W.unboundedPreceding, 0)))
    parts = stored(split.select(F.xxhash64("key", "part").alias("key"), "node", "component", "weight", "rank"),
                   "parts")
    still = parts.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("key")
    return parts.join(still, "key")


#: DuckDB SQL for the query: all pairs of texts that share a shingle, and their closure.
NEAR_DEDUP_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
q AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, w[pos + 1:pos + 5] AS sh, count(*) AS c FROM q GROUP BY ALL),
t AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN t u ON u.doc_id = a JOIN t v ON v.doc_id = b WHERE k / (u.n + v.n - k) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
m AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM m
"""
