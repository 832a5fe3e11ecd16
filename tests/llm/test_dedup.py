"""Exact, near, substring and line deduplication against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from roughcut.llm import common, components, near_dedup, substring_dedup
from roughcut.llm.components import connected_components
from roughcut.llm.exact_dedup import exact_dedup, possibly_repeated
from roughcut.llm.line_dedup import dedup_lines
from roughcut.llm.near_dedup import dart_signatures, near_duplicates, similar_classes
from roughcut.llm.shingles import jaccard, mix, shingles, weighted, word_hashes
from roughcut.llm.substring_dedup import dedup_substrings
from roughcut.llm.substrings import repeated_classes, segments
from tests.conftest import SF001
from tests.llm.conftest import table


def docs_of(sf):
    return sorted(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


# ------------------------------------------------------------------ exact
def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = Counter()
    for k, g in groups.items():
        g.sort()
        sha = hashlib.sha256(k.encode()).hexdigest()
        for i, m in enumerate(g):
            out[(m[3], g[0][3], len(g), i == 0, sha)] += 1
    return out


def test_exact_dedup_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(odd).collect())
    assert got == brute_exact(rows)


def test_exact_dedup_small_filter_stays_exact(spark):
    rows = [(i, f"text {i // 3 if i % 5 else i}" + " " * (i % 4)) for i in range(400)]
    df = table(spark, rows)
    for most in (1 << 12, 1 << 11):  # filters of two and four hash ranges
        got = Counter(tuple(r) for r in exact_dedup(df, max_filter_bits=most).collect())
        assert got == brute_exact(rows)


@pytest.mark.parametrize("most", [1 << 26, 1 << 17])
def test_few_single_texts_shuffle(spark, most):
    """With one filter and with many ranges: of texts that occur once, about (1 / 16)^2 count as
    possibly repeated; every repeated one does."""
    digest = spark.range(20_000).select(F.unhex(F.sha2(F.greatest("id", F.lit(2000)).cast("string").cast("binary"), 256)).alias("sha"),
                                        (F.col("id") <= 2000).alias("copy")).withColumn("hash", F.xxhash64("sha"))
    got = possibly_repeated(digest, max_filter_bits=most).groupBy("copy").agg(
        F.count("*").alias("n"), F.count_if("maybe").alias("maybe")).collect()
    got = {r.copy: (r.n, r.maybe) for r in got}
    assert got[True] == (2001, 2001) and got[False][0] == 17_999 and got[False][1] <= 0.01 * 17_999


def test_exact_dedup_empty(spark):
    assert exact_dedup(table(spark, [(1, "a")]).limit(0)).collect() == []


def test_exact_dedup_is_native(spark, odd):
    plan = exact_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# ------------------------------------------------------------------- near
def test_word_hashes_match_the_definition():
    texts = ["Ünïted  we-stand, 42x", "", "...", "a_b c d", "Zwölf\nBoxkämpfer"]
    h, o = word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", t.lower())]
    assert [i for i, _ in words] == o.tolist()
    again, _ = word_hashes(["\n".join(w for _, w in words)])
    assert again.tolist() == h.tolist()
    assert len(set(h.tolist())) == len({w for _, w in words})


def test_shingles_short_and_long():
    h, o = shingles(["a b c d e f", "a b", "", "b c d e f", "a b"])
    assert o.tolist() == [0, 0, 1, 3, 4]
    assert h[1] == h[3] and h[2] == h[4] and len({*h.tolist()}) == 3


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(5):
        common = mix(rng.integers(1, 1 << 60, 60).astype(np.uint64))
        a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
        h, o, w = np.r_[common, common], np.r_[np.zeros(60, int), np.ones(60, int)], np.r_[a, b]
        value, defined = dart_signatures(h, o, w, 2, 4096)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert defined.all()
        assert abs((value[0] == value[1]).mean() - true) < 4.5 * (true * (1 - true) / 4096) ** 0.5


def test_darts_do_not_depend_on_the_batch():
    h = mix(np.arange(1, 301, dtype=np.uint64))
    alone, _ = dart_signatures(h, np.zeros(300, int), np.ones(300), 1, 64)
    other = np.r_[h, h[:5]]
    both, _ = dart_signatures(other, np.r_[np.zeros(300, int), np.full(5, 2)], np.ones(305), 3, 64)
    assert (alone[0] == both[0]).all() and not both[1].any()


def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", (t or "").lower())
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            inter = sum((bags[i] & bags[j]).values())
            if inter and inter / sum((bags[i] | bags[j]).values()) >= 0.8:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    return {d: min(m) for m in members.values() for d in m}


def families(n=12, size=9, seed=3):
    """Chains of texts, each a light edit of the one before, so that classes are joined
    by links between members that the least member has no link to."""
    rng, rows, doc = random.Random(seed), [], 0
    for _ in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(size):
            rows.append((doc, " ".join(words)))
            doc += 1
            words = words[rng.randrange(0, 6):] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 6))]
    return rows


@pytest.mark.parametrize("local", [200, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(near_dedup, "LOCAL_MEMBERS", local)  # 3: the rounds over large buckets run too
    rows = families() + [(500 + i, f"w{i} same text here") for i in range(3)] + [(600, "w0 same text here")]
    got = near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicates_cases(spark, odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.class_id is None for r in by[7] + by[6]) and all(r.class_size == 4 for r in by[6])
    assert all(by[i][0].class_id == i and by[i][0].kept for i in (1, 2, 3, 4, 5, 8, 9))
    assert near_duplicates(odd.limit(0)).collect() == []


def brute_links(bags, label, similarity):
    label, links = list(label), []
    for i in range(len(bags)):
        for j in range(i):
            if label[j] != label[i] and jaccard(*bags[i], *bags[j]) >= similarity:
                links.append((j, i))
                label = [label[j] if x == label[i] else x for x in label]
    return links


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_classes_match_all_pairs(similarity):
    rng, links = random.Random(5), 0
    for _ in range(100):
        texts = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 120))]]
        for _ in range(rng.randrange(40)):
            words = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
            texts.append(words + words[:rng.choice([0, 0, rng.randrange(1, 9), len(words)])])
        h, o, c = weighted(*shingles([" ".join(t) for t in texts]))
        label = [rng.randrange(len(texts)) for _ in texts]
        bags = [(h[o == i], c[o == i]) for i in range(len(texts))]
        got = similar_classes(h, o, c, np.array(label), similarity)
        assert got == brute_links(bags, label, similarity)
        links += len(got)
    assert links > 300


def test_many_near_copies_that_are_not_linked_finish_fast():
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(1200):  # about 0.6 alike, each in a class of its own; the last is a copy of the first, nearly
        words = list(base)
        for at in rng.sample(range(150), 8):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append(words if i < 1199 else [*rows[0], "end"])
    pack, node = zstandard.ZstdCompressor(level=1), [i.to_bytes(4) for i in range(1200)]
    pdf = pd.DataFrame({"node": node, "component": node, "weight": [len(w) - 4 for w in rows],
                        "blob": [pack.compress(" ".join(w).encode()) for w in rows]})
    began = time.process_time()
    out = near_dedup._finish(0.8)(pdf)
    assert time.process_time() - began < 5  # 720,000 pairs one by one take several times as long
    assert list(zip(out["a"], out["b"])) == [(node[0], node[1199])]


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(components, "stored", lambda df, name: kept.append(name) or common.stored(df, name))
    df = spark.createDataFrame([(i, i % 3) for i in range(3, 60)] + [(1, 4), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: i % 3 for i in range(60)} and kept == ["links"]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)] + [(120, 200), (200, 200)]
    df = spark.createDataFrame([(b, a) for a, b in path + star], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 140), 200]}
    assert connected_components(df.limit(0)).collect() == []


# -------------------------------------------------------------- substrings
def brute_substrings(rows, length):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if seen.setdefault(w, (d, i)) != (d, i):
                cover[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_classes_of_repeated_strings():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, letters, length = int(rng.integers(1, 200)), int(rng.integers(1, 4)), int(rng.integers(8, 14))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        order, classes = repeated_classes(text, length)
        assert sorted(order.tolist()) == list(range(n))
        got, want, raw = defaultdict(list), defaultdict(list), text.tobytes()
        for p, c in zip(order.tolist(), classes.tolist()):
            if p + length <= n:
                got[c].append(p)
                want[raw[p:p + length]].append(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_segments_cover_all_windows_alike():
    rng = random.Random(1)
    common = bytes(rng.randrange(97, 101) for _ in range(400))
    texts = [common[50:300] + b"x" * 130, b"", b"short", common, b"a" * 300]
    buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    owner, start, windows, anchor, content = segments(buf, ends, 100)
    of = {}
    for o, s, n, a in zip(owner.tolist(), start.tolist(), windows.tolist(), anchor.tolist()):
        for i in range(s, s + n):
            assert of.setdefault(texts[o][i:i + 100], a) == a
    assert windows.sum() == sum(max(0, len(t) - 99) for t in texts)


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", crowd)  # 1: windows by hash
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4096)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcd efé") for _ in range(rng.randrange(60, 400))) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = [rng.choice(pool)[rng.randrange(0, 40):] if rng.random() < 0.6 else
                 "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 200))) for _ in range(4)]
        rows.append((d, "".join(parts)))
    rows += [(60, "z" * 500), (61, "z" * 99), (62, "ab" * 200), (63, None), (64, ""), (65, "\x00" * 150),
             (None, pool[0] + pool[1])]
    got = dedup_substrings(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_substrings(rows, 100)


def test_substrings_cases(spark, odd):
    got = dedup_substrings(odd, with_text=True).collect()
    assert len(got) == odd.count()
    # rows of one id are one document: the repeated row keeps its text
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert [r.n_removed for r in got if r.doc_id == 7] == [0, 0]
    assert dedup_substrings(odd.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [2000, 1])
@pytest.mark.parametrize("parts", [1, 7])
def test_substrings_of_repeated_and_null_ids(spark, monkeypatch, parts, crowd):
    monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", crowd)
    rng = random.Random(6)
    a, b, c, d, e, f = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(6))
    rows = [(1, a), (1, a), (2, b), (2, c), (3, c), (4, d), (5, a[50:200] + e),  # 1 twice, 2 with two texts
            (None, f), (None, f), (None, e + "x" * 40 + d), (None, "y" * 60 + f[:150])]
    got = dedup_substrings(table(spark, rows).repartition(parts, "lang" if parts == 1 else "text"), with_text=True).collect()
    kept = defaultdict(list)
    for r in got:
        kept[r.doc_id].append(bytes(r.kept).decode())
    assert [kept[i] for i in (1, 3, 4, 5)] == [[a, a], [""], [d], [e]]
    assert sorted(kept[2]) == sorted([b, c])  # no text of an id takes the other's cuts
    # which of the null ids comes first follows the order of the rows; nothing is lost
    null = sorted(kept[None], key=len)
    assert len(null) == 4 and null[0] == "" and "x" * 40 in null and e not in "".join(null) and d not in "".join(null)
    assert sum(map(len, null)) == 40 + 60 + 300
    assert f in null or f[:150] in "".join(null) and f[150:] in "".join(null)


def test_substrings_of_the_given_table(spark):
    got = dedup_substrings(spark.read.parquet(f"{SF001}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} \
        == brute_substrings(docs_of(SF001), 100)


# ------------------------------------------------------------------- lines
def brute_lines(rows, run=3, words=50):
    def ref(d, t):
        return hashlib.md5(f"{'n' if d is None else f'i{d}'} {t or ''}".encode()).hexdigest()
    blank = " \t\r\x0b\x0c"
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, ref(*r))):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(blank)]
        text = [lines[k].strip(blank) for k in at]
        drop = set()
        for k in range(len(text)):
            for n in range(1, min(run, len(text) - k) + 1):
                part = tuple(text[k:k + n])
                long = n == run or sum(len(re.split(f"[{blank}]+", x)) for x in part) >= words
                if long or n == len(text):
                    if (part, long) in seen:
                        drop |= set(range(k, k + n))
                    seen.add((part, long))
        runs = [k for k in sorted(drop) if k - 1 not in drop]
        gone = set()
        for lo in runs:
            hi = lo
            while hi + 1 in drop:
                hi += 1
            gone |= set(range(at[lo], at[hi] + 1))
        out.append((d, len(lines), len(gone), len(runs), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return Counter(out)


def lines_fixture(odd):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["", "  "] + [f"{i} " * 20 for i in range(4)] + [f"w{i} " * 60 for i in range(4)]
    rows = [(d, "\n".join(rng.choice(pool) + " " * rng.randrange(2) for _ in range(rng.randrange(0, 30))))
            for d in range(80)]
    rows += [(100 + d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 4)))) for d in range(60)]
    rows += [(d, t) for d, t in rows[:5]] + [(rows[6][0], rows[7][1]), (None, rows[8][1]), (None, rows[8][1]), (None, "new line")]
    return rows + [(r.doc_id, r.text) for r in odd.collect()]


@pytest.mark.parametrize("parts", [1, 6])
def test_lines_match_brute_force(spark, odd, parts):
    rows = lines_fixture(odd)
    got = Counter(tuple(r) for r in dedup_lines(table(spark, rows).repartition(parts)).collect())
    assert got == brute_lines(rows)
    assert dedup_lines(odd.limit(0)).collect() == []
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_long_lines_and_copies_of_short_texts_go(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), "just one line"
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n  {long}\nd"), (3, short), (4, short), (5, f"{short}\nand another"),
            (6, f"{short}\nand another"), (7, f"x\n{short}"), (8, " ".join(["few"] * 49)), (9, "q\n" + " ".join(["few"] * 49))]
    got = {r.doc_id: r.kept_text for r in dedup_lines(table(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "c\nd"
    assert got[3] == short and got[4] == "" and got[5] == rows[4][1] and got[6] == "" and got[7] == rows[6][1]
    assert got[9] == rows[8][1]


def test_only_selected_lines_are_joined(spark, monkeypatch):
    """Fingerprints are fewer than lines, and without their join nothing is found."""
    from roughcut.llm import line_dedup
    sizes = {}

    def spy(df, name):
        out = common.stored(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(line_dedup, "stored", spy)
    rng = random.Random(9)
    texts = [[f"line {rng.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    texts += [texts[0][:100] + texts[1][50:], texts[2]]
    rows = [(d, "\n".join(t)) for d, t in enumerate(texts)]
    removed = sum(r.n_removed for r in dedup_lines(table(spark, rows)).collect())
    assert removed == 100 + 150 + 200
    assert sizes["places"] < 0.6 * sum(map(len, texts)) and sizes["near"] < 0.5 * sum(map(len, texts))
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: common.stored(df.limit(0) if name == "first" else df, name))
    assert sum(r.n_removed for r in dedup_lines(table(spark, rows)).collect()) == 0
