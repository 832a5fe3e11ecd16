"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from roughcut.llm.periodic import periodic_runs, strongest
from roughcut.llm.queries import QUERIES
from roughcut.llm.runs import branching_squares, runs, suffix_array
from tests.conftest import SF001
from tests.llm.conftest import table


def brute(w, least=24, times=3):
    """(start, length, smallest period) of every maximal run, period by period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def random_text(rnd):
    n, k = rnd.randint(0, 80), rnd.choice([1, 2, 3, 5])
    w = [rnd.randrange(k) for _ in range(n)]
    if n and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least", [24, 6, 3])
def test_runs_of_many_texts_equal_brute_force(least):
    rnd = random.Random(least)
    for _ in range(300):
        texts = [random_text(rnd) for _ in range(rnd.randint(1, 4))]
        codes, own, want, base = [], [], [], 0
        for w in texts:
            o = len(codes)
            codes += [base + x for x in w] + [base + 50]
            own += [o] * (len(w) + 1)
            want += [(o + s, n, q) for s, n, q in brute(w, least)]
            base += 100
        got = runs(np.array(codes), np.array(own), least)
        assert list(zip(*[x.tolist() for x in got])) == want


def test_suffix_array_and_squares_equal_definitions():
    rnd = random.Random(5)
    for _ in range(100):
        w = [rnd.randrange(2) for _ in range(rnd.randint(1, 40))] + [9]
        order = suffix_array(np.array(w))[0]
        assert order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        got = set(zip(*[x.tolist() for x in branching_squares(np.array(w))]))
        want = {(i, q) for q in range(1, len(w)) for i in range(len(w) - 2 * q)
                if w[i:i + q] == w[i + q:i + 2 * q] and w[i + q] != w[i + 2 * q]}
        assert {(i, q) for i, q in got if q} == want


def test_a_long_text_of_one_word_is_one_run():
    codes = np.r_[np.zeros(200_000, np.int64), 1]
    got = runs(codes, np.zeros(len(codes), np.int64))
    assert [x.tolist() for x in got] == [[0], [200_000], [1]]


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    tested = 0
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        o = got[r.doc_id]
        assert (o.n_runs, o.start, o.length, o.period) == (len(found), *best)
        assert o.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert o.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert o.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        tested += bool(found)
    assert tested >= 10


def test_odd_and_empty_tables(spark, odd):
    rows = periodic_runs(odd.union(table(spark, [(70, "la " * 40), (None, "x y " * 12 + "x")]))).collect()
    assert len(rows) == odd.count() + 2
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_words == by[2].n_words == 0 and by[1].runs == [] and by[1].collapsed == ""
    assert [tuple(x) for x in by[70].runs] == [(0, 40, 1)] and by[70].collapsed == "la"
    assert any([tuple(x) for x in r.runs] == [(0, 25, 2)] and r.collapsed == "x y" for r in rows if r.doc_id is None)
    assert by[5].n_words == 120_000 and len(by[5].collapsed.split(" ")) <= 120_000
    empty = periodic_runs(odd.where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_strongest_compares_exactly(spark):
    df = spark.createDataFrame(
        [([(0, 30, 10), (5, 24, 8), (40, 27, 9)],), ([(0, 24, 8), (30, 25, 8)],), ([],)],
        "runs array<struct<start:long,length:long,period:long>>")
    got = [r.b for r in df.select(strongest().alias("b")).collect()]
    assert tuple(got[0]) == (0, 30, 10) and tuple(got[1]) == (30, 25, 8) and got[2] is None
