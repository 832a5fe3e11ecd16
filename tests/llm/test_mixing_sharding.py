"""Mixing, sharding and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from roughcut.llm import mixing
from roughcut.llm.common import stored
from roughcut.llm.mixing import cube_mix, flight
from roughcut.llm.queries import ORACLE_SQL, QUERIES
from roughcut.llm.sharding import rendezvous_shards
from tests.conftest import SF001, SF01
from tests.llm.conftest import table
from tests.oracle_check import compare, duck


def brute_targets(sizes, budget=1.5, cap=2.0):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), dict.fromkeys(names, 0.0), list(names)
    while open_ and left > 1e-9:
        total, share = sum(weight[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.remove(s)
    return target


def check_mix(got):
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.copies
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        biggest = max((r.size for r in got if r.source == s), default=0)
        assert abs(taken[s] - targets[s]) <= 2 * biggest
    assert all(r.source_size == sizes[r.source] for r in got)


def test_mix_of_the_given_table(spark):
    df = spark.read.parquet(f"{SF01}/documents.parquet")
    got = cube_mix(df).collect()
    assert len(got) == df.count()
    check_mix(got)
    again = cube_mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_with_small_chunks_takes_several_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None, "abc"[i % 3] if i % 7 else None) for i in range(900)]
    got = cube_mix(table(spark, rows), chunk_rows=4).collect()
    assert len(got) == 900
    check_mix(got)


def test_mix_cases(spark, odd):
    got = cube_mix(odd).collect()
    assert len(got) == odd.count()
    check_mix(got)
    assert cube_mix(odd.limit(0)).collect() == []
    empty = cube_mix(table(spark, [(1, "", None, "a"), (2, None, None, "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_flight_balances_and_keeps_expectations():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 50, 200)
    p = np.full(200, 0.37)
    runs = np.array([flight(p, size, np.random.default_rng(i)) for i in range(300)])
    for r in runs[:50]:
        left = (r > 1e-9) & (r < 1 - 1e-9)
        assert left.sum() <= 2
        assert abs(r.sum() - p.sum()) < 1e-6 and abs((r * size).sum() - (p * size).sum()) < 1e-4
    assert np.abs(runs.mean(axis=0) - 0.37).max() < 5 * (0.37 * 0.63 / 300) ** 0.5
    assert flight(np.array([0.0, 1.0]), np.array([3, 4]), rng).tolist() == [0.0, 1.0]
    equal = flight(np.full(9, 1 / 3), np.full(9, 5), rng)
    assert abs(equal.sum() - 3) < 1e-6


def test_shards_follow_the_key(spark, odd):
    rows = [(i, f"text {i % 11}") for i in range(3000)]
    got = rendezvous_shards(table(spark, rows), shards=8).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and all(abs(n - 375) < 5 * 18.2 for n in counts.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the grown shards are what one more shard gives, and other rows do not matter
    more = {r.doc_id: r.shard for r in rendezvous_shards(table(spark, rows[::2]), shards=9).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in got if r.doc_id in more)
    assert 0.05 < sum(r.grown_shard == 8 for r in got) / 3000 < 0.18


def test_shard_weights(spark):
    rows = [(i, "x") for i in range(4000)]
    got = Counter(r.shard for r in rendezvous_shards(table(spark, rows), shards=3, weights=[1, 2, 5]).collect())
    assert [abs(got[s] / 4000 - w / 8) < 0.04 for s, w in enumerate((1, 2, 5))] == [True] * 3
    with pytest.raises(ValueError):
        rendezvous_shards(table(spark, rows), shards=3, weights=[1, 2])


def test_shard_cases(spark, odd):
    got = rendezvous_shards(odd, keep=["text", "lang", "shard"]).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.shard)
        assert r.text is not None or (r.size, r.text_crc32) == (8, 0)
    assert all(len(s) == 1 for s in by.values())
    assert rendezvous_shards(odd.limit(0)).collect() == []


def test_shards_shuffle_what_they_carry_once(spark, odd):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rendezvous_shards(odd, keep=["text"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == odd.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = [sorted(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF01), name)
        assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
    letters = {d for d, r in before.items() if any(c.isalpha() for c in r.text or "")}
    assert set(kept[1]) <= letters and len(kept[1]) > 0.98 * len(letters)
    classes = QUERIES["op1_minhash_near_dedup"](spark, SF01).collect()
    assert len(kept[2]) >= sum(r.kept for r in classes) - (1000 - len(kept[1]))
    hit = {r.doc_id for r in QUERIES["op9_decontamination"](spark, SF01).collect()}
    assert set(kept[3]) == set(kept[2]) - hit
    assert set(kept[4]) <= set(kept[3]) and max(Counter(kept[4]).values()) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF01).collect()
    assert sorted(r.doc_id for r in out) == kept[4]
    assert {"shard", "slot", "text", "lang", "source"} <= set(out[0].asDict())


def test_pipeline_of_odd_documents(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {5, 8, 9}


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_with_clashing_columns_and_empty_tables(spark, odd, rows, tmp_path):
    docs = odd if rows == "odd" else odd.limit(0)
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    (items if rows == "odd" else items.limit(0)).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)), name)
        if name != "sharding":
            assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
        assert rows == "odd" or out.isEmpty()
        # every stage must cope with all rows, so the next one gets them again
        assert {"doc_id", "text"} <= set(out.columns)


def test_stages_decide_row_by_row(spark, tmp_path):
    def text(k, n=60):
        return " ".join(f"w{k}x{i}" for i in range(n))
    item = text("item", 12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(None, text("a")), (None, text("b")), (None, text("c") + " " + item), (1, text("d")), (1, text("e") + " " + item)]
    left = stages["decontamination"](spark, table(spark, rows), str(tmp_path)).collect()
    assert sorted(r.text for r in left) == [text(k) for k in "abd"]

    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (2, text("b") + " end"),
            (3, text("d")), (3, text("d")), (4, text("d") + " end"), (4, text("e"))]
    left = stages["near_dedup"](spark, table(spark, rows).repartition(3), str(tmp_path)).collect()
    assert sorted(r.text.split()[0][1] for r in left) == list("abde")
    assert {(r.doc_id, r.text) for r in left} == {
        (None, text("a")), (2, text("b") + " end"), (3, text("d")), (4, text("e"))}

    # a third of the rows without an id, and equal rows of an id in two sources
    rng = np.random.default_rng(4)
    rows = [(i if i % 3 else None, " ".join(["w"] * int(rng.integers(1, 40))), None, "abc"[i % 2 + (i % 5 == 0)])
            for i in range(900)] + [(5000, "w w w", None, s) for s in "aabb" for _ in range(9)]
    docs = table(spark, rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    mixed = [stages["mixing"](spark, d, str(tmp_path)).collect() for d in (docs, docs.repartition(7))]
    for r in mixed[0]:
        taken[r.source] += len(r.text.split())
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 80 for s in sizes)
    assert Counter(map(tuple, mixed[0])) == Counter(map(tuple, mixed[1]))


# ------------------------------------------------------------------- SQL
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duck(SF001)
    status, message, _ = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF001,
                                 df=QUERIES[name](spark, SF001))
    assert status == "ok", message
