"""Text counts against brute force, and learned rules on labels they have not seen."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from roughcut.llm.quality import COUNTS, DecisionList, learn_rules, quality_rules, text_counts
from roughcut.llm.queries import QUERIES
from tests.conftest import SF01, SF001
from tests.llm.conftest import table


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_counts_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab#c") for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    texts += ["".join(rnd.choice("a b\n\t\x0b\x1c é|") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_counts(df.repartition(3)).collect():
        assert tuple(r)[1:6] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_query_has_the_base_rule(spark):
    got = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, SF001).collect()}
    for d in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        want, r = brute(d.text), got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_held_out_labels(spark):
    """Rules from two thirds of the labels find the bad texts of the rest and leave the good ones."""
    docs = spark.read.parquet(f"{SF01}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/../sf0.1/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows, rules = quality_rules(docs, labels.where(~unseen))
    assert 1 <= len(rules.rules) <= 12
    hits = rows.where("NOT base_failed").join(labels.where(unseen), "doc_id").groupBy("quality").agg(
        F.avg((F.col("rule") > 0).cast("double")).alias("dropped"), F.count("*").alias("n"))
    got = {r.quality: r for r in hits.collect()}
    assert got[0].n > 50 and got[0].dropped >= 0.95 and got[1].dropped <= 0.01


def test_planted_rule_is_found_and_reruns_agree(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        words = [rnd.choice("abcdefghijklmnop") + str(j) for j in range(60)]
        if i % 5 == 0:  # bad: symbols and few lines
            words = [w + "##" for w in words]
        rows.append((i, ("\n" if i % 2 else " ").join(words), int(i % 5 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out, rules = quality_rules(df.select("doc_id", "text"), df.select("doc_id", "quality").repartition(5))
    assert len(rules.rules) == 1 and len(rules.rules[0].conditions) == 1
    assert {r.doc_id for r in out.where("rule > 0").collect()} == {i for i in range(900) if i % 5 == 0}
    _, again = quality_rules(df.select("doc_id", "text").repartition(7), df.select("doc_id", "quality"))
    assert [str(r) for r in again.rules] == [str(r) for r in rules.rules]


def test_first_rule_decides(spark):
    df = table(spark, [(1, "a " * 60 + "b " * 3), (2, "### " * 60)])
    counts = text_counts(df)
    from roughcut.llm.quality import Condition, Rule
    rules = DecisionList([Rule((Condition("words", True, 22),), 1, 0), Rule((Condition("symbol_share", True, 32),), 1, 0)])
    got = {r.doc_id: r.rule for r in counts.select("doc_id", rules.column().alias("rule")).collect()}
    assert got == {1: 1, 2: 1}
    assert {r.rule for r in counts.select(DecisionList().column().alias("rule")).collect()} == {0}


def test_odd_rows_labels_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 0, 1), (6, None, 0), (7, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    rows, rules = quality_rules(odd, labels)
    out = rows.collect()
    assert len(out) == odd.count() and rules.rules == []
    for r, d in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(odd.collect(), key=lambda d: str(d.doc_id))):
        if d.doc_id is not None:
            assert tuple(r)[1:6] == brute(d.text)
    assert {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0}
    for docs, lab in ((odd.where("false"), labels), (odd, labels.where("false")), (odd.where("false"), labels.where("false"))):
        rows, rules = quality_rules(docs, lab)
        assert rows.count() == docs.count() and rules.rules == []
    assert learn_rules(text_counts(odd).withColumn("bad", F.lit(None).cast("boolean"))).rules == []
    assert set(COUNTS) <= set(rows.columns)
