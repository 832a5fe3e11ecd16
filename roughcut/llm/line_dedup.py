"""Line deduplication: winnowed line hashes find repeated runs of lines, later runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.llm.common import stored, text_or_empty

#: A repeated run goes when it has this many lines, or this many words, or is a whole text
#: both times. Windows of the winnowing are the shortest stretches that reach one of both.
RUN_LINES = 3
RUN_WORDS = 50
BLANK = " \t\r\x0b\x0c"
#: Lines to both sides of a fingerprint that are compared with it.
_SIDE = RUN_LINES - 1


def _selected(seq: Column) -> Column:
    """Places of the fingerprints of a text: of each window the line of the least hash (the
    last of equal ones). The window at a place is the shortest stretch from there on of
    RUN_LINES lines or RUN_WORDS words; a text that is shorter is one window."""
    size = F.size(seq)

    def least(i: Column) -> Column:
        words = [F.coalesce(F.get(seq, i + j)["w"], F.lit(0)) for j in range(_SIDE)]
        enough = F.when(words[0] >= RUN_WORDS, F.lit(1)).when(words[0] + words[1] >= RUN_WORDS, F.lit(2)).otherwise(F.lit(RUN_LINES))
        part = F.transform(F.slice(seq, i + 1, enough), lambda x, j: F.struct(x["x"].alias("x"), (-j).alias("j")))
        return F.when((i + enough <= size) | (i == 0), i - F.array_min(part)["j"])
    at = F.transform(F.sequence(F.lit(0), size - 1), least)
    return F.when(size > 0, F.array_distinct(F.filter(at, lambda p: p.isNotNull()))).otherwise(F.array().cast("array<int>"))


def _units() -> list[tuple[int, int]]:
    """Stretches of one to RUN_LINES lines that hold the fingerprint: first and last line,
    counted from it."""
    return [(a, a + n - 1) for n in range(1, RUN_LINES + 1) for a in range(1 - n, 1)]


def _part(of: str, a: int, b: int) -> list[Column]:
    """The lines a to b from the fingerprint on, of the array ``of``."""
    return [F.get(of, F.lit(j + _SIDE)) for j in range(a, b + 1)]


def _fits(a: int, b: int) -> Column:
    """Whether the stretch lies in the text and is long enough to go where it repeats; 0 = no,
    1 = by its lines or words, 2 = only as a whole text."""
    inside = F.lit(True)
    for x in _part("xs", a, b):
        inside = inside & x.isNotNull()
    words = sum((F.coalesce(x, F.lit(0)) for x in _part("ws", a, b)), F.lit(0))
    long = (words >= RUN_WORDS) | F.lit(b - a + 1 == RUN_LINES)
    whole = F.col("n") == b - a + 1
    return F.when(inside & long, F.lit(1)).when(inside & whole, F.lit(2)).otherwise(F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, n_runs, kept_text``.

    Lines are parted by line feeds and compared without the blanks around them;
    empty lines do not count. A run of lines goes when the same lines came earlier (in a
    smaller id, or above in the same text; null ids come last; texts of one id come by a hash
    of the text) and it has at least :data:`RUN_LINES` lines or :data:`RUN_WORDS` words, one
    long line included, or is all of both texts. Runs are judged on the input, overlapping
    and adjacent ones join, and empty lines inside a removed run go with it. ``n_lines`` and
    ``n_removed`` count all lines, ``n_runs`` the maximal removed runs. Of rows that agree in
    id and text one counts as the first, the others as its copies; which is which cannot be
    told. A null text counts as empty; an empty text is one empty line and stays. An
    empty table gives an empty result. Other columns are not read.

    Only the winnowed fingerprints are stored and joined: a run that is long enough holds a
    whole window, and equal windows select the same line. The places of a fingerprint
    join its earliest place, and the match is extended to both sides line by line, as far as
    a run needs (longer runs grow together from the matches of their fingerprints).
    Stretches long enough that do not match the earliest place join the earliest
    place of the same stretch instead. Groups are reduced map-side to their earliest place and
    joined back, so a line in very many texts is a skewed join side that Spark can split.
    """
    text = text_or_empty(text_col)
    ref = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")),
                                 F.lit(" "), text).cast("binary")))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), ref.alias("ref"))

    def in_lines(df: DataFrame) -> DataFrame:
        """The lines, the lines without blanks around them, and the places of those not empty."""
        return df.withColumn("lines", F.split("text", "\n")).drop("text") \
            .withColumn("trimmed", F.transform("lines", lambda x: F.btrim(x, F.lit(BLANK)))) \
            .withColumn("at", F.filter(F.sequence(F.lit(0), F.size("trimmed") - 1), lambda i: F.get("trimmed", i) != ""))

    def line(x: Column) -> Column:
        return F.struct(F.xxhash64(x).alias("x"), F.unhex(F.md5(x.cast("binary"))).alias("h"),
                        F.size(F.split(x, f"[{BLANK}]+")).alias("w"))
    seq = F.transform(F.filter("trimmed", lambda x: x != ""), line)
    hashed = stored(in_lines(base).select("doc_id", "ref", seq.alias("seq")), "lines")

    # the winnowed fingerprints with the lines beside them
    sides = F.sequence(F.col("place") - _SIDE, F.col("place") + _SIDE)
    places = stored(hashed.withColumn("place", F.explode(_selected(F.col("seq")))).select(
        F.get("seq", F.col("place"))["h"].alias("fp"), F.col("doc_id").isNull().alias("z"), "doc_id", "ref", "place",
        F.size("seq").alias("n"), F.transform(sides, lambda i: F.get("seq", i)["x"]).alias("xs"),
        F.transform(sides, lambda i: F.get("seq", i)["w"]).alias("ws")), "places")

    # join each place with the earliest of its fingerprint
    order = F.struct("z", "doc_id", "ref", "place")
    first = stored(places.groupBy("fp").agg(F.min(order).alias("o"), F.max(order).alias("last"),
                                            F.min(F.struct("z", "doc_id", "ref", "place", "xs", "n")).alias("e"))
                   .where("o <> last").select("fp", "o", F.col("e.xs").alias("xs0"), F.col("e.n").alias("n0")), "first")
    near = places.join(first.hint("merge"), "fp").withColumn("o", order == F.col("o")).where("NOT o").drop("o")

    # extend line by line; what fits and differs goes on
    def matches(a: int, b: int) -> Column:
        same = F.lit(True)
        for x, y in zip(_part("xs", a, b), _part("xs0", a, b)):
            same = same & x.eqNullSafe(y)
        return same & ((_fits(a, b) == 1) | (F.col("n0") == F.col("n")))
    units = F.array(*[F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), _fits(a, b).alias("fits"), matches(a, b).alias("found"),
        F.array(*_part("xs", a, b)).alias("part")) for a, b in _units()])
    near = stored(near.select("fp", "z", "doc_id", "ref", "place", F.explode(
        F.filter(units, lambda u: u["fits"] > 0)).alias("u")).select("fp", "z", "doc_id", "ref", "place", "u.*"), "near")
    differ = near.where("NOT found")
    same = ["fp", "a", "b", "part", "fits"]
    again = stored(differ.groupBy(*same).agg(F.min(order).alias("o"), F.max(order).alias("last"))
                   .where("o <> last").select(*same, "o"), "again")
    later = differ.join(again.hint("merge"), same).where(order != F.col("o"))
    gone = (near.where("found").select("ref", "place", "a", "b").unionByName(later.select("ref", "place", "a", "b"))
            .select("ref", F.explode(F.sequence(F.col("place") + F.col("a"), F.col("place") + F.col("b"))).alias("k"))
            .groupBy("ref").agg(F.array_sort(F.collect_set("k")).alias("gone")))
    copies = stored(hashed.groupBy("ref").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")

    # texts meet what goes by their key (by the same join at every size); of rows of equal id
    # and text the first keeps what is new, the copies keep nothing but empty lines
    none = F.array().cast("array<int>")
    twin = copies.withColumnRenamed("ref", "twin")
    once = base.join(twin, F.col("ref") == F.col("twin"), "left_anti").withColumn("nr", F.lit(1).cast("long"))
    several = base.join(twin, F.col("ref") == F.col("twin")).dropDuplicates(["ref"]).withColumn(
        "nr", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*once.columns)
    marks = gone.withColumnRenamed("ref", "mark").hint("merge")
    out = in_lines(once.unionByName(several).join(marks, F.col("ref") == F.col("mark"), "left"))
    everything = F.when(F.size("at") > 0, F.sequence(F.lit(0), F.size("at") - 1)).otherwise(none)
    out = out.withColumn("gone", F.when(F.col("nr") > 1, everything).otherwise(F.coalesce("gone", none)))

    # rebuild each text from what lies between its runs
    begins = F.filter("gone", lambda k, i: (i == 0) | (F.get("gone", i - 1) != k - 1))
    ends = F.filter("gone", lambda k, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) != k + 1))
    out = out.withColumn("runs", F.transform(F.arrays_zip(begins.alias("lo"), ends.alias("hi")), lambda r: F.struct(
        F.get("at", r["lo"]).alias("lo"), F.get("at", r["hi"]).alias("hi"))))

    def piece(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["hi"] + 1)
        end = F.when(k == F.size("runs"), F.size("lines")).otherwise(F.get("runs", k)["lo"])
        return F.slice("lines", begin + 1, F.greatest(end - begin, F.lit(0)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), piece))
    return out.withColumn("kept", F.when(F.size("runs") == 0, F.col("lines")).otherwise(kept)).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"), F.array_join("kept", "\n").alias("kept_text"))


#: DuckDB SQL for the query, over all stretches of lines instead of fingerprints.
LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
         md5(coalesce('i' || CAST(doc_id AS VARCHAR), 'n') || ' ' || coalesce(text, '')) AS ref FROM documents),
e AS (SELECT r, doc_id, ref, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM l),
t AS (SELECT r, doc_id, ref, no, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM e),
s AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY no) AS k, count(*) OVER (PARTITION BY r) AS n,
             len(string_split_regex(line, '[ \\t\\r\\x0b\\x0c]+')) AS words FROM t WHERE line <> ''),
u AS (
  SELECT r, doc_id, ref, n, k, 1 AS size, words, [line] AS part FROM s
  UNION ALL SELECT a.r, a.doc_id, a.ref, a.n, a.k, 2, a.words + b.words, [a.line, b.line]
  FROM s a JOIN s b ON a.r = b.r AND b.k = a.k + 1
  UNION ALL SELECT a.r, a.doc_id, a.ref, a.n, a.k, 3, a.words + b.words + c.words, [a.line, b.line, c.line]
  FROM s a JOIN s b ON a.r = b.r AND b.k = a.k + 1 JOIN s c ON a.r = c.r AND c.k = a.k + 2),
v AS (SELECT *, CASE WHEN size = {RUN_LINES} OR words >= {RUN_WORDS} THEN 1 WHEN size = n THEN 2 ELSE 0 END AS fits FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY part, fits ORDER BY doc_id NULLS LAST, ref, r, k) AS nth FROM v WHERE fits > 0),
g AS (SELECT DISTINCT r, k + i AS k FROM f, range({RUN_LINES}) AS o(i) WHERE nth > 1 AND i < size),
h AS (SELECT g.r, g.k, s.no, g.k - row_number() OVER (PARTITION BY g.r ORDER BY g.k) AS run FROM g JOIN s ON g.r = s.r AND g.k = s.k),
runs AS (SELECT r, run, min(no) AS lo, max(no) AS hi FROM h GROUP BY r, run),
gone AS (SELECT DISTINCT e.r, e.no FROM e JOIN runs ON e.r = runs.r AND e.no BETWEEN lo AND hi),
kept AS (SELECT e.r, string_agg(e.line, chr(10) ORDER BY e.no) AS txt, count(*) AS n
         FROM e ANTI JOIN gone ON e.r = gone.r AND e.no = gone.no GROUP BY e.r)
SELECT l.doc_id, len(l.lines) AS n_lines, len(l.lines) - coalesce(kept.n, 0) AS n_removed,
       (SELECT count(*) FROM runs WHERE runs.r = l.r) AS n_runs,
       sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM l LEFT JOIN kept ON l.r = kept.r
"""
