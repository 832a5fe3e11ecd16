import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that the operators use inside
          "row long, size long, node string, key string, p double, w string, shard int, doc long, runs string")


def table(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]) with extra columns of clashing names."""
    full = []
    for r in rows:
        r = tuple(r) + (None,) * (4 - len(r))
        full.append(r + (None, 7, 8, "x", "y", 0.5, "z", 3, 9, "q"))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a very long one, ties, repeated rows, null ids and sources."""
    long_text = " ".join(f"wort{i % 9973} zeile{i % 13}" for i in range(60_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "!!! 123 ???", "de", "b"),
            (5, long_text, "de", "b"), (6, "one two three four five six seven", "en", "a"),
            (7, "one two three four five six seven", "en", None), (7, "one two three four five six seven", "en", None),
            (None, "one two three four five six seven", "en", "c"), (None, None, None, None),
            (8, "\x00 null byte ퟿ \U0001f600 é" * 20, "fr", "c"), (9, "a", "en", "b")]
    return table(spark, rows)
