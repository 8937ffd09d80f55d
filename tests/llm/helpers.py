"""Small tables with every kind of odd row."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", "en", "s", 6),
    (4, "one", "en", None, 3),
    (5, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 45),
    (6, "alpha beta gamma delta epsilon zeta eta theta", None, "s", 45),
    (6, "alpha beta gamma delta epsilon zeta eta theta", None, "s", 45),
    (None, "a row without id", "en", "s", 16),
    (7, "long " * 60_000, "de", "s", 300_000),
    (8, "x" * 50_000, "de", "s", 50_000),
    (9, "Ünïcödé 漢字 🙂 ﬁ é ▁ \x00 　end's 12,345.67", "fr", "s", 40),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
