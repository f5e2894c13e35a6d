"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size int, `__mine` string"
LONG = "the quick brown fox jumps over the lazy dog, and on it goes. " * 4000
TEXTS = ["Hello there, world.", "", None, "  \n\t ", "Hello there, world.", LONG, "123 456", "naïve café – ünïcode ☃ 𝒳", "a", "one two three four five six"]


def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", None, 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "Hello there, world.", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))
