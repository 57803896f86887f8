"""Edge cases that all document operators share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, spans int, label string"


def frame(spark, rows):
    """Rows (doc_id, text[, lang, source]) with extra columns whose names clash with those that operators make."""
    full = [(i, t, *(more or ["en", "src"]), 0, "x", "y", 1, "z") for i, t, *more in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Null, empty and blank texts, ties, repeated rows, a null id, a long text."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three four five six seven eight nine"), (5, "one two three four five six seven eight nine"),
        (5, "one two three four five six seven eight nine"), (6, "word"), (7, "été 日本 😀 \x01 ok"), (8, "abc def " * 30_000), (None, "one two"),
    ]
