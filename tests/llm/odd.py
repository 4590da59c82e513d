"""Odd inputs every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, row string, base string, spans string, `key` string"


def docs(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]), with columns whose names clash with those of the operators."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, 1, 2.0, "x", "y", None, "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


#: Nulls, empty texts, repeated rows, blanks only, very long words and texts, code points beyond the first plane.
ODD = [(1, None), (None, "no id here"), (2, ""), (3, "same text twice"), (3, "same text twice"), (4, " \t\n\x0b\x0c\r "), (5, "a" * 30_000),
       (6, "lorem ipsum dolor sit amet " * 3_000), (7, "héé 中文 \U0001f600 \x1c  x"), (8, "x <|endoftext|> y"), (None, None)]
