"""Small tables with everything that may go wrong in a row."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows(extra=()):
    """Null in any column, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    words = ["the", "of", "Ñandú", "and", "x1", "ß", "tion", "er", "#hash", "50%"]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(900))
    plain = " ".join(rng.choice(words) + str(i % 7) for i in range(90))
    rows = [
        (1, plain, "en", "a", len(plain)), (1, plain, "en", "a", len(plain)), (2, plain, "de", "b", None), (3, None, "en", "a", 0),
        (4, "", "en", None, 0), (5, " \t\x0b\x0c\r\n ", None, "a", 6), (None, plain + " more", "en", "a", 1), (None, None, None, None, None),
        (6, long, "fr", "c", len(long)), (7, "one", "en", "a", 3), (7, "two words", "en", "a", 9), (8, "a\nb\na\n\n\na b c a b c", "en", "b", 5),
    ]
    return rows + list(extra)


def stored(spark, tmp_path, rows, schema=DOC, name="documents"):
    """The rows as a table read from files, as the queries see them."""
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
