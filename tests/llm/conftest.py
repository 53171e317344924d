import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, and awkward ones.
EXTRA = ["row", "digest", "sid", "size", "key", "slot", "h", "pattern", "quality", "language", "host", "site", "place", "copies", "bucket", "block", "node", "t", "a b.c"]


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"wort{k % 977} und{k % 13}" for k in range(60_000)) + "."
    rows = [
        (1, "The cat sat on the mat and it was happy with that for a while.", "en", "a"),
        (1, "The cat sat on the mat and it was happy with that for a while.", "en", "a"),
        (2, "The cat sat on the mat and it was happy with that for a while.", None, None),
        (None, "The cat sat on the mat and it was happy with that for a while.", "en", "a"),
        (None, None, None, None),
        (3, None, "de", "a"),
        (4, "", "de", ""),
        (5, "", None, "null"),
        (6, " \n\t\n ", "fr", "a"),
        (7, long, "de", "b"),
        (8, long, "de", "b"),
        (9, "x", "es", "b"),
        (10, "😀 日本語のテキスト", "en", "b"),
        (11, "El perro come en la casa y la niña lee un libro con su madre.", "es", "b"),
        (12, "Le chat est sur la table et il ne veut pas descendre du tout.", "fr", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.when(F.col("doc_id") > 3, F.lit(c)) for c in EXTRA})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k not in (5, 9)), None) for k in range(13)] + [(None, 1, 0), (7, None, None), (8, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def same(nasty):
    def check(kept, ids):
        assert kept.columns == nasty.columns
        assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == ids

    return check
