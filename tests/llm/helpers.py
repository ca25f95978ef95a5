"""Small tables with what operators must bear: nulls, empty and long texts, repeats, extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lorem ipsum dolor sit amet 12 été " * 4000
ODD = [
    (1, "the cat sat on the mat and ran away", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, LONG, "fr", "a", 5),
    (5, "the cat sat on the mat and ran away", "en", "b", 1),
    (5, "the cat sat on the mat and ran away", "en", "b", 1),
    (6, "  \t\n ", "en", "c", 1),
    (None, "no id here", "en", "a", 1),
    (7, "漢字 emoji 😀 </s> \\ end", "zh", "c", 2),
]
#: Names that operators use inside.
CLASHING = ["row", "score", "predicted", "id", "n", "b", "g", "h", "shard", "slot", "_text", "_key", "_slot", "_stream", "root", "node", "tile", "bits", "unit", "held_out"]


def docs(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, DOCS)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
