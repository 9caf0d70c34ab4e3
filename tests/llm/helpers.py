"""Small tables with what an operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp bigint, ids int, component_id string"
LONG = "the quick brown fox said 'tis nothing and jumps over " * 2500
TEXTS = [None, "", " ", "a", "\n\n \n x  y", "Hello, world! It's 12:30.", "naïve café — 東京 ﬁ ½ é", "<|endoftext|> a <|endoftext|>b", "12 34 ...", LONG, "x" * 5000, "tab\tand\x0bvt\x1cfs nbsp em"]


def documents(spark, texts=None, extra=()):
    rows = [(i, t) for i, t in enumerate(TEXTS if texts is None else texts)] + list(extra)
    return spark.createDataFrame([(i, t, "en", "s", 1, "own", 7, 3, "own") for i, t in rows], SCHEMA)


def awkward(spark):
    """TEXTS, two repeated rows and two null ids."""
    return documents(spark, extra=[(5, TEXTS[5]), (5, TEXTS[5]), (None, "null id"), (None, None)])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
