"""Documents with the hard cases: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

from tierloom.operators.tables import table

SMALL = "/root/testdata/sf0.001"
WORDS = "der die and the of le la que ### foo bar baz qux Thnt".split()


def hard(spark, empty=False):
    long = " ".join(WORDS[i * i % len(WORDS)] + str(i % 97) for i in range(20000))
    rows = [
        (1, "The quick brown fox jumps", "en", "a", 5),
        (2, "The  quick\tbrown fox\njumps", "en", "a", 5),
        (3, "The quick brown fox jumps", None, None, None),
        (3, "The quick brown fox jumps", None, None, None),
        (4, None, "en", "b", None),
        (5, "", "en", "b", 0),
        (6, " \n\t ", None, "b", 3),
        (None, "the quick brown fox jumps over", "de", "c", 6),
        (None, None, None, None, None),
        (7, long, "en", "a", 1),
        (8, long + " x", "en", "a", 1),
        (9, "größe ẞ é 日本語テスト 🙂   x y", "de", "", 9),
        (10, "one", "en", "c", 1),
        (11, "a" * 5000, "en", "c", 1),
    ]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([] if empty else rows, kind)
    for clash in ("uid", "_uid", "fp", "n", "rank", "size", "src", "digest", "kept", "_words", "x", "score", "word"):
        df = df.selectExpr("*", f"'clash' AS {clash}")
    return df


def documents(spark):
    return table(spark, SMALL, "documents")
