"""Documents with what goes wrong: nulls, empty and long texts, ties, repeated rows, clashing column names."""

DOC_SCHEMA = "doc_id long, text string, keys string, component string, class int, start int, score double"


def odd_documents(spark):
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(300_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it"),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it"),
        (2, None),
        (3, ""),
        (None, "no id here but words enough to count for something"),
        (None, None),
        (4, "one"),
        (5, "ONE"),
        (6, "two words"),
        (7, long),
        (8, "\n \t "),
        (9, "naïve ÀÉ 日本語 \x0b odd space   end"),
        (10, "you are an idiot"),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 0.5) for r in rows], DOC_SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
