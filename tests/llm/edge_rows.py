"""Small documents with everything that may go wrong, under columns whose names operators use themselves."""

EXTRA = "score double, length long, bits long, key string, _row long, kept boolean, component_id long, rank int, host string, _kept long"
SCHEMA = f"doc_id long, text string, {EXTRA}"

PROSE = "The cat sat on the mat, and the dog lay by the door. " * 8
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "two words",
    PROSE,
    PROSE,
    PROSE.replace("cat", "CAT"),
    "Ünïcödé ñandú 日本語 🎉 ﬁ. " * 10,
    "  leading and   inner   blanks \n\n\r\n and lines \x0b\x0c ",
    "a" * 5000,
    "word " * 3000,
    "<|endoftext|> and <s>special</s> ▁strings [UNK]",
    "!!! ??? ### *** | | |",
]


def edge_rows(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS)]
    rows += [(3, "one"), (3, "one"), (None, "no identifier"), (None, None), (-7, PROSE)]
    return spark.createDataFrame([(*row, *([None] * 10)) for row in rows], SCHEMA)


def empty_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return [(row["doc_id"], row["text"] or "") for row in rows.collect()]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
