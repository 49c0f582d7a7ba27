"""Fixtures for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, repeated and unusual texts; repeated and null ids; null and tied columns.
TEXTS = [
    None, "", " ", "one", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "Straße größer als\n\n  x\ty ",
    "\nline\nline\nline\nother line\n", "*** ### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%%", "<|endoftext|> in <|startoftext|> text", "w " * 3000,
    "the end\x1c of\x1f it all", "tail \n", "\r\nwin\r\nlines\r\n", "é é ́x", "1,234.50 isn't we'll  don't",
]


def documents(spark, texts=None, extra=False):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(TEXTS if texts is None else texts)]
    if texts is None:
        rows += [(None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5), (3, "one", "en", "s1", 3), (3, "other text", None, None, 10)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        clash = "size shard slot start length n_tokens n_words kept target taken component_id score _size _key _cell _arc _rank copies epochs".split()
        df = df.withColumns({c: F.lit("x") for c in clash})
    return df
