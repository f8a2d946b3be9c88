"""Small inputs shared by the tests."""

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null text, empty text, blanks only, repeated rows, a null id, odd letters.
ODD_TEXTS = [
    None, "", " \n\t ", "word", "Same text twice, with a few words in it.", "Same text twice, with a few words in it.",
    "İstanbul ΣΑΣ é Ａ１ ẞ \x1c\x1d x\u0085y z   　end", "<|endoftext|>a <|startoftext|> b<|endoftext|>",
    "a@b.c@d.e x-1.2.3.4.5.6.7.8 +1 (2) 345-678-90) 4111 1111-1111 1111 " * 3, "don't we'll 'tis I'VE 12345 %%%...",
    "long " * 3000, "x" * 5000, "7" * 5000, "1." * 3000, "😀👍🏽 naïve — “quoted” ñandú\r\nÅngström ﬁ ǅ",
]


def odd_docs(spark, extra_null_id=True):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    if extra_null_id:
        rows.append((None, "a row without an id", None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
