import pytest

#: Texts that break careless splitting: rare spaces, control strings, contractions, combining marks, digits, nothing at all.
ODD = [
    None, "", " ", "\n\n \t", "a", "it's we've 'Reading\"'s don't'", "x  y \n\nz   q ", "<|endoftext|> and <|startoftext|>x", "été ́ É",
    "a1b22c3.4,5!!!?? --word-- —“q”.", "TAB\tnew\nline\r\nend ", "ÀÉß ÿ× ÷ İi Σς ﬁ \U0001f600\U0001f600x", "a\x1cb \x1f c\x85d\u0085e", "long " * 4000, "word" * 3000, "　wide　 ", "'s 's' '", "9 99 9a a9",
]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, kept, text_sha256): odd texts, a repeated row, a null id, columns whose names clash with results."""
    rows = [(i, t, "k", "h") for i, t in enumerate(ODD)] + [(3, ODD[3], "k", "h"), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, text_sha256 string")
