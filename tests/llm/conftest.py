import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 30000
ODD_TEXTS = [
    None, "", " \t\n\r\x0b\x0c", "a", "a b c", "\n\n\n", "x\nx\nx", "Ünïcode ünïcode Ünïcode ünïcode", " em space nbsp", "𝔘𝔫𝔦 💥 𝔘𝔫𝔦 💥 𝔘𝔫𝔦 💥",
    "one two three one two three", "line\n line\nline\n", "ends with newline\n", "\x00 nul \x00 nul", "tab\ttab\ttab\ttab", "same same", "same same", "y" * 70000, LONG, "a\r\nb\r\na\r\n", "don't we'll <|endoftext|> x", "1.2.3.4 a@b.co 4111 1111 1111 1111 +1 (017) 555-7713",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null, empty, odd, repeated and very long texts, repeated and null identifiers, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else "src", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null key here", "en", "src", 3), (5, rows[5][1], "en", "src", 2), (5, rows[5][1], "en", "src", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS id", "'x' AS token", "2.5 AS score", "array(1) AS items")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def cases(odd, small):
    """The odd rows and the documents of the smallest tables."""
    return odd.select("doc_id", "text", "lang", "source", "n_chars").union(small.selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars"))
