import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes documents as Parquet and reads them: (doc_id, text[, lang[, source]]) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Nulls in every column, empty and white texts, repeated rows, ties, and one very long text.
ODD = [
    (1, "Alpha beta gamma", "en", "s"), (2, "alpha BETA gamma", None, "s"), (3, None, "en", None), (4, "", "en", "s"), (None, "alpha beta gamma", "en", "s"), (5, " \n\t ", "de", "t"),
    (6, "x " * 60000, "en", "t"), (7, "Alpha beta gamma", "en", "s"), (7, "Alpha beta gamma", "en", "s"), (None, None, None, None), (8, "é́ ß <|endoftext|> 漢字 😀", "fr", "t"),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def clash(odd):
    """The odd rows with columns that have our own names."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(1) for c in ("kept", "score", "size", "fp", "row", "recipe", "length", "rank", "shard", "slot", "block", "data", "group", "n", "digest", "piece", "band", "_at", "_ahead", "_o0", "_n", "_sub", "_mx_size", "_mx_at", "at_file", "at_place", "ahead", "place", "key0", "lang_", "bits", "_metadata", "node", "print", "KEPT_")})


@pytest.fixture(scope="session")
def none(table, spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
