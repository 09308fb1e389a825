"""Token counts: Arrow functions that return lengths only.

Each Arrow batch is cut into batches of about equal bytes, long texts are split at white space, and the distinct words
of a batch are encoded in one call. Nothing but a length per document leaves the worker; no shuffle.

Defined results. Null or empty text: 0 bytes, 0 tokens. A text of white space: its bytes, 0 tokens (for vocabularies
that drop white space). Repeated rows: one row each. Null doc_id: kept as null. Empty table: no rows. Other columns
of the input are not read. A word longer than a piece is never cut, so a worker holds the longest word of its texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow
from .vocab import WORDWISE, by_bytes, encode, fold_texts, n_bytes

#: Bytes of a batch that goes to the encoder at once; characters of the longest piece of a text.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 18


def lengths(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text."""
    out: list[int] = []
    for batch in by_bytes(texts, BATCH_BYTES):
        if path.endswith(WORDWISE):
            out += fold_texts(batch, path, "length", PIECE_CHARS)
        else:  # such a vocabulary counts white space too, so texts go whole
            out += map(len, encode(path, batch))
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, for the vocabulary file at path."""

    def kernel(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = lengths(texts, path)
            sizes = list(map(n_bytes, texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
