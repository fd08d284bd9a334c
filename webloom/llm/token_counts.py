"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import word_tokens

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Counts are those of the tokenizers library for the file at ``path`` without special
    tokens, truncation or padding; special strings in a text count as the library takes
    them. A null or empty text has 0 bytes and tokens. Batches are balanced by bytes
    and, if the file's rules allow it, a long text is split at white space, where no token can
    cross, so memory does not follow a text; otherwise whole texts are encoded. Null and repeated ids give a row each; other columns are
    ignored; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens.encoder(path)
        for batch in batches:
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for rows, texts in word_tokens.batches((x.as_py() for x in batch.column("text")), split=encoder.known):
                np.add.at(n_tokens, rows, encoder.counts(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"]
            )

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long"), n_bytes.alias("n_bytes"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
