"""Overlapping word windows, as column expressions: no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import word_list


def word_chunks(documents: DataFrame, key: str, text: str, size: int = 250, overlap: int = 40) -> DataFrame:
    """(key, chunk_id, chunk_index, n_words, chunk_text).

    A text of up to ``size`` words is one chunk, unchanged but trimmed; longer ones become windows
    of ``size`` words, each starting ``size - overlap`` after the one before, words joined by one
    space, the last ending with the text. Null and blank texts give no chunk. Ids are
    ``<key>_chunk_000`` and so on.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    n = F.size("_words")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), ((F.ceil((n - overlap) / step) - 1) * step).cast("int"), F.lit(step)))
    rows = documents.select(F.col(key), F.col(text).alias("_text"), word_list(F.col(text)).alias("_words")).filter("size(_words) > 0")
    cut = rows.select(key, "_text", "_words", F.posexplode(starts).alias("chunk_index", "_start"))
    whole = F.size("_words") <= size
    window = F.slice("_words", F.col("_start") + 1, size)
    return cut.select(
        key, F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.when(F.col("chunk_index") < 1000, F.lpad(F.col("chunk_index").cast("string"), 3, "0")).otherwise(F.col("chunk_index").cast("string"))).alias("chunk_id"), "chunk_index",
        F.when(whole, F.size("_words")).otherwise(F.size(window)).alias("n_words"), F.when(whole, F.trim("_text", F.lit(" \t\r\n\f"))).otherwise(F.array_join(window, " ")).alias("chunk_text"),
    )
