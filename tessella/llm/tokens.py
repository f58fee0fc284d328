"""Encoding and decoding with the byte-level BPE of a public tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import spread

#: Where the vocabulary files lie unless told otherwise.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: Texts per call of the tokenizers library: bounds the memory of its encodings.
_SLICE = 256


@cache
def _tokenizer(path: str):  # noqa: ANN202 - one per Python worker
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@cache
def _bytes_of_characters() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from U+0100."""
    itself = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id."""
    table, vocabulary = _bytes_of_characters(), _tokenizer(path).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Token ids; an empty list for null and empty texts."""
    tokenizer, out = _tokenizer(path), []
    for i in range(0, len(texts), _SLICE):
        out += [e.ids for e in tokenizer.encode_batch_fast([t or "" for t in texts[i : i + _SLICE]], add_special_tokens=False)]
    return out


def decode_pieces(pieces: list[list[int]], path: str) -> list[str]:
    """Texts of consecutive pieces of ids. A character split between pieces goes to the piece where it ends.

    Bytes that form no character become U+FFFD, as when decoding all at once.
    """
    import codecs

    table, decoder = token_bytes(path), codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(b"".join(table[t] for t in ids), final=i == len(pieces) - 1) for i, ids in enumerate(pieces)]


def character_offsets(text: str, ids: list[int], path: str) -> tuple[list[int], list[int]]:
    """(starts, ends) in code points: the characters each token has bytes of; a split character belongs to each of its tokens."""
    table = token_bytes(path)
    stops = np.cumsum([len(table[t]) for t in ids], dtype=np.int64)
    starts = np.r_[0, stops[:-1]] if len(stops) else stops
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    leads = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return (leads[starts] - 1).tolist(), leads[stops - 1].tolist()


def _lists(values: list[list[int]]) -> pa.ListArray:
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    flat = np.fromiter((i for v in values for i in v), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))


def _vocabulary(path: str | None) -> str:
    return path or os.path.join(VOCABULARIES, BYTE_BPE)


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids) of every (id, text): token ids without special tokens, an empty list for null and empty texts.

    The tokenizer is loaded once per Python worker; rows keep their partition unless there are
    fewer partitions than cores. Rows with a null id are kept. Other columns do not matter.
    """
    path = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                part = batch.slice(i, _SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(encode_texts(part.column(1).to_pylist(), path))], ["id", "ids"])

    rows = spread(documents.select("id", "text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def encode_with_offsets(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids, starts, ends): as ``encode``, with the code points each token covers."""
    path = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                part = batch.slice(i, _SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encode_texts(texts, path)
                at = [character_offsets(t, v, path) for t, v in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), _lists([a for a, _ in at]), _lists([b for _, b in at])], ["id", "ids", "starts", "ends"])

    rows = spread(documents.select("id", "text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of (id, ids): the byte table reversed. A null list gives a null text, an empty list an empty one."""
    path = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_pieces([ids], path)[0] for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select("id", "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def decode_in_pieces(encoded: DataFrame, length: int, path: str | None = None) -> DataFrame:
    """(id, pieces) of (id, ids): the texts of consecutive pieces of ``length`` ids, which may cut characters.

    A cut character goes to the piece where it ends. A null list gives null, an empty one no piece.
    """
    path = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [None if ids is None else decode_pieces([ids[i : i + length] for i in range(0, len(ids), length)], path) for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.string()))], ["id", "pieces"])

    rows = encoded.select("id", "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pieces array<string>")


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(id, tokens): the number of tokens of each text, 0 of null and empty ones."""
    return encode(documents, path).select("id", F.size("ids").alias("tokens"))
