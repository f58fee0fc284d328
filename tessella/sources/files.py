"""Readers of files other than the tables: CSV folders, JSON lines, judgements, manifests, documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.typing import normalise
from tessella.schemas import Table

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Fields of a question file that are not text.
JSON_METADATA = ("document_id", "id", "category_id", "category", "tags", "related_ids", "version", "last_updated", "source")


def read_csv_table(spark: SparkSession, path: str, declared: Table, typed: bool = False) -> DataFrame:
    """A CSV file or folder with a header, every column as text so that long numbers survive; or typed with its failures aside."""
    raw = spark.read.csv(path, header=True, schema=declared.raw, enforceSchema=False, multiLine=True, escape='"')
    return normalise(raw, declared.kinds) if typed else raw


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line, with a given schema; lines that are none give a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, document_id) of the pairs judged above 0 in a tab-separated file with a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id string, document_id string, score string")
    return rows.filter(F.col("score").try_cast("double") > 0).select("query_id", "document_id").distinct()


def read_manifest(spark: SparkSession, path: str, schema: str | T.StructType, keys: tuple[str, ...] = ("document_id", "path"), lines: bool = False) -> DataFrame:
    """A JSON list of entries, or one entry a line (``lines``); a repeated or missing key raises ValueError."""
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    for key in keys:
        bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(key).first()
        if bad is not None:
            raise ValueError(f"manifest: {key} {bad[0]!r} is missing or repeated")
    return rows


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file, blank ones dropped, a blank line between."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    texts = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in (body.findall(f"{_WORD}p") if body is not None else []))
    return "\n\n".join(t for t in texts if t.strip())


def json_text(data: bytes) -> str:
    """A question file as Question, Answer and Topic lines; any other object as ``key: value`` lines without metadata."""
    text = data.decode("utf-8-sig")
    try:
        value = json.loads(text)
        entries = value if isinstance(value, list) else [value]
    except ValueError:  # one value a line
        entries = [json.loads(line) for line in text.split("\n") if line.strip()]
    out = []
    for entry in entries:
        if not isinstance(entry, dict):
            out.append(str(entry))
        elif "question" in entry and "answer" in entry:
            lines = [f"Question: {entry['question']}", f"Answer: {entry['answer']}"]
            if topic := entry.get("category_name"):
                lines.append(f"Topic: {topic}")
            out.append("\n".join(lines))
        else:
            shown = {k: ", ".join(map(str, v)) if isinstance(v, list) else v for k, v in entry.items() if k not in JSON_METADATA and v not in (None, "")}
            out.append("\n".join(f"{k}: {v}" for k, v in shown.items()))
    return "\n\n".join(out)


def _plain(data: bytes) -> str:
    return data.decode("utf-8-sig")


PARSERS: dict[str, Callable[[bytes], str]] = {"md": _plain, "txt": _plain, "json": json_text, "docx": docx_text}


def read_documents(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, file_type, text, error) of every file below a folder, dispatched on the extension.

    A file of unknown type, or one its parser fails on, keeps a row with the reason and a null
    text; nothing is dropped. ``parsers`` adds types, such as one for page layouts where a library
    is at hand.
    """
    known = PARSERS | (parsers or {})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
                try:
                    if kind not in known:
                        raise ValueError(f"unsupported file type {kind!r}")
                    rows.append((path, kind, known[kind](bytes(content)), None))
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, kind, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["path", "file_type", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInPandas(parse, "path string, file_type string, text string, error string")


def question_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(question_id, question) from JSON files, or lines of such (``lines``), that are a list or hold one under questions, results or queries."""
    item = "struct<question_id:string,id:string,query_id:string,question:string,query:string>"
    text = spark.read.text(path, wholetext=not lines)
    wrapped = F.coalesce(*[F.from_json("value", f"struct<{k}:array<{item}>>")[k] for k in ("questions", "results", "queries")])
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(wrapped)
    rows = text.select(F.explode(listed).alias("_q"))
    return rows.select(F.coalesce("_q.question_id", "_q.query_id", "_q.id").alias("question_id"), F.coalesce("_q.question", "_q.query").alias("question"))
