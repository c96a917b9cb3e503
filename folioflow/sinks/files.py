"""Sinks that write one file per row into a folder that all executors share, and return what they wrote."""

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRITTEN = "doc_id string, path string, bytes bigint, error string"


def _safe(name: str) -> str:
    return re.sub(r"[^\w.-]+", "_", name) or "_"


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """rows: doc_id, name, content (binary). A file appears under its name only when it is whole, so a task that runs twice
    leaves the same files. A file that can't be written is a row with `error`."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for doc, name, content in zip(pdf["doc_id"], pdf["name"], pdf["content"]):
                path = os.path.join(folder, _safe(name))
                try:
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(bytes(content))
                    os.replace(part, path)
                    out.append((doc, path, len(content), None))
                except OSError as e:
                    out.append((doc, path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "bytes", "error"])

    return rows.where("content is not null").select("doc_id", "name", "content").mapInPandas(write, WRITTEN)


def pretty(text: Column) -> Column:
    """JSON text with two blanks per level and letters as they are."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    return F.pandas_udf(batch, "string")(text)


def write_json(rows: DataFrame, folder: str) -> DataFrame:
    """{doc_id}.json of rows (doc_id, json)."""
    return _written(rows.select("doc_id", F.concat("doc_id", F.lit(".json")).alias("name"), F.encode(pretty(F.col("json")), "utf-8").alias("content")), folder)


def write_markdown(rows: DataFrame, folder: str) -> DataFrame:
    """{doc_id}.md of rows (doc_id, markdown)."""
    return _written(rows.select("doc_id", F.concat("doc_id", F.lit(".md")).alias("name"), F.encode("markdown", "utf-8").alias("content")), folder)


def asset_name(page: Column, idx: Column, kind: Column) -> Column:
    return F.concat(F.lit("img_page"), page, F.lit("_"), idx, F.lit("."), kind)


def write_assets(images: DataFrame, folder: str) -> DataFrame:
    """{doc_id}_img_page{page}_{idx}.{format} of images (doc_id, page, idx, format, image)."""
    name = F.concat(F.regexp_replace("doc_id", r"[^\w.-]+", "_"), F.lit("_"), asset_name(F.col("page"), F.col("idx"), F.col("format")))
    return _written(images.select("doc_id", name.alias("name"), F.col("image").alias("content")), folder)


def summary(converted: dict[str, DataFrame]) -> str:
    """What a conversion gave, as a line of text for a script's output: files, pages, sections, tables and chunks."""
    counts = {"documents": converted["metadata"].count(), "pages": converted["metadata"].agg(F.coalesce(F.sum("page_count"), F.lit(0))).first()[0], **{k: converted[k].count() for k in ("sections", "tables", "chunks")}}
    return ", ".join(f"{v} {k}" for k, v in counts.items())
