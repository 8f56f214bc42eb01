"""Feature stores, labels, checkpoints and result files."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature store, vectors, anchors or labels as Parquet."""
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(records: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last record per key in write order; a running maximum, not a collected group."""
    columns = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in columns))


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    return latest(spark.read.schema(schema).json(path), key, [F.col(order)])


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def write_ranking(ranked: DataFrame, path: str, key: str = "candidate_id") -> None:
    """CSV with header: id, rank, score (six decimals), reasoning; one small file in rank order."""
    out = ranked.select(key, "rank", F.col("final").cast("decimal(20,6)").cast("string").alias("score"), "reasoning")
    out.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("candidate_id string, rank int, score double, reasoning string").csv(path)


def write_workbook(rows: list[dict], path: str) -> bool:
    """XLSX of a ranking (at most some hundred rows); False where openpyxl is not installed."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import Alignment, Font
    except ImportError:
        return False
    book = Workbook()
    sheet = book.active
    names = list(rows[0]) if rows else ["candidate_id", "rank", "score", "reasoning"]
    sheet.append(names)
    for row in rows:
        sheet.append([row[n] for n in names])
    for letter, width in zip("ABCD", (16, 6, 11, 110), strict=True):
        sheet.column_dimensions[letter].width = width
    for cell in sheet[1]:
        cell.font = Font(bold=True)
    for line in sheet.iter_rows(min_row=2):
        line[-1].alignment = Alignment(wrap_text=True)
    sheet.freeze_panes = "A2"
    book.save(path)
    return True


_REFERENCE = re.compile(r"\$\{([^}]+)\}")


def filled(values: dict) -> dict:
    """A mapping with ${name} in its texts replaced by its other values, until nothing changes; unknown names stay."""
    out = dict(values)
    while True:
        new = {k: _REFERENCE.sub(lambda m: str(out.get(m[1], m[0])) if out.get(m[1]) != v else m[0], v) if isinstance(v, str) else v for k, v in out.items()}
        if new == out:
            return out
        out = new


def read_config(spark: SparkSession, path: str) -> dict:
    """A small YAML mapping (two levels, lists, scalars) from any file system that Spark reads; `paths` is filled() and anchored.

    Relative paths are anchored at the folder of the file; absolute ones and those with a
    scheme stay. Where the yaml package is installed it reads the text.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        config = yaml.safe_load(text) or {}
    except ImportError:
        config = parse_yaml(text)
    if isinstance(config.get("paths"), dict):
        folder = path.rsplit("/", 1)[0] if "/" in path else "."
        config["paths"] = {k: anchored(v, folder) if isinstance(v, str) else v for k, v in filled(config["paths"]).items()}
    return config


def anchored(path: str, folder: str) -> str:
    """`path` if it is absolute, else below `folder`, without . and .. steps."""
    if path.startswith("/") or "://" in path:
        return path
    scheme, slashes, rest = folder.rpartition("://")
    return scheme + slashes + posixpath.normpath(posixpath.join(rest, path))


def parse_yaml(text: str) -> dict:
    """Mappings of scalars, of lists of scalars and of such mappings; indentation tells levels, # begins a comment."""
    lines = []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, indent: int):
        if lines[at][1].startswith("- "):
            out: list | dict = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                out.append(_scalar(lines[at][1][2:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, value = lines[at][1].partition(":")
            at += 1
            if value.strip():
                out[_scalar(key)] = _scalar(value)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                out[_scalar(key)], at = block(at, lines[at][0])
            else:
                out[_scalar(key)] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def rank_order() -> list[Column]:
    return [F.isnan("final").asc(), F.col("final").desc_nulls_last(), F.col("candidate_id").asc()]


def row_numbers(df: DataFrame, *order: Column) -> DataFrame:
    """rank 1..n; only for frames that a limit has made small."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
