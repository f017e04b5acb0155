"""Readers, writers and checks of the artifacts: sheets, embeddings, employment slices, logs, caches."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from urllib.request import urlopen
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
NULL_TOKENS = ["", "NA", "N/A"]


def fetch(url: str, tries: int = 3, delay: float = 1.0, factor: float = 2.0, timeout: float = 30.0, opener: Callable = urlopen) -> bytes:
    """The body at a URL; failures and empty bodies are tried again with growing pauses, the last error is raised."""
    for attempt in range(tries):
        try:
            with opener(url, timeout=timeout) as answer:
                body = answer.read()
            if not body:
                raise OSError(f"empty body at {url}")
            return body
        except OSError:
            if attempt == tries - 1:
                raise
            time.sleep(delay * factor**attempt)
    raise ValueError("tries must be 1 at least")


def _cells(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterable[dict[str, str]]:
    for row in ElementTree.fromstring(book.read(part)).iter(f"{MAIN}row"):
        out = {}
        for cell in row.iter(f"{MAIN}c"):
            letters = re.match("[A-Z]+", cell.get("r", "A"))[0]
            value = cell.find(f"{MAIN}v")
            if cell.get("t") == "inlineStr":
                out[letters] = "".join(x.text or "" for x in cell.iter(f"{MAIN}t"))
            elif value is not None:
                out[letters] = strings[int(value.text)] if cell.get("t") == "s" else value.text
        yield out


def read_sheet(spark: SparkSession, file, columns: Mapping[str, tuple[str, str]], sheet: int = 1) -> DataFrame:
    """Columns of one sheet of a workbook: header -> (name, type). A sheet fits the driver, as its format demands.

    Missing headers raise; a value that its type can't hold becomes null.
    """
    with zipfile.ZipFile(file) as book:
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in shared.iter(f"{MAIN}si")]
        rows = list(_cells(book, f"xl/worksheets/sheet{sheet}.xml", strings))
    header = {text: letters for letters, text in rows[0].items()} if rows else {}
    missing = sorted(set(columns) - set(header))
    if missing:
        raise ValueError(f"columns {missing} are not in the sheet")
    names = [name for name, _ in columns.values()]
    data = [tuple(r.get(header[h]) for h in columns) for r in rows[1:]]
    raw = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
    return raw.select(*[F.expr(f"try_cast(`{n}` as {t})").alias(n) for n, t in columns.values()])


def all_sheets(named: Mapping[str, DataFrame | None]) -> Mapping[str, DataFrame]:
    """The sheets, if none is missing."""
    missing = sorted(k for k, v in named.items() if v is None)
    if missing:
        raise ValueError(f"sheets {missing} could not be read")
    return named


def vector_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns prefix0, prefix1, … in numeric order; they must be complete."""
    found = sorted((int(c[len(prefix) :]), c) for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit())
    if not found or [i for i, _ in found] != list(range(len(found))):
        raise ValueError(f"columns {prefix}0.. are missing or have gaps")
    return [c for _, c in found]


def to_vectors(df: DataFrame, prefix: str = "hyp_e", name: str = "x") -> DataFrame:
    """Wide embedding columns as one array."""
    columns = vector_columns(df, prefix)
    return df.select(*[c for c in df.columns if c not in columns], F.array(*[F.col(c).cast("double") for c in columns]).alias(name))


def to_wide(df: DataFrame, dims: int, prefix: str = "hyp_e", name: str = "x") -> DataFrame:
    """An array as wide embedding columns."""
    return df.select(*[c for c in df.columns if c != name], *[F.col(name)[i].alias(f"{prefix}{i}") for i in range(dims)])


def read_employment(spark: SparkSession, path: str, year: int, owner: int, length: int) -> DataFrame:
    """The employment slice of a CSV file: one year, one owner, codes of one length."""
    schema = "year string, own_code string, industry_code string, annual_avg_emplvl string, annual_avg_estabs string, tot_wages string"
    return employment_slice(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), year, owner, length)


def employment_slice(rows: DataFrame, year: int, owner: int, length: int) -> DataFrame:
    """Mean employment, establishments and wages per code (with 1e-6 added) and the log of employment."""
    known = lambda c: F.when(F.trim(c).isin(NULL_TOKENS), None).otherwise(F.trim(c))
    number = {c: known(F.col(c).cast("string")).try_cast("double") for c in ("annual_avg_emplvl", "annual_avg_estabs", "tot_wages")}
    whole = {c: known(F.col(c).cast("string")).try_cast("int") for c in ("year", "own_code")}
    typed = rows.withColumns({**whole, **number, "industry_code": F.trim(F.col("industry_code").cast("string"))})
    kept = typed.where((F.col("year") == year) & (F.col("own_code") == owner) & (F.length("industry_code") == length))
    means = kept.groupBy("industry_code").agg(
        *[(F.avg(c) + 1e-6).alias(n) for c, n in (("annual_avg_emplvl", "avg_emp"), ("annual_avg_estabs", "avg_estabs"), ("tot_wages", "avg_wages"))]
    )
    return means.withColumn("log_avg_emp", F.log("avg_emp"))


# What a training log says about an epoch.
LOG_PATTERNS = {
    "cophenetic": r"[Cc]ophenetic[^0-9-]*(-?[0-9.]+)", "spearman": r"[Ss]pearman[^0-9-]*(-?[0-9.]+)", "ndcg_10": r"NDCG@10[^0-9-]*(-?[0-9.]+)",
    "val_loss": r"val[_/]loss[^0-9-]*(-?[0-9.]+)", "norm_cv": r"[Nn]orm CV[^0-9-]*(-?[0-9.]+)", "distance_cv": r"[Dd]istance CV[^0-9-]*(-?[0-9.]+)",
}


def parse_log(lines: DataFrame) -> DataFrame:
    """Metrics per epoch of log lines (run, ord, line): each metric's first mention under the last epoch header before it."""
    epoch = F.regexp_extract("line", r"[Ee]poch\s+(\d+)", 1).try_cast("int")
    seen = lines.withColumn("_e", F.last(epoch, True).over(Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))).where("_e is not null")
    values = {name: F.regexp_extract("line", pattern, 1).try_cast("double") for name, pattern in LOG_PATTERNS.items()}
    marked = seen.select("run", "ord", F.col("_e").alias("epoch"), *[v.alias(n) for n, v in values.items()])
    firsts = [F.min_by(n, F.when(F.col(n).isNotNull(), F.col("ord"))).alias(n) for n in values]
    return marked.groupBy("run", "epoch").agg(*firsts)


def grade(value: Column, weak: float = 0.3, fair: float = 0.5, good: float = 0.7) -> Column:
    return F.when(value >= good, "excellent").when(value >= fair, "good").when(value >= weak, "fair").otherwise("poor")


@dataclass
class Checked:
    """Outcome of a validation: valid as long as nothing is wrong."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors

    def merged(self, other: Checked) -> Checked:
        return Checked(self.errors + other.errors, self.warnings + other.warnings)


def check_schema(df: DataFrame, required: Iterable[str], what: str) -> Checked:
    """Whether a table has the required columns; only its schema is looked at."""
    missing = sorted(set(required) - set(df.columns))
    return Checked([f"{what}: columns {missing} are missing"] if missing else [])


def check_tables(spark: SparkSession, data: str, required: Mapping[str, Iterable[str]]) -> Checked:
    """Whether all tables of a folder can be read and have their columns; every fault is listed, none is raised."""
    out = Checked()
    for name, columns in required.items():
        try:
            df = spark.read.parquet(f"{data}/{name}")
        except AnalysisException as e:
            out = out.merged(Checked([f"{name}: {data}/{name} can't be read ({e.getCondition()})"]))
            continue
        out = out.merged(check_schema(df, columns, name))
        if df.isEmpty():
            out = out.merged(Checked(warnings=[f"{name}: no rows"]))
    return out


def table_stats(df: DataFrame) -> dict:
    """Rows and schema of a table."""
    return {"rows": df.count(), "schema": df.schema.simpleString()}


def config_key(config: Mapping[str, object], fields: Iterable[str]) -> str:
    """First 16 hex digits of the SHA-256 of the named fields."""
    text = json.dumps({k: config.get(k) for k in sorted(fields)}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a key; made and written (by Spark's committer, so never half) where it is not there."""
    path = f"{root}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # Spark has one error class for missing paths of all stores
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_single(rows: DataFrame, path: str) -> None:
    """One Parquet file, for tables that are small by nature."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)
