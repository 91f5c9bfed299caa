"""Sources: tables, full texts and captured service answers as DataFrames."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("paper_id", "title", "abstract", "keyword", "authors", "doi", "year", "venue", "url", "fulltext_flag", "primary_reason", "val_reason")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = PAPER_SCHEMA) -> DataFrame:
    """A CSV table with a header, quoted line breaks and doubled quotes, missing as ''.

    With a schema nothing is inferred and columns are pruned in the scan; without one every
    column is text.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("mode", "PERMISSIVE")
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    return df.na.fill("")


def read_result_tree(spark: SparkSession, root: str, name: str = "clustered_papers.csv") -> DataFrame:
    """All result tables of that file name below ``root``, with their path as ``source``."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
    return df.na.fill("").withColumn("source", F.input_file_name())


def listed_ids(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(``paper_id``): the names of the files in a folder without their suffix; contents unread."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    return df.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), re.escape(suffix) + "$", "").alias("paper_id")).distinct()


def html_text(raw: bytes) -> str:
    """Readable text of an HTML or plain-text file; blocks become paragraphs."""
    t = raw.decode("utf-8", "replace")
    t = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", t)
    t = re.sub(r"(?i)</(p|div|h\d|li|tr|section|article)>|<br\s*/?>", "\n\n", t)
    return html.unescape(re.sub(r"(?s)<[^>]+>", " ", t)).strip()


def read_texts(spark: SparkSession, folder: str, extract: Callable[[bytes], str] = html_text, method: str = "text", glob: str = "*") -> DataFrame:
    """(``paper_id, path, text, method``): the text of every file; a file that cannot be read
    has no text and the method ``failed``. ``extract`` is any function of bytes, so a PDF
    library can be passed where one is installed."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows.append((name, path, extract(bytes(raw)), method))
                except Exception:  # noqa: BLE001 - any failure of a foreign extractor is a failed file
                    rows.append((name, path, None, "failed"))
            yield pd.DataFrame(rows, columns=["paper_id", "path", "text", "method"])

    return df.mapInPandas(run, "paper_id string, path string, text string, method string")


def is_pdf(content: Column) -> Column:
    """Does the content begin like a PDF file?"""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def embedded_json(page: Column, element: str, schema: str) -> Column:
    """The JSON in a page's script element of that id, parsed; null where there is none."""
    raw = F.regexp_extract(page, rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(F.trim(raw), F.lit("")), schema)


def service_candidates(answers: DataFrame, source: str, key: str, body: str) -> DataFrame:
    """(key, ``source, link``): open-access links in captured JSON answers of a service.

    Every text value that is a web address is a candidate, in document order; broken or empty
    answers give none. A live service can feed the same frame through the data source API.
    """
    links = F.regexp_extract_all(F.col(body), F.lit(r'"(https?://[^"\s]+)"'), 1)
    ok = F.get_json_object(body, "$").isNotNull()
    return answers.where(ok).select(key, F.lit(source).alias("source"), F.posexplode(F.array_distinct(F.transform(links, lambda u: F.replace(u, F.lit("\\/"), F.lit("/"))))).alias("place", "link"))


def embed(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, ``vector``): vectors from a pluggable client, one call per batch of rows; texts in
    several rows of one key (chunks) are to be pooled by ``mean_by_group``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vector": client(pdf[text].fillna("").tolist())})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, vector array<double>")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; made and written first if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
