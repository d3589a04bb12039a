"""Raw documents, manifests, sentence files and database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import html_text, sentences
from docloom.functions.urls import content_hash, normalize_url, url_hash

MIME = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain"}


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML and PDF files as path, modificationTime, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def mime(path: Column) -> Column:
    """MIME type by file name."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, end), F.lit("application/octet-stream"))


def storage_name(content: Column, mime_type: Column) -> Column:
    """Folder and content-hash name of a stored file."""
    kind = F.when(mime_type == "application/pdf", "pdf").otherwise("html")
    return F.concat(F.lit("external/"), kind, F.lit("/"), content_hash(content), F.lit("."), kind)


def raw_documents(files: DataFrame) -> DataFrame:
    """Manifest rows of raw files, with the title of HTML pages; the content stays for later stages."""
    text = F.decode("content", "UTF-8")
    title = F.when(mime(F.col("path")) == "text/html", F.nullif(F.regexp_extract(text, "(?is)<title[^>]*>([^<]*)</title>", 1), F.lit("")))
    return files.select(
        F.col("path").alias("url"), normalize_url("path").alias("canonical_url"), url_hash("path").alias("url_hash"), F.col("modificationTime").alias("fetched_at"), F.lit(200).alias("status"),
        mime(F.col("path")).alias("mime"), content_hash("content").alias("content_hash"), F.col("length").alias("size"), title.alias("title"), "content",
    )


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Fetched pages (url, html) in the form of the manifest."""
    title = F.nullif(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)</title>", 1), F.lit(""))
    return pages.select(
        "url", normalize_url("url").alias("canonical_url"), url_hash("url").alias("url_hash"), F.lit(200).alias("status"), F.lit("text/html").alias("mime"),
        content_hash("html").alias("content_hash"), F.octet_length("html").cast("bigint").alias("size"), title.alias("title"), html_text("html").alias("text"),
    )


def write_manifest(documents: DataFrame, path: str) -> None:
    """The manifest as one CSV file with a header, without contents."""
    documents.drop("content", "text").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_sentences(docs: DataFrame, path: str) -> None:
    """Sentences as JSON lines."""
    sentences(docs).write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, url: str, name: str, **properties: str) -> None:
    """A table in a database; its driver has to be on the class path."""
    df.write.jdbc(url, name, mode="append", properties=properties)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A database table, read in ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def pdf_text(files: DataFrame, extract) -> DataFrame:
    """Text and page count of PDF files by ``extract(bytes) -> (text, pages, warning)``, a library of the user's choice."""
    schema = "path string, text string, pages int, warning string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [dict(zip(("path", "text", "pages", "warning"), (p, *extract(c)))) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("text", pa.string()), ("pages", pa.int32()), ("warning", pa.string())]))

    return files.select("path", "content").mapInArrow(run, schema)
