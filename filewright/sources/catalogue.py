"""File catalogues: from folders of files, and derived from a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.operators.rules import REFUSED_FOLDERS, refuses_file

# Endings of unfinished downloads and the limits of a walk.
PARTIAL_ENDINGS = (".crdownload", ".part", ".partial", ".download", ".opdownload", ".filepart")
MAX_DEPTH, MAX_FILES, RECENT_MINUTES, HASH_BYTES = 3, 5000, 10, 512 << 20
NAMES = ("lecture {}.pdf", "Screenshot {}.png", "notes ({}).txt", "setup-{}.exe", "photos {}.zip", "draft {}.tmp", "film {}.crdownload", "report {} - copy.docx", "book {}.pages", "key {}.pem", ".hidden-{}", "clip {}.mp4")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./]+)$", 1))


def walk(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, name, ext, bytes, mtime, content)`` of the files below a folder, in Spark's listing.

    Spark's file sources pass over empty files, so those have to come from another listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(root).select("path", name.alias("name"), extension(name).alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")


def admitted(files: DataFrame, root: str, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES) -> DataFrame:
    """Files no deeper than ``max_depth``, outside hidden and refused folders; the first by path."""
    inner = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    parts = F.split(F.substr(inner, F.lit(len(root.rstrip("/")) + 2)), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    shut = F.exists(parts, lambda x: x.startswith(".")) | F.exists(folders, lambda x: F.lower(x).isin(*REFUSED_FOLDERS))
    shut = shut | refuses_file(F.lower(F.element_at(parts, -1)))
    return files.where((F.size(folders) <= max_depth) & ~shut).orderBy("path").limit(max_files)


def inspected(files: DataFrame, now: Column) -> DataFrame:
    """Adds recent, partial and sha256; the hash is null for empty, partial and oversized files."""
    partial = F.col("ext").isin(*PARTIAL_ENDINGS)
    recent = F.col("mtime") > now - F.expr(f"interval {RECENT_MINUTES} minutes")
    sha = F.when((F.col("bytes") > 0) & ~partial & (F.col("bytes") <= HASH_BYTES), F.sha2("content", 256))
    return files.withColumn("recent", recent).withColumn("partial", partial).withColumn("sha256", sha)


def from_documents(docs: DataFrame, now: str) -> DataFrame:
    """A catalogue whose files are documents; names, folders and times follow from the ids."""
    n, kinds = F.col("doc_id"), F.array(*map(F.lit, NAMES))
    name = F.replace(F.element_at(kinds, (n % len(NAMES) + 1).cast("int")), F.lit("{}"), n.cast("string"))
    mtime = F.timestamp_add("HOUR", -(n * 7919 % 3000).cast("int"), F.lit(now).cast("timestamp_ntz"))
    size = F.when(n % 17 == 0, 0).otherwise(F.octet_length("text")).cast("long")
    path = F.concat(F.lit("/home/u/Downloads/"), F.col("source"), F.lit("/"), F.when(n % 3 == 0, "old/x/").otherwise(""), name)
    return docs.select(n.alias("id"), path.alias("path"), name.alias("name"), extension(name).alias("ext"), size.alias("bytes"), mtime.alias("mtime"), F.timestamp_add("HOUR", (n % 48).cast("int"), mtime).alias("first_seen_at"), F.when(size > 0, F.sha2("text", 256)).alias("sha256"), "text", "source")
