"""Scans of framework folders, documents, questions, chunk files, results, models and configuration."""

from __future__ import annotations

import configparser
import os
import tomllib
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import schemas


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """(path, name, is a folder) of what lies in a folder of any file system the cluster knows, in name order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(((str(x.getPath().toString()), str(x.getPath().getName()), bool(x.isDirectory())) for x in found), key=lambda x: x[1])


def scan_frameworks(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder under ``root`` that has a metadata.toml, in folder order, with ``folder`` beside the metadata; others are skipped."""
    groups = {
        "framework": ["name", "full_name", "standard", "version", "organization", "type", "scope"],
        "source": ["original_url", "conversion_method", "original_format", "converted_date"],
        "files": ["documents"],
        "metadata": ["description", "domain", "sector"],
    }
    rows = []
    for folder, name, is_folder in _listing(spark, root):
        file = next((f for f, n, d in _listing(spark, folder) if n == "metadata.toml" and not d), None) if is_folder and name != "LICENSE" else None
        if file:
            found = tomllib.loads(spark.read.text(file, wholetext=True).first().value)
            rows.append(tuple(tuple(found.get(g, {}).get(k) for k in keys) for g, keys in groups.items()) + (folder,))
    return spark.createDataFrame(rows, f"{schemas.FRAMEWORK}, folder string")


def read_documents(spark: SparkSession, frameworks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): the text of every declared document that is there, whole; and (framework_name, document, path, error, error_type) of those that are missing or no UTF-8 text.

    The listing is on the driver, as large as the declarations, a folder at a time; the texts are read by the executors.
    """
    declared = [(r.name, d, f"{r.folder}/{d}") for r in frameworks.select("framework.name", "folder", "files.documents").collect() for d in r.documents or []]
    there = {f"{folder}/{name}" for folder in dict.fromkeys(p.rpartition("/")[0] for _, _, p in declared) for _, name, is_folder in _listing(spark, folder) if not is_folder}
    errors = "framework_name string, document string, path string, error string, error_type string"
    missing = spark.createDataFrame([(*x, "no such file", "missing") for x in declared if x[2] not in there], errors)
    known = [x for x in declared if x[2] in there]
    if not known:
        return spark.createDataFrame([], "framework_name string, document string, text string"), missing
    names = spark.createDataFrame(known, "framework_name string, document string, path string")
    files = spark.read.format("binaryFile").load([x[2] for x in known]).select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "content")
    met = files.join(names.withColumn("_path", F.regexp_replace("path", "^file:/+", "/")), "_path")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    broken = met.filter(~good).select("framework_name", "document", "path", F.lit("not UTF-8").alias("error"), F.lit("encoding").alias("error_type"))
    return met.filter(good).select("framework_name", "document", F.col("content").cast("string").alias("text")), missing.unionByName(broken)


def raw_context_parts(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, part): all Markdown files of each folder, each under its name. Sorted by name and joined by blank lines, the parts of a folder are its context, of any size; see ``evaluation.context_blocks``."""
    files = spark.read.text(f"{root}/*/*.md", wholetext=True).select(F.split(F.input_file_name(), "/").alias("p"), "value")
    return files.select(F.element_at("p", -2).alias("folder"), F.element_at("p", -1).alias("name"), F.concat(F.lit("## "), F.element_at("p", -1), F.lit("\n"), F.col("value")).alias("part"))


def read_raw_contexts(spark: SparkSession, root: str, most_chars: int = 256 << 20) -> DataFrame:
    """(folder, context): the parts of each folder as one value. A folder over ``most_chars`` characters is an error; its parts are to be used as they are."""
    parts = raw_context_parts(spark, root)
    sizes = parts.groupBy("folder").agg(F.sum(F.length("part")).alias("n")).filter(F.col("n") > most_chars)
    if not sizes.isEmpty():
        raise ValueError(f"the context of {sizes.first().folder} is too large for one value; use raw_context_parts")
    gathered = F.array_sort(F.collect_list(F.struct("name", "part")))
    return parts.groupBy("folder").agg(F.array_join(F.transform(gathered, lambda x: x.part), "\n\n").alias("context"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line is an error."""
    return spark.read.schema(schemas.QUESTION).option("mode", "FAILFAST").json(path)


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files of the form {metadata, chunks, ...}, one row a chunk. Where several files are of one framework, the last by name counts."""
    files = spark.read.schema(schemas.CHUNK_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    last = files.groupBy(F.col("metadata.framework.name").alias("_name")).agg(F.max("_file").alias("_last"))  # a row a framework
    return files.join(last, F.col("metadata.framework.name").eqNullSafe(F.col("_name")) & (F.col("_file") == F.col("_last")), "left_semi").select(F.inline("chunks"))


class UnreadableFile(ValueError):
    """A file that is missing or is not what its reader expects."""


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file or folder with a given schema, read to its end once; whatever goes wrong is an ``UnreadableFile`` that names it."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        df.write.format("noop").mode("overwrite").save()
        return df
    except Exception as error:
        raise UnreadableFile(f"{path}: {str(error).splitlines()[0]}") from error


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results as JSON, of any layout by partition folders."""
    return spark.read.schema(schemas.RESULT).json(path)


def read_models(spark: SparkSession, path: str, now: str | None = None, hours: float | None = None) -> DataFrame:
    """Cached models; with ``now`` and ``hours`` only those cached less than that long before."""
    rows = spark.read.schema(f"{schemas.MODEL}, cached_at timestamp").json(path)
    if now is not None and hours is not None:
        rows = rows.filter(F.col("cached_at") > F.lit(now).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {hours * 3600})"))
    return rows.drop("cached_at")


def environment(name: str, fallback=None, kind: type = str):
    """A variable of the driver's environment as ``kind``; the fallback where it is unset or no such value. 1, true, yes and on are true."""
    value = os.environ.get(name)
    if value is None:
        return fallback
    if kind is bool:
        return value.strip().lower() in ("1", "true", "yes", "on")
    try:
        return kind(value)
    except ValueError:
        return fallback


@cache
def shared_config(path: str) -> Config:
    """The same ``Config`` for everyone who asks for a file."""
    return Config(path)


class Config:
    """An INI file with typed getters; a missing value without fallback is a KeyError."""

    def __init__(self, path: str | None = None, text: str | None = None):
        self._parser = configparser.ConfigParser(interpolation=None)
        if path:
            with open(path, encoding="utf-8") as file:
                self._parser.read_file(file)
        if text:
            self._parser.read_string(text)

    def get(self, section: str, key: str, fallback=None, kind: type = str):
        if not self._parser.has_option(section, key):
            if fallback is None:
                raise KeyError(f"[{section}] {key}")
            return fallback
        value = self._parser.get(section, key)
        if kind is bool:
            return self._parser.getboolean(section, key)
        if kind is list:
            return [v.strip() for v in value.split(",") if v.strip()]
        return kind(value)

    def missing(self, required: dict[str, list[str]]) -> list[str]:
        """``section.key`` of each required value that is absent or blank, for a check before anything runs."""
        return [f"{section}.{key}" for section, keys in required.items() for key in keys if not str(self.get(section, key, fallback="")).strip()]
