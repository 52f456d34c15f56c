"""Readers and writers of the engine's files. Readers name their schema; broken records land in ``_corrupt_record``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from folioflow import schema

#: Version of the summary index; an index of another version is rebuilt.
SUMMARY_VERSION = "v1"


def _json(spark: SparkSession, path: str, of: T.StructType) -> DataFrame:
    with_corrupt = T.StructType([*of.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        return spark.read.schema(with_corrupt).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except AnalysisException:  # a missing path is an empty table
        return spark.createDataFrame([], with_corrupt)


def read_chunks(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Chunk files (one JSON array per source); the source filter also finds chunks kept in another source's file."""
    df = _json(spark, path, schema.CHUNK)
    return df.where(F.col("source") == source) if source else df


def read_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """All triple files of the given paths; a missing one adds nothing."""
    df = _json(spark, paths[0], schema.TRIPLE)
    for p in paths[1:]:
        df = df.unionByName(_json(spark, p, schema.TRIPLE))
    return df


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, reflection cases) of a gold dataset."""
    df = _json(spark, path, schema.DATASET)
    return df.select(F.explode("qa").alias("x")).select("x.*"), df.select(F.explode("reflection_cases").alias("x")).select("x.*")


def gold_of(questions: DataFrame, pdf: str) -> DataFrame:
    """Questions on one document."""
    return questions.where(F.col("pdf") == pdf)


def default_source(df: DataFrame, fallback: str | None = None) -> Column:
    """The alphabetically first source of a table as a value, else ``fallback``."""
    return F.coalesce(F.lit(df.agg(F.min("source")).first()[0]), F.lit(fallback))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schema.ANSWER)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf", names: list[str] | None = None) -> DataFrame:
    """(source, content) of the files of a directory, or of those of ``names`` that are there; what cannot be read has null content,
    and the rest goes on."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).option("ignoreCorruptFiles", True).load(path)
    found = df.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content", "length")
    return found if names is None else found.where(F.col("source").isin(list(names)))


def ingest_report(documents: DataFrame, chunks: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(source, status, chunks) of each file: 'ok', 'empty' where it gave no chunk, 'missing' where a named file is not there."""
    found = documents.select("source").distinct().withColumn("there", F.lit(True))
    if names is not None:
        found = documents.sparkSession.createDataFrame([(n,) for n in names], "source string").join(found, "source", "left")
    n = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    status = F.when(F.col("there").isNull(), "missing").when(F.coalesce("chunks", F.lit(0)) == 0, "empty").otherwise("ok")
    return found.join(n, "source", "left").select("source", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def data_url(path: Column, content: Column) -> Column:
    """A picture as a data URL; the MIME type follows the suffix, PNG where it is unknown."""
    low = F.lower(path)
    mime = F.when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.rlike(r"\.gif$"), "image/gif").when(low.rlike(r"\.webp$"), "image/webp").when(low.rlike(r"\.bmp$"), "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def sources(df: DataFrame) -> DataFrame:
    """Names of the sources in a table, sorted."""
    return df.select("source").where("source is not null").distinct().orderBy("source")


def chunk_id(source: str = "source", page: str = "page", index: str = "chunk_index") -> Column:
    """``source::p<page>::c<index>`` with defaults for what is missing."""
    return F.concat(F.coalesce(F.col(source), F.lit("unknown")), F.lit("::p"), F.coalesce(F.col(page), F.lit(0)).cast("string"), F.lit("::c"), F.coalesce(F.col(index), F.lit(0)).cast("string"))


def metadata(chunks: DataFrame) -> DataFrame:
    """The projection kept beside a vector: id, source, page, section and type, with defaults."""
    return chunks.select(chunk_id().alias("id"), F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("content_type", F.lit("text")).alias("chunk_type"), F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)).alias("chunk_index"), "text")


def new_rows(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """What an idempotent upsert adds: rows with a text whose key is not there yet, once per key (the first)."""
    rest = [c for c in incoming.columns if c not in key]
    fresh = incoming.where(F.trim("text") != "").join(existing.select(*key).distinct(), key, "left_anti")
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], order: str) -> int:
    """Appends ``new_rows`` to the Parquet table at ``path`` and returns how many came in, counted while they are written."""
    from pyspark.sql import Observation

    try:
        existing = spark.read.parquet(path)
    except AnalysisException:
        existing = incoming.limit(0)
    seen = Observation("added")
    new_rows(existing, incoming, key, order).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_by_source(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a source. Rows are clustered by source and a salt, so that a hot source is written by many tasks."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    salted.repartition("source", "__salt").drop("__salt").write.mode(mode).partitionBy("source").parquet(path)


def write_triples(df: DataFrame, path: str, mode: str = "append") -> None:
    """Triples as JSON lines, the form :func:`read_triples` reads."""
    df.select(*(c for c in schema.TRIPLE.fieldNames() if c in df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def reset(spark: SparkSession, path: str, of: T.StructType) -> None:
    """An empty table in place of what is kept at ``path``."""
    spark.createDataFrame([], of).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of a drawn subgraph as JSON, for any viewer."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_index(df: DataFrame, path: str) -> None:
    df.withColumn("_version", F.lit(SUMMARY_VERSION)).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """A kept index, or None where it is missing or of another version."""
    try:
        df = spark.read.parquet(path).where(F.col("_version") == SUMMARY_VERSION)
    except AnalysisException:
        return None
    return None if df.isEmpty() else df.drop("_version")
