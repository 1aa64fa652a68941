"""Result and test-set documents: nested JSON in, flat rows out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.schemas import CORRUPT, RESULT_DOCUMENT, TESTSET_DOCUMENT
from tallymill.session import remove, scratch_path, shuffles_dropped

RESULT_GLOB = "results_*.json.gz"


def _documents(spark: SparkSession, paths: str | Sequence[str], schema: str, glob: str, one_per_file: bool):
    reader = (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", one_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
    )
    return reader.json(paths if isinstance(paths, str) else list(paths))


def read_results(
    spark: SparkSession, paths: str | Sequence[str], glob: str = RESULT_GLOB, one_per_file: bool = True
) -> DataFrame:
    """One row per result document, found recursively, with its file.

    A gzip file is one task, so parallelism is over files.  ``one_per_file`` is
    the layout of single (possibly indented) documents; turn it off for files
    with a document per line.  What cannot be read is in ``bad_documents``.
    """
    return _readable(_documents(spark, paths, RESULT_DOCUMENT, glob, one_per_file), "model_info.model_name")


def _readable(raw: DataFrame, field: str) -> DataFrame:
    # the second test is always true; it keeps a data column in the scan, which a scan of the corrupt column needs
    kept = F.col(CORRUPT).isNull() & (F.coalesce(field, F.lit("")) != "\u0000")
    return raw.filter(kept).drop(CORRUPT).select("*", F.col("_metadata.file_path").alias("file_path"))


def damaged_files(spark: SparkSession, paths: str | Sequence[str], glob: str = RESULT_GLOB) -> DataFrame:
    """Gzip files (file_path, cause) that end early or are no gzip: their readable part is read, the rest is lost.

    A task unpacks one file at a time in small pieces and keeps nothing of it.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(paths if isinstance(paths, str) else list(paths))
        .filter(F.col("path").endswith(".gz"))
        .select("path", "content")
    )

    def cause(raw: bytes) -> str | None:
        left = memoryview(raw)
        while left:
            unpack = zlib.decompressobj(wbits=31)
            try:
                unpack.decompress(left, 1 << 20)
                while not unpack.eof and unpack.unconsumed_tail:
                    unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            except zlib.error:
                return "no gzip"
            if not unpack.eof:
                return "truncated gzip"
            left = unpack.unused_data.lstrip(b"\0")  # a file may hold several members
        return None

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                if found := cause(content.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([found])], ["file_path", "cause"])

    return files.mapInArrow(checked, "file_path string, cause string")


def bad_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    glob: str = RESULT_GLOB,
    one_per_file: bool = True,
    schema: str = RESULT_DOCUMENT,
    field: str = "model_info.model_name",
) -> DataFrame:
    """What ``read_results`` or ``read_testsets`` leaves out: file_path, document (its text) and cause.

    Causes are ``broken document`` (one row each), ``truncated gzip`` and ``no gzip`` (a row per file, whose
    readable documents are read all the same) and ``no document`` (files with neither a readable nor a broken
    one).  Every document is in one of the two tables or lies in the lost part of a reported file.
    """
    raw = _documents(spark, paths, schema, glob, one_per_file)
    marked = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col(CORRUPT).alias("document"), F.coalesce(field, F.lit("")).alias("_field"))
    broken = marked.filter(F.col("document").isNotNull() & (F.col("_field") != "\u0000"))
    broken = broken.select("file_path", "document", F.lit("broken document").alias("cause"))
    damaged = damaged_files(spark, paths, glob).select("file_path", F.lit(None).cast("string").alias("document"), "cause")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    listed = files.load(paths if isinstance(paths, str) else list(paths)).select(F.col("path").alias("file_path"))
    plain = F.regexp_replace("file_path", "^file:/+", "/").alias("_p")
    seen = marked.select(plain).union(damaged.select(plain)).distinct()
    silent = listed.withColumn("_p", plain).join(seen, "_p", "left_anti").select("file_path", F.lit(None).cast("string").alias("document"), F.lit("no document").alias("cause"))
    return broken.unionByName(damaged).unionByName(silent)


def split_readable(
    spark: SparkSession, paths: str | Sequence[str], glob: str = RESULT_GLOB, one_per_file: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Readable documents, and what could not be read with its cause; the job goes on."""
    return read_results(spark, paths, glob, one_per_file), bad_documents(spark, paths, glob, one_per_file)


def run_headers(documents: DataFrame) -> DataFrame:
    """One row per document with what its header declares; runs without results are here too."""
    s = "summary_statistics"
    return documents.select(
        F.col("metadata.result_id").alias("run_id"),
        F.coalesce("model_info.model_name", F.lit("unknown")).alias("model_name"),
        "model_info.provider",
        "model_info.quantization",
        F.coalesce("testset_metadata.testset_name", "testset_metadata.name").alias("testset_name"),
        F.col("testset_metadata.config_hash").alias("config_hash"),
        F.coalesce("metadata.created_at", "metadata.timestamp").alias("created_at"),
        F.col("metadata.hostname").alias("hostname"),
        F.col("execution_info.duration_seconds").alias("duration_seconds"),
        F.col(f"{s}.accuracy").alias("declared_accuracy"),
        F.col(f"{s}.average_cell_accuracy").alias("declared_cell_accuracy"),
        F.col(f"{s}.total_input_tokens").alias("total_input_tokens"),
        F.col(f"{s}.total_output_tokens").alias("total_output_tokens"),
        F.coalesce(F.size("results"), F.lit(0)).alias("n_results"),
    )


def explode_results(documents: DataFrame) -> DataFrame:
    """One row per result entry, run columns attached; both producers' field names are read.

    A run without results stays as one row whose status is null; counts are over rows with a status.
    """
    run = documents.select(
        F.col("metadata.result_id").alias("run_id"),
        F.coalesce("model_info.model_name", F.lit("unknown")).alias("model_name"),
        "model_info.provider",
        "model_info.quantization",
        F.coalesce("testset_metadata.testset_name", "testset_metadata.name").alias("testset_name"),
        F.col("testset_metadata.config_hash").alias("config_hash"),
        F.coalesce("test_config.user_prompt_style", "test_config.prompt_style").alias("user_style"),
        F.col("test_config.system_prompt_style").alias("system_style"),
        F.coalesce("metadata.created_at", "metadata.timestamp").alias("created_at"),
        F.explode_outer("results").alias("r"),
    )
    return run.select(
        "run_id",
        "model_name",
        "provider",
        "quantization",
        "testset_name",
        "config_hash",
        "user_style",
        "system_style",
        "created_at",
        F.col("r.test_id").alias("test_id"),
        F.col("r.status").alias("status"),
        F.col("r.error").alias("error"),
        F.col("r.duration").alias("duration"),
        F.col("r.input.user_prompt").alias("user_prompt"),
        F.col("r.input.system_prompt").alias("system_prompt"),
        F.col("r.input.task_params").alias("task_params"),
        F.col("r.output.raw_response").alias("raw_response"),
        F.col("r.output.parsed_answer").alias("parsed_answer"),
        F.col("r.output.reasoning").alias("reasoning"),
        F.coalesce("r.tokens.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("r.tokens.output_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("r.evaluation.correct", F.lit(False)).alias("correct"),
        F.col("r.evaluation.match_type").alias("match_type"),
        F.col("r.evaluation.accuracy").alias("accuracy"),
        F.col("r.evaluation.details").alias("details"),
        # one producer writes the ranking flag at the top, the other among the details
        F.coalesce(
            "r.evaluation.fallacy_detected",
            F.get_json_object("r.evaluation.details", "$.fallacy_detected").try_cast("boolean"),
        ).alias("fallacy_detected"),
    )


def union_runs(*frames: DataFrame) -> DataFrame:
    """Rows of several producers in one table; fields one of them lacks are null."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def read_testsets(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*.json.gz", one_per_file: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Test-set headers (one row per document) and their cases (one row each).

    What cannot be read is in ``bad_documents`` with the test-set schema.
    """
    located = _readable(_documents(spark, paths, TESTSET_DOCUMENT, glob, one_per_file), "metadata.name")
    headers = located.select(
        "file_path", "format_version", "metadata", "generation_params", "sampling_params", "execution_params", "statistics"
    )
    cases = located.select(
        "file_path", F.col("metadata.config_hash").alias("config_hash"), F.inline_outer("test_cases")
    )
    return headers, cases


def write_documents(rows: DataFrame, path: str, run: Sequence[str], per_document: int = 5000, made: Mapping[str, Column] | None = None, shares: int = 1) -> None:
    """Scored rows as gzip result documents, one JSON document per line.

    A run with more than ``per_document`` rows becomes several documents, so the
    array of one document, and the task that builds it, stays bounded.  Only those runs, of which there are
    fewer than rows / ``per_document``, are joined to the rows, so rows are shuffled once.  They are found in a
    job of its own, whose shuffle files are gone when the rows are shuffled.

    ``made`` has fields that follow from the columns of ``rows``, or, where they describe a run, from those of
    ``run``: they are worked out after the shuffle, so long names and nulls of all rows are not shuffled.  A column of
    ``run`` that has one value in all rows belongs there too, as Spark would shuffle the rows again without it.

    Documents are written in so many ``shares``, one after the other, each from the rows read again: with
    ``shuffles_dropped`` the shuffled rows of one share only are on disk at a time.
    """
    made = made or {}
    c = lambda x: made[x].alias(x) if x in made else F.col(x)
    entry = F.struct(
        c("test_id"),
        c("status"),
        F.when(c("status") != "success", "request failed").alias("error"),
        c("duration"),
        F.struct(F.lit(None).cast("string").alias("user_prompt"), F.lit(None).cast("string").alias("system_prompt"), c("task_params")).alias("input"),
        F.struct(c("raw_response"), F.lit(None).cast("string").alias("parsed_answer")).alias("output"),
        F.struct(c("input_tokens"), c("output_tokens")).alias("tokens"),
        F.struct(c("correct"), c("match_type"), c("correct").cast("double").alias("accuracy")).alias("evaluation"),
    )
    sizes = rows.groupBy(*run).agg(F.ceil(F.count(F.lit(1)) / per_document).cast("int").alias("_shards"))
    parted = sizes.filter("_shards > 1").withColumnsRenamed({x: f"_{x}" for x in run})
    spark, found = rows.sparkSession, scratch_path(rows.sparkSession, "long-runs")
    with shuffles_dropped(spark):
        parted.write.parquet(found)
    parted = spark.read.schema(parted.schema).parquet(found)
    shard = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_shards", F.lit(1)))
    keyed = rows.join(F.broadcast(parted), [F.equal_null(x, F.col(f"_{x}")) for x in run], "left")
    keyed = keyed.select(*rows.columns, shard.alias("_shard"))
    documents_of = lambda some: (
        some.repartition(*run, "_shard")  # a task holds few rows of a document, so lists are made after the shuffle only
        .groupBy(*run, "_shard")
        .agg(
            F.collect_list(entry).alias("results"),
            F.count_if(c("status") == "success").alias("ok"),
            F.count_if(c("status") != "success").alias("failed"),
            F.count_if(c("correct")).alias("right"),
            F.sum(c("duration")).alias("seconds"),
            F.sum(c("input_tokens").cast("bigint")).alias("tin"),
            F.sum(c("output_tokens").cast("bigint")).alias("tout"),
        )
        .select(
            F.lit("1.0.0").alias("format_version"),
            F.struct(c("run_id").cast("string").alias("result_id")).alias("metadata"),
            F.struct(c("user_style").alias("user_prompt_style"), c("system_style").alias("system_prompt_style")).alias("test_config"),
            F.struct(c("model_name"), F.lit("local").alias("provider"), c("quantization")).alias("model_info"),
            F.struct(F.lit("derived").alias("name"), (c("config_hash") if "config_hash" in {*run, *made} else F.lit(None).cast("string")).alias("config_hash")).alias("testset_metadata"),
            F.struct(c("ok").alias("successful_tests"), c("failed").alias("failed_tests"), c("seconds").alias("duration_seconds")).alias("execution_info"),
            F.struct(
                F.try_divide(c("right").cast("double"), c("ok").cast("double")).alias("accuracy"),
                c("right").alias("correct_responses"),
                c("tin").alias("total_input_tokens"),
                c("tout").alias("total_output_tokens"),
            ).alias("summary_statistics"),
            "results",
        )
    )
    try:
        for k in range(shares):
            some = keyed.filter(F.pmod(F.xxhash64(*run, "_shard"), F.lit(shares)) == k) if shares > 1 else keyed
            documents_of(some).write.mode("append" if k else "overwrite").option("compression", "gzip").json(path)
    finally:
        remove(spark, found)
