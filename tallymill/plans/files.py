"""Sources and sinks: each query writes data derived from the tables to the shared folder and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.fixtures import (
    EVAL_ROWS_SQL, RESPONSES_SQL, TASKS, USER_STYLES, case_name, eval_rows, input_tokens, model_name, output_tokens, quantization, raw_task, responses,
    system_style, table,
)
from tallymill.functions.identity import task_type_from_id
from tallymill.operators import aggregate as agg
from tallymill.operators import compare
from tallymill.operators.aggregate import rounded
from tallymill.plans.aggregates import GOOD, OK
from tallymill.plans.registry import query
from tallymill.session import remove, scratch_path, shuffles_dropped
from tallymill.sources import catalog, documents, sinks, texts

_RUN = ["run_id", "model_name", "quantization", "user_style", "system_style"]
_written: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """Path of derived files, written once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def result_documents(spark: SparkSession, sf: str) -> str:
    def write(path: str) -> None:
        rows = responses(spark, sf).withColumn("task_params", F.to_json(F.struct(F.col("expected").alias("expected_answer"))))
        keep = [*_RUN, "test_id", "status", "duration", "task_params", "raw_response", "input_tokens", "output_tokens", "correct", "match_type", "l_linenumber", "l_partkey"]
        documents.write_documents(rows.select(*keep), path, _RUN, per_document=2000)

    return written(spark, sf, "results", write)


def read_back(spark: SparkSession, sf: str) -> DataFrame:
    return documents.read_results(spark, result_documents(spark, sf), "*.json.gz", one_per_file=False)


_PER_RUN = f"""SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS total, {OK} AS successful, {GOOD} AS correct,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(duration), 4) AS duration FROM eval_rows GROUP BY run_id"""


def per_run(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if("correct").alias("correct"),
        F.sum(F.col("input_tokens").cast("bigint")).alias("input_tokens"),
        rounded(F.sum("duration"), 4).alias("duration"),
    )


@query("read_results", f"WITH {EVAL_ROWS_SQL} {_PER_RUN}")
def _(spark, sf):
    s = "summary_statistics"
    docs = read_back(spark, sf).groupBy(F.col("metadata.result_id").alias("run_id"))
    return docs.agg(
        F.sum(F.size("results")).alias("total"),
        F.sum("execution_info.successful_tests").alias("successful"),
        F.sum(f"{s}.correct_responses").alias("correct"),
        F.sum(f"{s}.total_input_tokens").alias("input_tokens"),
        rounded(F.sum("execution_info.duration_seconds"), 4).alias("duration"),
    )


@query(
    "explode_results",
    f"""WITH {RESPONSES_SQL} SELECT CAST(run_id AS VARCHAR) AS run_id, model_name, quantization, user_style, system_style, test_id, status,
      raw_response, CASE WHEN status <> 'success' THEN 'request failed' END AS error, json_object('expected_answer', expected)::VARCHAR AS task_params,
      duration, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, correct, match_type FROM responses""",
)
def _(spark, sf):
    rows = documents.explode_results(read_back(spark, sf))
    return rows.select(
        "run_id", "model_name", "quantization", "user_style", "system_style", "test_id", "status", "raw_response", "error",
        "task_params", "duration", "input_tokens", "output_tokens", "correct", "match_type",
    )


@query(
    "read_tolerant",
    """SELECT 'good' AS kind, count(DISTINCT p_type) AS n FROM part UNION ALL SELECT 'broken document', count(DISTINCT p_brand) FROM part
    UNION ALL SELECT 'truncated gzip', 1""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")

    def write(path: str) -> None:
        # good and broken lines share their files; one more file is cut off in the middle of its first block
        good = parts.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
        good = good.select(F.to_json(F.struct(F.struct(F.col("p_type").alias("model_name")).alias("model_info"))).alias("value"))
        bad = parts.select(F.concat(F.lit('{"model_info": {"model_name": "'), "p_brand").alias("value")).distinct()
        good.unionByName(bad).repartition(3).write.option("compression", "gzip").text(f"{path}/whole")
        good.coalesce(1).write.option("compression", "gzip").text(f"{path}/source")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/source")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().endswith(".gz"))
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/cut/part-0.txt.gz")
        source, cut = fs.open(whole), fs.create(target)
        for _ in range(40):
            cut.write(source.read())
        source.close()
        cut.close()
        fs.delete(folder, True)

    folder = written(spark, sf, "mixed", write)
    readable, bad = documents.split_readable(spark, folder, "*.gz", one_per_file=False)
    good = readable.select(F.lit("good").alias("kind"), F.col("model_info.model_name").alias("what"))
    lost = bad.select(F.col("cause").alias("kind"), F.coalesce("document", "file_path").alias("what"))
    return good.unionByName(lost).groupBy("kind").agg(F.count("what").alias("n"))


@query(
    "run_headers",
    f"""WITH {EVAL_ROWS_SQL} SELECT CAST(run_id AS VARCHAR) AS run_id, model_name, 'local' AS provider, 'derived' AS testset_name, CAST(count(*) AS BIGINT) AS n_results,
      CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, round(sum(duration), 4) AS duration
    FROM eval_rows GROUP BY run_id, model_name""",
)
def _(spark, sf):
    headers = documents.run_headers(read_back(spark, sf))
    per_run = headers.groupBy("run_id", "model_name", "provider", "testset_name")
    return per_run.agg(
        F.sum("n_results").cast("bigint").alias("n_results"), F.sum("total_input_tokens").alias("total_input_tokens"), rounded(F.sum("duration_seconds"), 4).alias("duration")
    )


@query(
    "union_runs",
    f"""WITH {EVAL_ROWS_SQL} SELECT 'log' AS producer, test_id AS row_id, quantization, CAST(NULL AS VARCHAR) AS lang, correct FROM eval_rows
    UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), NULL, lang, quality = 1 FROM labels JOIN documents USING (doc_id)""",
)
def _(spark, sf):
    log = eval_rows(spark, sf).select(F.lit("log").alias("producer"), F.col("test_id").alias("row_id"), "quantization", "correct")
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    marked = labels.select(
        F.lit("labels").alias("producer"), F.col("doc_id").cast("string").alias("row_id"), "lang", (F.col("quality") == 1).alias("correct")
    )
    return documents.union_runs(log, marked)


def _testsets(spark: SparkSession, sf: str) -> str:
    def write(path: str) -> None:
        case = F.struct(
            F.concat(F.lit("multi_"), "o_orderkey").alias("test_id"),
            F.lower("o_orderstatus").alias("task_type"),
            F.col("o_orderpriority").alias("config_name"),
            F.struct(F.lit("").alias("system"), F.col("o_orderpriority").alias("user")).alias("prompts"),
            F.to_json(F.struct("o_custkey")).alias("task_params"),
        )
        # documents of some 2,000 cases each, however large the table
        orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
        sizes = orders.groupBy(F.col("o_orderstatus").alias("_s"), F.col("y").alias("_y")).agg(F.ceil(F.count(F.lit(1)) / 2000).cast("bigint").alias("shards"))
        keyed = orders.join(sizes, (F.col("o_orderstatus") == F.col("_s")) & (F.col("y") == F.col("_y")))
        docs = keyed.groupBy("o_orderstatus", "y", F.pmod(F.col("o_orderkey"), F.col("shards")).alias("s"))
        docs.agg(F.collect_list(case).alias("test_cases")).select(
            F.struct(F.concat_ws("-", "o_orderstatus", "y", "s").alias("config_hash"), F.col("o_orderstatus").alias("name")).alias("metadata"),
            "test_cases",
        ).write.option("compression", "gzip").json(path)

    return written(spark, sf, "testsets", write)


@query(
    "read_testsets",
    """SELECT 'multi_' || o_orderkey AS test_id, lower(o_orderstatus) AS task_type, o_orderpriority AS user_prompt,
      o_orderstatus || '-' || year(o_orderdate) || '-' || (o_orderkey % CAST(ceil(count(*) OVER (PARTITION BY o_orderstatus, year(o_orderdate)) / 2000.0) AS BIGINT)) AS config_hash,
      CAST(o_custkey AS VARCHAR) AS customer FROM orders""",
)
def _(spark, sf):
    _, cases = documents.read_testsets(spark, _testsets(spark, sf), one_per_file=False)
    return cases.select(
        "test_id",
        "task_type",
        F.col("prompts.user").alias("user_prompt"),
        "config_hash",
        F.get_json_object("task_params", "$.o_custkey").alias("customer"),
    )


@query(
    "read_testset_headers",
    """SELECT DISTINCT o_orderstatus || '-' || year(o_orderdate) || '-' || (o_orderkey % CAST(ceil(count(*) OVER (PARTITION BY o_orderstatus, year(o_orderdate)) / 2000.0) AS BIGINT)) AS config_hash,
      o_orderstatus AS name FROM orders""",
)
def _(spark, sf):
    headers, _ = documents.read_testsets(spark, _testsets(spark, sf), one_per_file=False)
    return headers.select("metadata.config_hash", "metadata.name")


@query(
    "read_legacy_logs",
    f"""WITH {EVAL_ROWS_SQL} SELECT 'eval:' || model_name AS model, user_style, system_style, user_style || '+' || system_style AS config,
      CAST(count(*) FILTER (WHERE correct) AS DOUBLE) AS accuracy, 0.5::DOUBLE AS normalized_accuracy, {OK} || '/' || count(*) AS valid_tests,
      CAST(count(*) FILTER (WHERE match_type = 'parse_error') AS INT) AS parse_errors, 0.0::DOUBLE AS success_rate, 7 AS perfect_scores
    FROM eval_rows GROUP BY model_name, user_style, system_style""",
)
def _(spark, sf):
    def write(path: str) -> None:
        runs = agg.run_summary(eval_rows(spark, sf), ["model_name", "user_style", "system_style"])
        body = F.concat(
            F.lit("Avg Accuracy (all): "), F.col("correct_responses").cast("string"), F.lit(".0%\nNorm Accuracy: 0.50%\nValid Tests: "),
            F.concat_ws("/", "successful_tests", "total_tests"), F.lit("\nParse Errors: "), F.col("parse_errors").cast("string"),
            F.lit("\nPerfect Scores (exact): 7\n"),
        )
        name = F.concat_ws("_", F.lit("eval"), "model_name", "user_style", "system_style")
        runs.select(body.alias("value"), name.alias("log")).write.partitionBy("log").text(path)

    return texts.read_legacy_logs(spark, written(spark, sf, "logs", write), r"log=([^/]+)/[^/]+$")


@query(
    "last_table_accuracy",
    f"""WITH {EVAL_ROWS_SQL} SELECT model_name, CAST(count(*) FILTER (WHERE correct) AS DOUBLE) AS accuracy FROM eval_rows GROUP BY model_name""",
)
def _(spark, sf):
    counts = eval_rows(spark, sf).groupBy("model_name").agg(F.count_if("correct").cast("string").alias("n"))
    log = F.concat(F.lit("| Run | Acc |\n| one | 12.5% |\n| "), F.col("model_name"), F.lit(" | "), F.col("n"), F.lit("% |\ndone"))
    return counts.select("model_name", texts.last_table_accuracy(log).alias("accuracy"))


@query(
    "read_delimited_refs",
    """SELECT DISTINCT lower(p_name) AS word, lower(p_brand) AS other, p_size % 2 = 0 AS same,
      CASE WHEN length(p_name) <= 5 THEN 'short' WHEN length(p_name) <= 9 THEN 'medium' WHEN length(p_name) <= 15 THEN 'long' ELSE 'extra_long' END AS tier
    FROM part WHERE p_partkey % 5 > 1""",
)
def _(spark, sf):
    def write(path: str) -> None:
        line = F.expr(
            """case p_partkey % 5 when 0 then concat('# ', p_name) when 1 then concat(p_name, '|', p_brand)
               else concat(p_name, ' | ', p_brand, '|', case when p_size % 2 = 0 then 'True' else 'false' end) end"""
        )
        table(spark, sf, "part").select(line.alias("value")).write.text(path)

    refs = texts.read_delimited_refs(spark, written(spark, sf, "refs", write), ["word", "other", "same"], "|", lower=["word", "other"])
    return refs.select("word", "other", texts.flag(F.col("same")).alias("same"), texts.length_tier(F.col("word")).alias("tier")).distinct()


@query(
    "run_catalog",
    f"""WITH {EVAL_ROWS_SQL}, r AS (SELECT run_id, model_name, quantization, user_style, system_style, count(*) AS n, {GOOD} AS c, {OK} AS ok,
        CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS t,
        array_to_string(list_sort(list(DISTINCT task_type) FILTER (WHERE status = 'success')), ',') AS task_types FROM eval_rows GROUP BY ALL)
    SELECT CAST(run_id AS VARCHAR) AS run_id, model_name, 'local' AS provider, 'derived' AS testset_name, round(coalesce(c / nullif(ok, 0), 0), 6) AS accuracy,
      c AS correct, n AS total_tests, t AS total_tokens, coalesce(task_types, '') AS task_types, TRUE AS has_file FROM r""",
)
def _(spark, sf):
    def write(path: str) -> None:
        rows = eval_rows(spark, sf).withColumns({"task_params": F.lit(None).cast("string"), "raw_response": F.lit("")})
        keep = [*_RUN, "test_id", "status", "duration", "task_params", "raw_response", "input_tokens", "output_tokens", "correct", "match_type"]
        documents.write_documents(rows.select(*keep), path, _RUN, per_document=1_000_000)

    docs = documents.read_results(spark, written(spark, sf, "catalog", write), "*.json.gz", one_per_file=False)
    listed = catalog.run_catalog(
        docs.withColumns({"size_bytes": F.col("_metadata.file_size"), "modified": F.col("_metadata.file_modification_time")}),
        "file_path", "size_bytes", "modified",
    )
    return catalog.newest_first(listed, "modified", "run_id").select(
        "run_id",
        "model_name",
        "provider",
        "testset_name",
        rounded(F.col("accuracy")).alias("accuracy"),
        "correct",
        F.col("total_tests").cast("bigint").alias("total_tests"),
        "total_tokens",
        F.array_join("task_types", ",").alias("task_types"),
        ((F.col("size_bytes") > 0) & F.col("modified").isNotNull()).alias("has_file"),
    )


@query(
    "testset_catalog",
    f"""WITH {EVAL_ROWS_SQL}, f AS (SELECT run_id, l_orderkey, row_number() OVER (PARTITION BY run_id ORDER BY l_orderkey) AS n FROM eval_rows),
    s AS (SELECT run_id, array_to_string(list(l_orderkey ORDER BY l_orderkey), ',') AS sample_cases FROM f WHERE n <= 5 GROUP BY run_id)
    SELECT run_id, count(*) AS test_count, array_to_string(list_sort(list(DISTINCT task_type)), ',') AS task_types, first(sample_cases) AS sample_cases
    FROM eval_rows JOIN s USING (run_id) GROUP BY run_id""",
)
def _(spark, sf):
    return catalog.testset_catalog(eval_rows(spark, sf), "run_id", "l_orderkey")


@query(
    "write_aggregates",
    f"""WITH {EVAL_ROWS_SQL}, t AS (SELECT task_type, count(*) AS total, {GOOD} AS correct FROM eval_rows GROUP BY task_type)
    SELECT k AS kind, task_type, total, correct FROM t, (SELECT unnest(['csv', 'json', 'parquet']) AS k)""",
)
def _(spark, sf):
    small = agg.base_aggregate(eval_rows(spark, sf), ["task_type"]).select("task_type", "total", "correct")
    schema, out = "task_type string, total bigint, correct bigint", []
    for kind in ("parquet", "json", "csv"):
        path = written(spark, sf, f"aggregates-{kind}", lambda p, k=kind: sinks.write_aggregates(small, p, k))
        reader = spark.read.schema(schema).option("header", True)
        out.append(getattr(reader, kind)(path).withColumn("kind", F.lit(kind)))
    return documents.union_runs(*out)


@query(
    "write_failures_jsonl",
    f"""WITH {RESPONSES_SQL} SELECT regexp_replace(regexp_replace(test_id, '^multi_[0-9]+_', ''), '(_[0-9]+)+$', '') AS family, test_id, model_name, raw_response
    FROM responses WHERE NOT correct AND raw_response <> ''""",
)
def _(spark, sf):
    def write(path: str) -> None:
        sinks.write_failures_jsonl(responses(spark, sf).select("test_id", "model_name", "raw_response", "correct"), path)

    path = written(spark, sf, "failures", write)
    schema = "test_id string, model_name string, raw_response string, family string"
    return spark.read.schema(schema).json(path).select("family", "test_id", "model_name", "raw_response")


@query(
    "write_bronze",
    f"WITH {EVAL_ROWS_SQL} SELECT model_name, count(*) AS total, {GOOD} AS correct FROM eval_rows GROUP BY ALL",
)
def _(spark, sf):
    def write(path: str) -> None:
        rows = documents.explode_results(read_back(spark, sf))
        for _ in range(2):  # a job that is run again doubles nothing
            sinks.write_bronze(rows, path)

    bronze = spark.read.parquet(written(spark, sf, "bronze", write))
    return bronze.groupBy("model_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))


#: Documents are written, and tests get their styles, in so many shares by hash, one after the other, so the shuffled rows of
#: one share only are on disk at a time.  What they come from is read once for each.
STYLE_SHARES = 3


def _styled_documents(spark: SparkSession, sf: str) -> str:
    """Result documents without styles, as producers write them, beside the test sets that have them.

    Line items meet their parts once, in columns on disk, which take less room than shuffled rows.  Names are made after each
    shuffle, from what they consist of.
    """
    test_id = F.concat_ws("_", case_name(), "run_id", "l_linenumber", "l_partkey")
    parts = ["run_id", "l_orderkey", "l_linenumber", "l_partkey", "p_type"]
    number = lambda run: F.pmod(run, F.lit(7))
    config_hash = lambda of: F.concat(F.lit("set-"), of.cast("string"))

    def write_results(log: DataFrame, path: str) -> None:
        made = {x: F.lit(None).cast("string") for x in ("user_style", "system_style", "task_params", "raw_response")} | {
            "test_id": test_id,
            "model_name": model_name(),
            "quantization": quantization(),
            "config_hash": config_hash(number("run_id")),
            "input_tokens": input_tokens(),
            "output_tokens": output_tokens(),
            "correct": F.coalesce(F.col("match_type") == "exact", F.lit(False)),
        }
        bare = log.select(*parts, "l_quantity", "duration", "status", "match_type")
        documents.write_documents(bare, path, ["run_id"], per_document=2000, made=made, shares=STYLE_SHARES)

    def write_sets(log: DataFrame, path: str) -> None:
        # rows of a case are of one document, so one shuffle serves both to keep one of them and to make the list; rows are
        # counted, not cases, so sets with repeated rows have more and smaller documents
        sizes = log.groupBy(number("run_id").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / 5000).alias("_shards"))
        document = F.pmod(F.xxhash64(test_id), F.col("_shards")) * 7 + F.col("_s")
        keyed = log.join(F.broadcast(sizes), number("run_id") == F.col("_s")).withColumn("_document", document)
        # what is kept of a case is numbers, so cases are hashed, not sorted
        styles, tasks = (F.array(*map(F.lit, x)) for x in (USER_STYLES, TASKS))
        task = F.when(F.col("l_orderkey").isNotNull(), F.array_position(tasks, raw_task()).cast("int"))
        numbers = [F.array_position(styles, F.col("user_style")).cast("int").alias("_style"), task.alias("_task")]
        dealt = keyed.select("_document", *parts, *numbers)
        style = {"user_style": F.element_at(styles, F.col("_style")), "system_style": system_style(), "language": F.lit("en")}
        said = F.create_map(*(x for key, value in style.items() for x in (F.lit(key), value)))
        case = F.struct("test_id", task_type_from_id(F.element_at(tasks, F.col("_task"))).alias("task_type"), said.alias("prompt_metadata"))
        for k in range(STYLE_SHARES):
            some = dealt.filter(F.pmod(F.xxhash64("_document"), F.lit(STYLE_SHARES)) == k).repartition("_document")
            once = some.select("_document", test_id.alias("test_id"), "l_partkey", "_style", "_task").dropDuplicates(["_document", "test_id"])
            sets = once.groupBy("_document").agg(F.collect_list(case).alias("test_cases"))
            sets = sets.select(F.struct(config_hash(number("_document")).alias("config_hash")).alias("metadata"), "test_cases")
            sets.write.mode("append").option("compression", "gzip").json(path)

    def write(path: str) -> None:
        met, log = scratch_path(spark, "styled-log"), eval_rows(spark, sf).select(*parts, "l_quantity", "duration", "status", "match_type", "user_style")
        with shuffles_dropped(spark):
            try:
                log.write.option("compression", "zstd").parquet(met)
                log = spark.read.schema(log.schema).parquet(met)
                write_results(log, f"{path}/results")
                write_sets(log, f"{path}/sets")
            finally:
                remove(spark, met)

    return written(spark, sf, "styled", write)


@query(
    "styles_from_testset",
    f"""WITH {EVAL_ROWS_SQL} SELECT user_style, system_style, 'en' AS language, count(*) AS total, {OK} AS successful, {GOOD} AS correct
    FROM eval_rows GROUP BY ALL""",
)
def _(spark, sf):
    folder = _styled_documents(spark, sf)
    rows = documents.explode_results(documents.read_results(spark, f"{folder}/results", "*.json.gz", one_per_file=False))
    _, cases = documents.read_testsets(spark, f"{folder}/sets", one_per_file=False)
    rows = rows.withColumn("successful", F.col("status") == "success")
    counts = scratch_path(spark, "styled-counts")
    for k in range(STYLE_SHARES):
        share = F.pmod(F.xxhash64("test_id"), F.lit(STYLE_SHARES)) == k
        styled = compare.with_styles(rows.filter(share), cases.filter(share)).groupBy("user_style", "system_style", "language")
        styled = styled.agg(F.count(F.lit(1)).alias("total"), F.count_if("successful").alias("successful"), F.count_if("correct").alias("correct"))
        with shuffles_dropped(spark):
            styled.write.mode("append").parquet(counts)
    shares = spark.read.schema(styled.schema).parquet(counts).groupBy("user_style", "system_style", "language")
    return shares.agg(*(F.sum(x).alias(x) for x in ("total", "successful", "correct")))
