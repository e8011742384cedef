"""Run logs: JSON lines, one file (or one folder of part files) per run, or many runs to a file.

A file per run is what other tools read. It costs a file system entry per run, so large collections
are better kept packed, with ``run_id`` on every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.functions.messages import MESSAGES
from loomtext.schema import RAW_RECORD, USAGE
from loomtext.scratch import materialise, path_exists
from loomtext.session import few_listing_tasks

#: Lines that a task writes as a folder per run; fewer where they would leave cores idle.
TASK_LINES = 20_000
#: Variables hold whole contexts, so strings of a log line may be of any length.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}
# Fixed value: run file names are {name}_{date}_{time}_{8 hex digits}.jsonl.
RUN_FILE = r"(?:^|[/=])([^/=]+)_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})_([0-9a-f]{8})\.jsonl"


def _log_files(reader, path: str) -> DataFrame:
    lines = reader.option("recursiveFileLookup", "true").text(path)
    file_path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return lines.select(F.col("value").alias("line"), file_path.alias("file_path")).where(
        F.col("file_path").rlike(r"\.jsonl(/[^/]*)?$")
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file_path) of every ``.jsonl`` file or ``*.jsonl`` folder below ``path``."""
    with few_listing_tasks(spark):
        return _log_files(spark.read, path)


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream. Files must not grow after they appear."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return _log_files(reader, path)


def run_identity(file_path: Column) -> Column:
    """STRUCT<run_id, name, started, suffix> from a log's path; run_id is the file name."""
    started = F.regexp_extract(file_path, RUN_FILE, 2)
    return F.struct(
        F.regexp_extract(file_path, r"([^/=]+\.jsonl)", 1).alias("run_id"),
        F.nullif(F.regexp_extract(file_path, RUN_FILE, 1), F.lit("")).alias("name"),
        F.try_to_timestamp(started, F.lit("yyyy-MM-dd_HH-mm-ss"))
        .cast("timestamp_ntz")
        .alias("started"),
        F.nullif(F.regexp_extract(file_path, RUN_FILE, 3), F.lit("")).alias("suffix"),
    )


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Parsed records: run_id, line, bad flag, and ``record`` in the raw log schema.

    Blank lines are dropped. A line that is not a JSON object is bad; an object with a field of an
    unexpected type stays a record, that field being NULL.
    """
    filled = lines.where(F.trim("line") != "")
    record = F.from_json(
        "line",
        RAW_RECORD,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **ANY_LENGTH},
    )
    parsed = filled.select("file_path", "line", record.alias("record")).select(
        F.coalesce("record.run_id", run_identity(F.col("file_path"))["run_id"]).alias("run_id"),
        "file_path",
        "line",
        "record",
    )
    # The second parse runs for flagged lines only.
    is_object = F.from_json("line", "map<string,string>", ANY_LENGTH).isNotNull()
    bad = F.when(F.col("record._corrupt").isNotNull(), ~is_object).otherwise(False)
    return parsed.withColumn("bad", bad)


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Lines that could not be read, for reporting."""
    return parsed.where("bad").select("run_id", "line")


def _answer_text(value: Column) -> Column:
    """Content of a final answer held as [kind, content] or as text."""
    return F.coalesce(
        F.try_variant_get(value, "$[1]", "string"), F.try_variant_get(value, "$", "string")
    )


def _call(call: Column) -> Column:
    """A sub-call with its usage in one form, NULL where the log has none.

    Usage is found nested by model, flat per call, or as prompt and completion tokens.
    """
    nested = F.try_variant_get(
        call["usage_summary"], "$.model_usage_summaries", f"map<string,{USAGE}>"
    )
    flat = F.try_variant_get(call["usage_summary"], "$", USAGE)
    tokens = F.struct(
        F.lit(None).cast("bigint").alias("total_calls"),
        call["prompt_tokens"].alias("total_input_tokens"),
        call["completion_tokens"].alias("total_output_tokens"),
    )
    name = F.coalesce(call["root_model"], F.lit("unknown"))
    usage = (
        F.when(F.size(nested) > 0, nested)
        .when(flat["total_calls"].isNotNull(), F.create_map(name, flat))
        .when(
            call["prompt_tokens"].isNotNull() | call["completion_tokens"].isNotNull(),
            F.create_map(name, tokens),
        )
    )
    return F.struct(
        call["root_model"].alias("root_model"),
        F.try_variant_get(call["prompt"], "$", "string").alias("prompt"),
        _answer_text(call["response"]).alias("response"),
        usage.alias("usage"),
        call["execution_time"].alias("execution_time"),
    )


def _block(block: Column) -> Column:
    result = block["result"]
    calls = F.transform(result["rlm_calls"], _call)
    return F.struct(
        block["code"].alias("code"),
        F.when(
            result.isNotNull(),
            F.struct(
                result["stdout"].alias("stdout"),
                result["stderr"].alias("stderr"),
                result["locals"].alias("locals"),
                result["execution_time"].alias("execution_time"),
                calls.alias("rlm_calls"),
            ),
        ).alias("result"),
    )


def _messages(prompt: Column) -> Column:
    text = F.when(
        F.schema_of_variant(prompt) == "STRING", F.try_variant_get(prompt, "$", "string")
    )
    plain = F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).cast(MESSAGES)
    return F.when(text.isNotNull(), plain).otherwise(F.try_variant_get(prompt, "$", MESSAGES))


def iterations_of(parsed: DataFrame) -> DataFrame:
    """Every good record that is not metadata, in one strict schema."""
    r = F.col("record")
    answer = r["final_answer"]
    is_list = F.schema_of_variant(answer).startswith("ARRAY")
    return parsed.where(~F.col("bad") & ~r["type"].eqNullSafe("metadata")).select(
        "run_id",
        r["iteration"].cast("long").alias("iteration"),
        F.to_timestamp(r["timestamp"]).cast("timestamp_ntz").alias("ts"),
        _messages(r["prompt"]).alias("prompt"),
        r["response"].alias("response"),
        F.coalesce(F.transform(r["code_blocks"], _block), F.array()).alias("code_blocks"),
        F.when(~F.is_variant_null(answer), _answer_text(answer)).alias("final_answer"),
        F.when(is_list, F.try_variant_get(answer, "$[0]", "string")).alias("final_kind"),
        r["iteration_time"].alias("iteration_time"),
    )


def configs_of(parsed: DataFrame) -> DataFrame:
    """Metadata records, in one strict schema."""
    r = F.col("record")
    return parsed.where(~F.col("bad") & (r["type"] == "metadata")).select(
        "run_id",
        F.to_timestamp(r["timestamp"]).cast("timestamp_ntz").alias("ts"),
        *(
            r[name].alias(name)
            for name in (
                "root_model",
                "max_depth",
                "max_iterations",
                "backend",
                "backend_kwargs",
                "environment_type",
                "environment_kwargs",
                "other_backends",
            )
        ),
    )


def read_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(configs, iterations, bad lines) of all logs below ``path``."""
    parsed = parse_log_lines(read_log_lines(spark, path))
    return configs_of(parsed), iterations_of(parsed), bad_lines(parsed)


def run_config(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """One config row per run of ``runs``; the last metadata record wins, a run without one has NULLs.

    The ordering is a struct so that a record without a timestamp still counts.
    """
    fields = [c for c in configs.columns if c != "run_id"]
    latest = configs.groupBy("run_id").agg(F.max_by(F.struct(*fields), F.struct("ts")).alias("config"))
    return runs.select("run_id").join(latest, "run_id", "left").select("run_id", "config.*")


def log_lines(configs: DataFrame, iterations: DataFrame, packed: bool = False) -> DataFrame:
    """Rows (run_id, line_no, line): the metadata line is number 0, iterations follow from 1.

    ``iterations`` carries the strict schema. Iteration numbers must be 1-based within a run. Packed
    lines name their run.
    """
    named = ["run_id"] if packed else []
    once = configs.groupBy("run_id").agg(
        F.min_by(
            F.struct(*[c for c in configs.columns if c != "run_id"]), F.struct("ts")
        ).alias("c")
    )
    head = F.struct(
        *named,
        F.lit("metadata").alias("type"),
        F.col("c.ts").cast("string").alias("timestamp"),
        *(
            F.col(f"c.{name}").alias(name)
            for name in configs.columns
            if name not in ("run_id", "ts")
        ),
    )
    keep_nulls = {"ignoreNullFields": "false"}
    metadata = once.select(
        "run_id", F.lit(0).cast("long").alias("line_no"), F.to_json(head, keep_nulls).alias("line")
    )
    answer = F.when(
        F.col("final_kind").isNotNull(), F.array("final_kind", "final_answer").cast("variant")
    ).otherwise(F.col("final_answer").cast("variant"))
    body = F.struct(
        *named,
        F.lit("iteration").alias("type"),
        "iteration",
        F.col("ts").cast("string").alias("timestamp"),
        "prompt",
        "response",
        F.transform("code_blocks", _written_block).alias("code_blocks"),
        answer.alias("final_answer"),
        "iteration_time",
    )
    rows = iterations.select(
        "run_id",
        F.col("iteration").cast("long").alias("line_no"),
        F.to_json(body, keep_nulls).alias("line"),
    )
    return metadata.unionByName(rows)


def _written_call(call: Column) -> Column:
    return F.struct(
        call["root_model"].alias("root_model"),
        call["prompt"].alias("prompt"),
        call["response"].alias("response"),
        F.struct(call["usage"].alias("model_usage_summaries")).alias("usage_summary"),
        call["execution_time"].alias("execution_time"),
    )


def _written_block(block: Column) -> Column:
    result = block["result"]
    return F.struct(
        block["code"].alias("code"),
        F.struct(
            result["stdout"].alias("stdout"),
            result["stderr"].alias("stderr"),
            result["locals"].alias("locals"),
            result["execution_time"].alias("execution_time"),
            F.transform(result["rlm_calls"], _written_call).alias("rlm_calls"),
        ).alias("result"),
    )


def write_trajectories(
    configs: DataFrame, iterations: DataFrame, path: str, packed: bool = False
) -> None:
    """Append logs below ``path``: one folder per run, named by ``run_id``, or packed.

    A run gets its metadata line once, over all appends: runs that have theirs are listed in the folder's
    manifest, a small table beside it. Lines are made once and then range-partitioned by
    (run, line), so a long run spreads over several part files whose names are in line order, and a stream
    sees each file once, complete. The manifest is written last: a run whose append was lost in between may get
    its metadata line again, of which readers take one.
    """
    spark = iterations.sparkSession
    manifest = f"{path.rstrip('/')}.manifest"
    if path_exists(spark, manifest):
        known = spark.read.schema(StructType([configs.schema["run_id"]])).parquet(manifest)
        configs = configs.join(known, "run_id", "left_anti")
    lines = materialise(log_lines(configs, iterations, packed), "lines")
    if packed:
        dealt = lines.repartitionByRange("run_id", "line_no")
    else:
        # Files cost more than their bytes, by which adaptive execution would put them into few tasks.
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_LINES))
        dealt = lines.repartitionByRange(tasks, "run_id", "line_no")
    ordered = dealt.sortWithinPartitions("run_id", "line_no")
    if packed:
        ordered.select("line").write.mode("append").text(f"{path}/packed.jsonl")
    else:
        ordered.select("run_id", "line").write.partitionBy("run_id").mode("append").text(path)
    lines.where("line_no = 0").select("run_id").write.mode("append").parquet(manifest)


def latest_runs(runs: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` for each key.

    ``max_by`` combines on the map side, so a key loaded very often does not pile up in one task.
    """
    fields = [c for c in runs.columns if c not in keys]
    latest = runs.groupBy(*keys).agg(F.max_by(F.struct(*fields), sequence).alias("_latest"))
    return latest.select(*keys, *(F.col(f"_latest.{c}").alias(c) for c in fields))


def upsert_runs(
    existing: DataFrame, new: DataFrame, keys: list[str], sequence: str
) -> DataFrame:
    """Runs after a reload: a loaded run replaces the one with equal keys, others are added.

    A stream appends its rows to a table instead (``start_to_table``) and readers take ``latest_runs``
    of it, so no batch rewrites the table.
    """
    return latest_runs(existing.unionByName(new), keys, sequence)
