"""Schemas of run-log records. Field names are fixed values: they are those of the log lines."""

USAGE = "struct<total_calls:bigint,total_input_tokens:bigint,total_output_tokens:bigint>"

CALL = (
    "struct<root_model:string,prompt:string,response:string,"
    f"usage:map<string,{USAGE}>,execution_time:double>"
)

RESULT = (
    "struct<stdout:string,stderr:string,locals:map<string,variant>,"
    f"execution_time:double,rlm_calls:array<{CALL}>>"
)

BLOCK = f"struct<code:string,result:{RESULT}>"

# What the lines of a log hold. Fields that change type from writer to writer are VARIANT.
RAW_CALL = (
    "struct<root_model:string,prompt:variant,response:variant,usage_summary:variant,"
    "prompt_tokens:bigint,completion_tokens:bigint,execution_time:double>"
)

RAW_RECORD = (
    "run_id string, type string, timestamp string, root_model string, max_depth int, max_iterations int, "
    "backend string, backend_kwargs map<string,variant>, environment_type string, "
    "environment_kwargs map<string,variant>, other_backends array<string>, "
    "iteration int, prompt variant, response string, "
    "code_blocks array<struct<code:string,result:struct<stdout:string,stderr:string,"
    f"locals:map<string,variant>,execution_time:double,rlm_calls:array<{RAW_CALL}>>>>, "
    "final_answer variant, iteration_time double, _corrupt string"
)
