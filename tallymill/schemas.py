"""Schemas of result and test-set documents.

Free-form parts (task parameters, parsed answers, evaluation details) are read
as their JSON text; queries project the fields they need.
"""

from __future__ import annotations

RESULT_ENTRY = """struct<
  test_id: string, status: string, error: string, duration: double,
  input: struct<user_prompt: string, system_prompt: string, task_params: string>,
  output: struct<raw_response: string, parsed_answer: string, reasoning: string, tokens_generated: bigint>,
  tokens: struct<input_tokens: bigint, output_tokens: bigint>,
  evaluation: struct<correct: boolean, match_type: string, accuracy: double, details: string, error: string,
    fallacy_detected: boolean, confidence_score: double, ranking_quality: double>>"""

RESULT_DOCUMENT = f"""
  format_version string,
  metadata struct<result_id: string, created_at: string, timestamp: string, hostname: string, python_version: string, runner_version: string>,
  testset_metadata struct<testset_file: string, testset_name: string, name: string, testset_version: string, config_hash: string, task_type: string>,
  model_info struct<model_name: string, provider: string, quantization: string, context_length: bigint>,
  execution_info struct<started_at: string, completed_at: string, duration_seconds: double, successful_tests: bigint, failed_tests: bigint, average_time_per_test: double>,
  summary_statistics struct<accuracy: double, correct_responses: bigint, total_responses: bigint, parse_error_rate: double,
    total_input_tokens: bigint, total_output_tokens: bigint, avg_input_tokens_per_test: double, avg_output_tokens_per_test: double, average_cell_accuracy: double>,
  test_config struct<user_prompt_style: string, prompt_style: string, system_prompt_style: string>,
  results array<{RESULT_ENTRY}>"""

TESTSET_DOCUMENT = """
  format_version string,
  metadata struct<name: string, version: string, schema_version: string, description: string, created_by: string, task_type: string,
    created_at: string, config_file: string, config_hash: string, generator_version: string>,
  generation_params string, sampling_params string, execution_params string,
  test_cases array<struct<test_id: string, task_type: string, config_name: string,
    prompts: struct<system: string, user: string, full: string>, task_params: string,
    prompt_metadata: map<string, string>, generation_metadata: string>>,
  statistics struct<total_test_cases: bigint, prompt_configurations: bigint, task_types: array<string>, expected_count: bigint>"""

CORRUPT = "_corrupt_record"
