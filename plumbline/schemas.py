"""Explicit schemas of the fundamental relations; nothing in the engine infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

CHOICES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("source_index", T.IntegerType())]))

QUESTIONS = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("question_text", T.StringType()),
        T.StructField("choices", CHOICES),
        T.StructField("correct_index", T.IntegerType()),
        T.StructField("correct_option", T.StringType()),
        T.StructField("correct_answer_text", T.StringType()),
        T.StructField("n_choices", T.IntegerType()),
    ]
)

_TRACE = "run_id string, benchmark_name string, question_id string, split_name string, subject string, method_name string, prompt_version string, perturbation_name string, sample_index int"
_MODEL = "provider string, model_name string, temperature double, max_tokens int, seed int"
_CONTENT = "question_text string, choices array<struct<text:string,source_index:int>>, correct_index int, correct_option string, n_choices int, prompt string"
_OUTPUT = "transport_status string, answer_status string, raw_text string, finish_reason string, latency_seconds double, timestamp_utc string"
_ERROR = "error_type string, error_message string, error_stage string, error_retryable boolean"
_PARSE = "parsed_choice string, parse_status string, normalized_text string, parse_reason string, is_correct boolean, score_status string"
_IDENTITY = "experiment_id string, condition_id string, dataset_artifact_id string, dataset_selection_id string, model_id string, method_id string, prompt_id string, benchmark_split string"
_METHOD = (
    "per_rotation_choices array<string>, option_distributions array<array<double>>, inference_mode string, n_permutations_total int, n_permutations_failed int, "
    "adjusted_choice string, peprior map<string,double>, option_logprobs array<double>, gate_modal_k int, gate_n_total long, gate_n_evaluated long, gate_n_excluded long, "
    "free_text_prompt string, free_text_response string, free_text_latency double, fallback_used boolean, derived_from_run_id string, derived_from_method_name string"
)
#: The wide fact table: base columns, then nullable columns of single methods.
RESULTS_DDL = ", ".join([_TRACE, _MODEL, _CONTENT, _OUTPUT, _ERROR, _PARSE, _IDENTITY, _METHOD])
RESPONSES_DDL = (
    "question_id string, rotation int, provider string, model_name string, status string, latency_seconds double, raw_text string, finish_reason string, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, error struct<error_type:string,message:string,retryable:boolean,stage:string>, timestamp_utc string, logprobs array<double>"
)
#: Identity columns every written result row must have, one value each per condition.
IDENTITY_COLUMNS = ("experiment_id", "condition_id", "dataset_artifact_id", "dataset_selection_id", "model_id", "method_id", "prompt_id", "benchmark_split")
