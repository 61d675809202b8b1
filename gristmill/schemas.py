"""Schemas of the files that are read and written; none is ever inferred."""

from __future__ import annotations

CHUNK = """framework_name string, framework_full_name string, framework_type string, document string, chunk_id string, text string, domain string, sector string, char_count int, token_estimate int,
position int, has_headers boolean, section_title string, subsection_title string, keywords array<string>, chunk_hash string"""
CHUNK_FILE = f"metadata struct<framework: struct<name: string>>, chunks array<struct<{CHUNK}>>, total_chunks long, optimized boolean"
QUESTION = "question_id string, input string, ideal string, metadata struct<difficulty: string, framework: string, category: string, question_type: string, format: string, industry: string>"
FRAMEWORK = """framework struct<name: string, full_name: string, standard: string, version: string, organization: string, type: string, scope: string>,
source struct<original_url: string, conversion_method: string, original_format: string, converted_date: string>, files struct<documents: array<string>>, metadata struct<description: string, domain: string, sector: string>"""
MODEL = "id string, name string, provider string, context_length int, capabilities array<string>, pricing map<string, string>, training_data_cutoff string, performance_score double, is_available boolean"
RESULT = """response_id string, question_id string, question string, ideal_answer string, model_response string, model_name string, evaluation_mode string, context_provided string, accuracy_score double, timestamp string,
scores map<string, struct<score: double, explanation: string, details: string>>, scoring_error string, loaded_at timestamp"""
