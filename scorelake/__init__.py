"""scorelake: Spark-native evaluation of speech transcripts.

The main entry points, importable from the package root::

    from scorelake import score_records, summarize, evaluate_run
"""

from scorelake.functions.text import normalize_text, normalize_text_whisper, clean_transcript_artifacts
from scorelake.functions.metrics import char_edit_distance, word_edit_distance
from scorelake.functions.audio import audio_input, downmix, resample, resample_array
from scorelake.operators.score import score_records
from scorelake.operators.summary import summarize
from scorelake.operators.rescore import rescore_records, rescore_store
from scorelake.operators.inference import (
    Transcriber,
    available_transcribers,
    register_transcriber,
    transcribe_batch,
)
from scorelake.plans.evaluate import evaluate_run, run_pending
from scorelake.plans.matrix import failed_runs, pending_runs, pending_utterances, resolve_models, run_matrix
from scorelake.sources.catalog import parse_dataset_spec, resolve_specs
from scorelake.sources.records import read_record_lines, recover_records, rewrite_store, stored_runs, write_records
from scorelake.sources.tables import first_n_rows, read_first_rows, read_split, with_row_index

__all__ = [
    "normalize_text", "normalize_text_whisper", "clean_transcript_artifacts",
    "char_edit_distance", "word_edit_distance",
    "audio_input", "downmix", "resample", "resample_array",
    "score_records", "summarize", "rescore_records", "rescore_store",
    "Transcriber", "available_transcribers", "register_transcriber", "transcribe_batch",
    "evaluate_run", "run_pending",
    "failed_runs", "pending_runs", "pending_utterances", "resolve_models", "run_matrix",
    "parse_dataset_spec", "resolve_specs",
    "read_record_lines", "recover_records", "rewrite_store", "stored_runs", "write_records",
    "first_n_rows", "read_first_rows", "read_split", "with_row_index",
]
