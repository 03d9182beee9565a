"""Schemas of files read and written; nothing is inferred."""

from __future__ import annotations

TASK = (
    "id INT, task STRING, video STRING, question STRING, options ARRAY<STRING>, gt INT, answer STRING, activity STRING, "
    "test_info ARRAY<STRUCT<step: STRING, type: INT, count: INT>>"
)
QUESTION_CSV = "question_id STRING, task_type STRING, question STRING, time_stamp STRING, options STRING, answer STRING"
STATS = (
    "STRUCT<original_video_tokens: BIGINT, kept_video_tokens: BIGINT, dropped_video_tokens: BIGINT, keep_ratio_actual: DOUBLE, "
    "scoring_latency_s: DOUBLE, num_tubelets_scored: INT, num_tubelets_unscored: INT, window_mode: STRING>"
)
RECORD = (
    "sample_id STRING, task STRING, video STRING, question STRING, response STRING, ground_truth STRING, method STRING, fps DOUBLE, num_frames INT, "
    f"total_latency_s DOUBLE, peak_memory_mb DOUBLE, video_grid_thw ARRAY<ARRAY<INT>>, expected_video_tokens BIGINT, stats {STATS}"
)
SCORES = "sample_id STRING, window_id INT, keep_mask ARRAY<BOOLEAN>, loss_map ARRAY<DOUBLE>, grid_shape ARRAY<INT>, keep_indices ARRAY<BIGINT>"
TRACE = "ts DOUBLE, checkpoint STRING, memory STRUCT<allocated_mb: DOUBLE, reserved_mb: DOUBLE, max_allocated_mb: DOUBLE, free_mb: DOUBLE, total_mb: DOUBLE>"
PARITY = "video_path STRING, num_windows INT, total_frames INT, fps DOUBLE, windows ARRAY<STRUCT<target_frames: ARRAY<INT>, patch_loss_16x16: ARRAY<DOUBLE>>>"
