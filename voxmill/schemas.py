"""Schemas of the tables; readers declare them and never infer."""

from __future__ import annotations

SEGMENTS = "source_id string, chunk_idx int, start double, end double, speaker string"
CANDIDATES = "source_id string, chunk_idx int, cand_idx int, start double, end double, speaker_similarity double"
METADATA = "file string, text string"
#: Columns of the extended log, in order.
EXTENDED_NUMBERS = ("start", "end", "duration", "speaker_similarity", "rms_dbfs", "peak_dbfs", "clipping_ratio", "silence_ratio")
EXTENDED = "file string, text string, source string, " + ", ".join(f"`{c}` double" for c in EXTENDED_NUMBERS)
STATE = "path string, status string, clips bigint, seconds double, error string"
WAVE = "path string, rate int, channels int, width int, frames bigint, samples array<smallint>"
