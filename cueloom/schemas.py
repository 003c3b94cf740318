"""Types of the tables and documents that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

SLIDES = "deck_id bigint, slide_num int, title string, notes string, subtitle_text string"
SUSPECT = "struct<source_start_offset:int,source_end_offset:int,skipped_text:string,gap_seconds:double,expected_seconds:double,audio_position_seconds:double>"
ENTRY = f"struct<slide_num:int,title:string,audio_file:string,word_boundaries_file:string,narration_gap_warnings:array<{SUSPECT}>>"
MANIFEST = f"voice string, rate string, pitch string, output_dir string, slides array<{ENTRY}>"
SLIDE_DOCUMENT = "struct<slide_num:int,title:string,notes:string,subtitle_text:string>"
EVENT = "struct<text:string,offset_seconds:double,duration_seconds:double>"
EVENTS = "deck_id bigint, slide_num int, ev_idx int, text string, offset_ms bigint, duration_ms bigint"
SEGMENTS = "seg_idx int, text string, source_start_offset int, source_end_offset int"
MATCHED = "deck_id bigint, slide_num int, ev_idx int, source_start_offset int, source_end_offset int, offset_ms bigint, duration_ms bigint"
MET_LINES = "deck_id bigint, slide_num int, seg_idx int, start int, end int, text string, raw_start bigint, raw_end bigint, next_ms bigint"
CAPTIONS = "deck_id bigint, slide_num int, seg_idx int, text string, start_ms bigint, end_ms bigint"
BOUNDS = "deck_id bigint, slide_num int, start_ms bigint, end_ms bigint"
WARNINGS = "deck_id bigint, slide_num int, code string, message string"
