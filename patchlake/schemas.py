"""Schemas of the tables that come from files."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

TEXT, LONG, INT, FLAG, TIME = StringType(), LongType(), IntegerType(), BooleanType(), TimestampType()
TEXTS = ArrayType(TEXT)


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


REPOSITORY = _struct(
    repo_id=TEXT, owner=TEXT, name=TEXT, clone_url=TEXT, local_path=TEXT, language=TEXT, license=TEXT, default_branch=TEXT,
    stars=LONG, forks=LONG, open_issues=LONG, created_at=TIME, updated_at=TIME, pushed_at=TIME, is_fork=FLAG, archived=FLAG,
    collection_status=TEXT, collection_error=TEXT, commit_count=LONG, source_file_count=LONG, diff_record_count=LONG,
    bug_fix_record_count=LONG, last_collected_at=TIME, added_to_manifest_at=TIME, dataset_version=TEXT, quality_status=TEXT,
    quality_notes=TEXTS, provenance=_struct(source=TEXT, source_url=TEXT),
)

CHANGED_FILES = ArrayType(_struct(path=TEXT, added_lines=LONG, deleted_lines=LONG, is_source=FLAG, ignored=FLAG))
DIFF_STATS = _struct(files_changed=LONG, added_lines=LONG, deleted_lines=LONG)

CANDIDATE = _struct(
    record_id=TEXT, repo_id=TEXT, repository=TEXT, owner=TEXT, language=TEXT,
    commit=_struct(hash=TEXT, parent=TEXT, author=TEXT, date=TEXT, subject=TEXT, body=TEXT),
    bug_signal=_struct(score=INT, signals=TEXTS), changed_files=CHANGED_FILES, diff_stats=DIFF_STATS, patch=TEXT, label=INT,
    quality=_struct(status=TEXT, reasons=TEXTS), dataset_quality=_struct(version=TEXT, score=INT, reasons=TEXTS),
    provenance=_struct(source=TEXT, repository_url=TEXT, commit_url=TEXT),
)

FILE_PATCH = _struct(
    commit_hash=TEXT, timestamp=TIME, author_name=TEXT, author_email=TEXT, message=TEXT, parent_hash=TEXT, file_path=TEXT,
    old_path=TEXT, new_path=TEXT, change_type=TEXT, patch=TEXT, patch_truncated=FLAG, added_lines=TEXTS, removed_lines=TEXTS,
    added_line_count=INT, removed_line_count=INT,
)

SCORE_REQUEST = _struct(
    record_id=TEXT, patch=TEXT, added_line_count=LONG, removed_line_count=LONG, diff_stats=DIFF_STATS, changed_files=CHANGED_FILES,
)
