"""Schemas of the canonical tables. Every table carries repo_id, so one job covers many repositories."""

from __future__ import annotations

CHANGE_SET = "repo_id string, changeset_id string, committer string, date timestamp, comment string, cs_ord long"
CHANGE_ITEM = "repo_id string, changeset_id string, item_idx int, kind int, server_path string, from_server_path string"
COMMIT_EDGE = "repo_id string, child string, parent string, parent_idx int"
CONTRIBUTION = "repo_id string, path_key string, developer string, lines long"
LOC_METRIC = "repo_id string, path_key string, blanks int, comments int, code int"

# Bits of the kind of a change.
NONE, ADD, EDIT, COPY, RENAME, DELETE, BRANCH, MERGE, TYPE_CHANGED = 1, 2, 4, 8, 16, 32, 128, 256, 512

# Thresholds of the analyses (all of them are arguments, too).
MAX_ITEMS_PER_CHANGESET = 300
MAX_WORK_ITEMS_PER_CHANGESET = 200
MIN_COMMITS_FOR_HOTSPOT = 3
MIN_LINES_FOR_HOTSPOT = 1
MIN_COUPLINGS = 5
MIN_COUPLING_DEGREE = 40.0
