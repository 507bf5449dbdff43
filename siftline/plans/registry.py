"""All queries of the core, with their SQL."""

from __future__ import annotations

from siftline.operators import incremental
from siftline.plans import core
from siftline.session import read

_LATEST = """
    WITH seen AS (SELECT codebase_id, regexp_replace(relative_path, '^(\\./)+', '') AS file_path, arg_max(lower(substr(hash, 1, 16)), scanned_at) AS h FROM file_hashes GROUP BY 1, 2),
    good AS (SELECT m.codebase_id, m.path AS file_path, arg_max(lower(substr(m.hash, 1, 16)), m.run_id) AS h FROM manifest m JOIN index_runs r USING (run_id) WHERE lower(trim(r.status)) = 'success' GROUP BY 1, 2)"""

QUERIES: dict = {
    **core.Q,
    "p7_found": lambda s, d: incremental.found(read(s, d, "file_hashes"), read(s, d, "manifest"), read(s, d, "index_runs")),
    "p7_changes": lambda s, d: incremental.pending(read(s, d, "file_hashes"), read(s, d, "manifest"), read(s, d, "index_runs")),
}
SQL: dict[str, str] = {
    **core.SQL,
    "p7_found": _LATEST + " SELECT codebase_id, file_path FROM seen LEFT JOIN good USING (codebase_id, file_path) WHERE good.h IS DISTINCT FROM seen.h",
    "p7_changes": _LATEST
    + """ SELECT codebase_id, file_path, coalesce(seen.h, good.h) AS digest,
          CASE WHEN good.h IS NULL THEN 'added' WHEN seen.h IS NULL THEN 'removed' ELSE 'modified' END AS change
          FROM seen FULL JOIN good USING (codebase_id, file_path) WHERE good.h IS DISTINCT FROM seen.h""",
}
