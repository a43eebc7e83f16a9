"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from packlake.operators.snapshot_diff import change_counts, snapshot_changes
from packlake.session import table


def p4_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "file_snapshots"), table(spark, sf_dir, "snapshot_log"))


def p4_change_counts(spark, sf_dir):
    return change_counts(p4_found(spark, sf_dir))


_CHANGES = r"""
WITH listings AS (
  SELECT repo, snapshot_no, row_number() OVER (PARTITION BY repo ORDER BY snapshot_no) AS ord,
         count(*) OVER (PARTITION BY repo) AS last
  FROM (SELECT DISTINCT repo, snapshot_no FROM snapshot_log WHERE is_complete)),
digested AS (
  SELECT s.repo, l.ord, l.last, s.loaded_at,
         nullif(array_to_string(list_filter(string_split(replace(trim(s.rel_path), '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/'), '') AS rel_path,
         coalesce(nullif(regexp_replace(regexp_replace(lower(s.content_hash), '\s+', '', 'g'), '^sha-?256[:=-]', ''), ''),
                  nullif(regexp_replace(regexp_replace(lower(s.summary_hash), '\s+', '', 'g'), '^sha-?256[:=-]', ''), '')) AS digest
  FROM file_snapshots s JOIN listings l ON s.repo = l.repo AND s.snapshot_no = l.snapshot_no),
state AS (
  SELECT repo, rel_path, ord, any_value(last) AS last,
         (list({'d': digest} ORDER BY loaded_at DESC NULLS LAST, digest DESC NULLS LAST))[1].d AS digest
  FROM digested WHERE rel_path IS NOT NULL GROUP BY repo, rel_path, ord),
later AS (SELECT * FROM state WHERE ord > 1),
earlier AS (SELECT repo, rel_path, ord + 1 AS ord, digest FROM state WHERE ord < last),
joined AS (
  SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.rel_path, o.rel_path) AS rel_path, coalesce(n.ord, o.ord) AS ord,
         CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' WHEN n.digest <> o.digest THEN 'changed' END AS change_kind
  FROM later n FULL OUTER JOIN earlier o ON n.repo = o.repo AND n.rel_path = o.rel_path AND n.ord = o.ord),
changes AS (
  SELECT j.repo, j.rel_path, l.snapshot_no, j.change_kind
  FROM joined j JOIN listings l ON j.repo = l.repo AND j.ord = l.ord WHERE j.change_kind IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_change_counts": p4_change_counts}
ORACLES = {
    "p4_found": _CHANGES + "SELECT repo, rel_path, snapshot_no, change_kind FROM changes",
    "p4_change_counts": _CHANGES + "SELECT repo, snapshot_no, change_kind, count(*) AS n_files FROM changes GROUP BY ALL",
}
