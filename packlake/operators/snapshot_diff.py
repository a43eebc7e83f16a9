"""What changed between full snapshots of a table (problem 4).

Method: full outer join on the primary key comparing canonical row hashes. A missing earlier side is
an addition, a missing later side a removal, unequal hashes a change.

Defined results for odd input: rows without a path (null, blank, or nothing but ``.`` segments), without a
repository or without a snapshot number are no records; a listing that the log calls incomplete, or
that the log does not name, is no snapshot; a complete listing without rows counts and removes all;
of several rows of a path in a snapshot the one loaded last stands (null ``loaded_at`` is earliest, and
among equal times a row with a digest wins, then the greatest digest), so repeated rows change nothing; where
neither ``content_hash`` nor ``summary_hash`` is there the digest is unknown, and an unknown digest is
never evidence of a change. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def plain_path(path: Column) -> Column:
    """The plain relative path: single ``/``, no ``.`` segments, no leading or closing slash; null if nothing is left."""
    slashed = F.regexp_replace(F.trim(path), r"\\", "/")
    kept = F.regexp_replace(slashed, r"(^|/)(\./|/)+", "$1")
    # a leading slash or "./" run can survive one pass at the start, and a closing "/." at the end
    kept = F.regexp_replace(kept, r"^(\./|/)+", "")
    kept = F.regexp_replace(kept, r"(/\.?)+$", "")
    return F.when((kept != "") & (kept != "."), kept)


def canonical_digest(value: Column) -> Column:
    """A digest in one notation, as binary: case, blanks, an algorithm prefix and separators do not count; blank is null."""
    text = F.regexp_replace(F.lower(value), r"[\s]+", "")
    text = F.regexp_replace(text, r"^(sha-?256|sha256sum)[:=\-]|^0x", "")
    return F.when(text != "", F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text)).otherwise(F.unhex(F.sha2(text, 256))))


def complete_listings(log: DataFrame) -> DataFrame:
    """(repo, snapshot_no, ord, next_no): the complete listings of each repository numbered without gaps, with the number of the one that follows."""
    complete = log.where(F.col("is_complete") & F.col("repo").isNotNull() & F.col("snapshot_no").isNotNull())
    complete = complete.select("repo", "snapshot_no").distinct()
    in_order = Window.partitionBy("repo").orderBy("snapshot_no")
    return complete.select("repo", "snapshot_no", F.row_number().over(in_order).alias("ord"), F.lead("snapshot_no").over(in_order).alias("next_no"))


def snapshot_state(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(repo, rel_path, ord, digest, listing): one row per path and complete listing, with the canonical hash of the row that stands for the path.

    What is known of the listing stays one column, so that both sides of the join below read the very same aggregate and its shuffle is done once.
    """
    digest = F.coalesce(canonical_digest(F.col("content_hash")), canonical_digest(F.col("summary_hash")))
    slim = rows.select("repo", "snapshot_no", plain_path(F.col("rel_path")).alias("rel_path"), F.struct("loaded_at", digest.alias("digest")).alias("version"))
    slim = slim.where(F.col("rel_path").isNotNull())
    slim = slim.join(complete_listings(log), ["repo", "snapshot_no"])  # a few rows per repository; the planner picks the join by size
    return slim.groupBy("repo", "rel_path", "ord").agg(
        F.max("version")["digest"].alias("digest"), F.first(F.struct("ord", "snapshot_no", "next_no")).alias("listing")
    )


def snapshot_changes(rows: DataFrame, log: DataFrame) -> DataFrame:
    """(repo, rel_path, snapshot_no, change_kind) of every difference between consecutive complete listings.

    The later side is keyed by its number, the earlier side by its number plus one, so one full outer join
    compares all pairs of all repositories at once; the first listing has no earlier one and the side after the
    last one has no later, so both are cut before the join. Either side knows the later listing's number, so no join follows.
    A hot repository spreads over all tasks since the path is part of the key.
    """
    state = snapshot_state(rows, log)
    later = state.where("listing.ord > 1").select("repo", "rel_path", "ord", F.col("digest").alias("new_digest"), F.col("listing.snapshot_no").alias("new_no"))
    earlier = state.where("listing.next_no IS NOT NULL").select("repo", "rel_path", (F.col("ord") + 1).alias("ord"), F.col("digest").alias("old_digest"), F.col("listing.next_no").alias("old_no"))
    joined = later.join(earlier, ["repo", "rel_path", "ord"], "full_outer")
    kind = (
        F.when(F.col("old_no").isNull(), "added")
        .when(F.col("new_no").isNull(), "removed")
        .when(F.col("new_digest") != F.col("old_digest"), "changed")
    )
    found = joined.select("repo", "rel_path", F.coalesce("new_no", "old_no").alias("snapshot_no"), kind.alias("change_kind"))
    return found.where(F.col("change_kind").isNotNull())


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per repository, listing and kind."""
    return changes.groupBy("repo", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_files"))
