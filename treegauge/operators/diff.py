"""Changed files between two versions of file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treegauge.operators.classify import is_excluded, tech_stack
from treegauge.operators.path_filter import maybe_of_paths
from treegauge.operators.renames import KEY, exact_pairs, similar_pairs
from treegauge.session import cut_lineage
from treegauge.specs import DIFF, ScanRules

CHANGE_COLUMNS = [
    "scan_id",
    "scan_mode",
    "file_path",
    "change_type",
    "old_file_path",
    "tech_stack",
    "content",
    "old_content",
]


def _digests(files: DataFrame, name: str) -> DataFrame:
    """Path and content digest only. A stored content_hash column spares reading the content; bytes count where they are kept."""
    if "content_hash" in files.columns:
        digest = F.col("content_hash")
    else:
        digest = F.md5("raw" if "raw" in files.columns else "content")
    return files.select(*KEY, digest.alias(name), F.lit(True).alias(f"{name}_present"))


def changed_paths(base: DataFrame, target: DataFrame) -> DataFrame:
    """Added, deleted and modified paths with both digests.

    Only paths and digests are shuffled. Undecodable files are compared by their content_hash, or by the bytes in a
    column `raw`; without either, a file that cannot be decoded differs from any that can and equals any that cannot.
    """
    joined = _digests(base, "old_digest").join(_digests(target, "new_digest"), KEY, "full_outer")
    in_base, in_target = F.col("old_digest_present"), F.col("new_digest_present")
    same = F.col("old_digest").eqNullSafe(F.col("new_digest"))
    change = F.when(in_base.isNull(), "A").when(in_target.isNull(), "D").when(~same, "M")
    return joined.select(*KEY, "old_digest", "new_digest", change.alias("change_type")).where(
        F.col("change_type").isNotNull()
    )


def pair_renames(
    changed: DataFrame, base: DataFrame, target: DataFrame, renames: str | None
) -> DataFrame:
    """Changed paths with old_file_path: deleted and added files that pair up become one M row."""
    old_path = F.when(F.col("change_type") == "D", F.col("file_path"))
    if renames is None:
        return changed.select(*KEY, "change_type", old_path.alias("old_file_path"))
    if renames not in ("exact", "similar"):
        raise ValueError(f"renames is None, 'exact' or 'similar', not {renames!r}")
    pairs = exact_pairs(changed)
    if renames == "similar":
        near = similar_pairs(_without(changed, pairs), base, target)
        pairs = pairs.select("project", "old_path", "new_path").unionByName(near)
    renamed = pairs.select(
        "project", F.col("new_path").alias("file_path"), F.lit("M").alias("change_type"),
        F.col("old_path").alias("old_file_path"),
    )
    rest = _without(changed, pairs).select(
        *KEY, "change_type", old_path.alias("old_file_path")
    )
    return rest.unionByName(renamed)


def _without(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed paths that take part in no pair."""
    used = pairs.select(
        "project",
        F.inline(
            F.array(
                F.struct(F.col("old_path").alias("file_path"), F.lit("D").alias("change_type")),
                F.struct(F.col("new_path").alias("file_path"), F.lit("A").alias("change_type")),
            )
        ),
    )
    return changed.join(used, [*KEY, "change_type"], "left_anti")


def version_diff(
    base: DataFrame,
    target: DataFrame,
    rules: ScanRules,
    scan_id: int | Column,
    renames: str | None = None,
) -> DataFrame:
    """File changes from base to target, one row per added, modified, deleted or renamed file.

    Both trees are read twice: once for digests, and once for the content of the changed paths.
    Paths and digests are checkpointed in between, so pairing never reads a tree again. A Bloom filter of the changed paths
    drops other files inside both content scans, at any number of changes. The tech
    stack of both sides is that of the final path.
    """
    changed = changed_paths(base, target)
    if renames is not None:
        changed = cut_lineage(changed)
    changes = pair_renames(changed, base, target, renames)
    kept = cut_lineage(
        changes.where(~is_excluded(F.col("file_path"), rules)).withColumn(
            "_old_path", F.coalesce("old_file_path", "file_path")
        )
    )
    new = maybe_of_paths(target.select(*KEY, "content"), kept.where("change_type <> 'D'"), KEY)
    old = maybe_of_paths(
        base.select(*KEY, F.col("content").alias("old_content")),
        kept.where("change_type <> 'A'").select("project", F.col("_old_path").alias("file_path")), KEY,
    ).withColumnRenamed("file_path", "_old_path")
    return (
        kept.join(new.hint("merge"), KEY, "left")
        .join(old.hint("merge"), ["project", "_old_path"], "left")
        .withColumn("scan_id", F.lit(scan_id) if isinstance(scan_id, int) else scan_id)
        .withColumn("scan_mode", F.lit(DIFF))
        .withColumn("tech_stack", tech_stack(F.col("file_path"), rules))
        .select(*CHANGE_COLUMNS)
    )
