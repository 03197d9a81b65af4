"""What changed between two snapshots of files, by a tree of digests.

A folder's digest is a sum over the files below it, so it comes from one aggregation that is combined before its
shuffle, and equal folders are skipped by one comparison. Only files that lie directly in a folder whose own files
differ are compared one by one; contents are digested where they are read and never shuffled.

``repo`` and ``path`` name a file; a path that a snapshot holds twice counts with both contents. A null content has a
digest of its own, other than the empty one. An empty snapshot makes every file of the other one added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.detect import c
from lintlake.operators.findings import scope_to_changed

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def file_digests(files: DataFrame) -> DataFrame:
    """``(repo, folder, path, digest)`` of every file; this small table is what an earlier run has to keep."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    digest = F.coalesce(F.sha2("content", 256), F.lit("null"))
    return files.select("repo", folder.alias("folder"), "path", digest.alias("digest"))


def _digests() -> list[Column]:
    """128 bits for a set of files, whatever their order."""
    return [F.sum(F.xxhash64(*pair).cast("decimal(20,0)")).alias(name) for name, pair in (("d1", ("path", "digest")), ("d2", ("digest", "path")))]


def digest_tree(digests: DataFrame) -> DataFrame:
    """``(repo, folder, files, d1, d2)`` of every folder with all that lies below it; the root's name is empty."""
    parts = F.split("folder", "/")
    depth = F.when(c.folder == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = digests.select("repo", "path", "digest", F.explode(above).alias("folder"))
    return every.groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("files"), *_digests())


def _differing(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks, with the values of both sides."""
    a = old.select(*key, F.struct(*values).alias("old"))
    b = new.select(*key, F.struct(*values).alias("new"))
    return a.join(b, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def _kind() -> Column:
    return F.when(c.old.isNull(), ADDED).when(c.new.isNull(), REMOVED).otherwise(CHANGED)


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(repo, folder, change, files_before, files_after)`` of the folders that differ, from two digest trees."""
    differ = _differing(old, new, ["repo", "folder"], ["files", "d1", "d2"])
    return differ.select(
        "repo", "folder", _kind().alias("change"),
        F.coalesce(c.old["files"], F.lit(0)).alias("files_before"), F.coalesce(c.new["files"], F.lit(0)).alias("files_after"),
    )


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(repo, path, change)`` of the files that differ, from two tables of file digests."""
    own = [side.groupBy("repo", "folder").agg(*_digests()) for side in (old, new)]
    folders = _differing(*own, ["repo", "folder"], ["d1", "d2"]).select("repo", "folder")
    files = [
        side.join(folders, ["repo", "folder"], "left_semi").groupBy("repo", "path").agg(F.array_sort(F.collect_list("digest")).alias("digests"))
        for side in (old, new)
    ]
    return _differing(*files, ["repo", "path"], ["digests"]).select("repo", "path", _kind().alias("change"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """The files of ``after`` that are new or differ from ``before``: what a check of a change looks at."""
    paths = changed_paths(file_digests(before), file_digests(after))
    return scope_to_changed(after, paths.where(c.change != REMOVED))
