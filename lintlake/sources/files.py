"""File tables: reading folders, manifests, suppressions, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions.scalars import extname, trimmed
from lintlake.functions.text import count_of, found, lines_of
from lintlake.operators.detect import IGNORED_DIRS, SOURCE_EXTS, c, scope, union_all
from lintlake.session import cut_lineage

# --- Fixed values -----------------------------------------------------------------
SNAPSHOT_VERSION = r"<version>([^<]*-SNAPSHOT[^<]*)</version>"
MANIFEST_DDL = "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, scripts MAP<STRING,STRING>"
PLAYWRIGHT_CONFIGS = ["playwright.config.ts", "playwright.config.js", "playwright.config.mjs"]
# ------------------------------------------------------------------------------------


ENTRY = "path string, name string, bytes long, folder boolean"
READ = "path string, content string, error string"


def _entries(batches):
    """What the folders of each batch hold, through any file system that Arrow opens."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, place = fs.FileSystem.from_uri(folder)
            prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
            found = system.get_file_info(fs.FileSelector(place))
            yield pa.record_batch(
                [
                    pa.array([prefix + i.path for i in found], pa.string()), pa.array([i.base_name for i in found], pa.string()),
                    pa.array([i.size or 0 for i in found], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
                ],
                ["path", "name", "bytes", "folder"],
            )


def list_files(spark: SparkSession, root: str, dot: bool = False, ignore_dirs=()) -> DataFrame:
    """``(path, bytes)`` of every file below ``root``, hidden names included; ignored folders are never opened.

    Folders are listed in tasks, one level of the tree after the other.
    """
    skipped = [*IGNORED_DIRS, *ignore_dirs]
    schema = T._parse_datatype_string("path string, bytes long")
    files, level = [spark.createDataFrame([], schema)], spark.createDataFrame([(root.rstrip("/"),)], "path string")
    while not level.isEmpty():
        found = cut_lineage(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_entries, ENTRY))
        files.append(found.where(~c.folder).select("path", "bytes"))
        inner = found.where(c.folder & ~c.name.isin(skipped))
        level = (inner if dot else inner.where(~F.startswith("name", F.lit(".")))).select("path")
    return union_all(files)


def _contents(batches):
    """The text of each file, or why there is none."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for path in batch.column(0).to_pylist():
            text, error = None, None
            try:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place) as stream:
                    text = stream.readall().decode("utf-8")
            except UnicodeDecodeError:
                error = "not UTF-8"
            except OSError as problem:
                error = type(problem).__name__
            yield pa.record_batch([pa.array([path], pa.string()), pa.array([text], pa.string()), pa.array([error], pa.string())], ["path", "content", "error"])


def read_checked_files(
    spark: SparkSession, root: str, repo_depth: int = 1, dot: bool = False, exts=None, ignore_dirs=()
) -> DataFrame:
    """Files below ``root`` as ``(repo, path, ext, content, error)``; a file without readable text has an error.

    The first ``repo_depth`` folders below ``root`` name the repository. Paths are filtered before any
    content is read.
    """
    parts = F.split(F.substr("path", F.lit(len(root.rstrip("/")) + 2)), "/")
    listed = list_files(spark, root, dot, ignore_dirs).select(
        c.path.alias("full"),
        F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"),
        F.array_join(F.slice(parts, repo_depth + 1, F.size(parts)), "/").alias("path"),
    )
    wanted = cut_lineage(scope(listed.withColumn("ext", extname(c.path)), exts, dot=dot, ignore_dirs=ignore_dirs))
    read = wanted.select("full").repartition("full").mapInArrow(_contents, READ).withColumnRenamed("path", "full")
    return wanted.join(read, "full").select("repo", "path", "ext", "content", "error")


def read_all_files(spark: SparkSession, root: str, repo_depth: int = 1, dot: bool = False) -> DataFrame:
    """Every text file below ``root`` as ``(repo, path, ext, content)``; dotfiles only with ``dot``."""
    return read_checked_files(spark, root, repo_depth, dot).where(c.error.isNull()).drop("error")


def read_files(
    spark: SparkSession, root: str, exts=tuple(SOURCE_EXTS), ignore_dirs=(), repo_depth: int = 1
) -> DataFrame:
    """Source files below ``root``, by extension."""
    return read_checked_files(spark, root, repo_depth, False, exts, ignore_dirs).where(c.error.isNull()).drop("error")


def parsed_manifests(files: DataFrame) -> DataFrame:
    """The package.json in the root of each repository, with its three maps."""
    return (
        files.where(c.path == "package.json")
        .select("repo", F.from_json("content", MANIFEST_DDL).alias("m"))
        .select("repo", "m.*")
    )


def dependency_entries() -> Column:
    """All dependencies as ``array<struct<name, version>>``: dev versions win, first place stays."""
    none = F.create_map().cast("map<string,string>")
    deps, dev = F.coalesce("dependencies", none), F.coalesce("devDependencies", none)
    names = F.array_distinct(F.concat(F.map_keys(deps), F.map_keys(dev)))
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"), F.coalesce(F.try_element_at(dev, n), F.try_element_at(deps, n)).alias("version")
        ),
    )


def manifest_dependencies(files: DataFrame) -> DataFrame:
    return (
        parsed_manifests(files)
        .select("repo", F.explode(dependency_entries()).alias("d"))
        .select("repo", "d.name", "d.version")
    )


def pom_facts(files: DataFrame) -> DataFrame:
    return files.where(c.path == "pom.xml").select(
        "repo",
        count_of(c.content, "<dependency>").alias("dependencies"),
        found(c.content, SNAPSHOT_VERSION, 1).alias("snapshots"),
    )


def ignore_rules(files: DataFrame, name: str) -> DataFrame:
    """Suppressions ``(repo, rule, file)`` from the ignore file in each repository's root.

    One per line: ``rule``, ``rule:path fragment``; ``*`` is any rule or file, ``#`` starts
    a comment line.
    """
    lines = files.where(c.path == name).select("repo", F.explode(lines_of(c.content)).alias("l"))
    entry = lines.select("repo", trimmed(c.l).alias("l")).where((c.l != "") & ~F.startswith("l", F.lit("#")))
    colon = F.instr("l", ":")
    fragment = trimmed(F.substr("l", colon + 1))
    return entry.select(
        "repo",
        F.when(colon == 0, c.l).otherwise(trimmed(F.substr("l", F.lit(1), colon - 1))).alias("rule"),
        F.when((colon == 0) | (fragment == ""), F.lit("*")).otherwise(fragment).alias("file"),
    )


def detect_profiles(files: DataFrame) -> DataFrame:
    """Stack profile of each repository, from signal files in its root."""

    def present(*names: str) -> Column:
        return F.max(c.path.isin(list(names)))

    flags = files.groupBy("repo").agg(
        present("pom.xml", "build.gradle").alias("java"),
        present("angular.json").alias("angular"),
        present(*PLAYWRIGHT_CONFIGS).alias("playwright"),
        present("tsconfig.json").alias("typescript"),
    )
    profile = (
        F.when(c.java & c.angular & c.playwright, F.lit("java-angular-playwright"))
        .when(c.java, F.lit("java-backend"))
        .when(c.angular, F.lit("angular-frontend"))
        .when(c.typescript, F.lit("typescript-node"))
        .otherwise(F.lit("generic"))
    )
    return flags.select("repo", profile.alias("profile"))
