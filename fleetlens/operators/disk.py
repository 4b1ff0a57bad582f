"""File listings: cumulative directory sizes and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.url import ancestors, basename
from fleetlens.session import staged


def last_per_path(entries: DataFrame) -> DataFrame:
    """The last entry by `seq` of each path; backslashes are slashes."""
    cols = [c for c in entries.columns if c not in ("path", "seq")]
    return staged(
        entries.withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
        .groupBy("path").agg(F.max_by(F.struct(*cols), "seq").alias("_e"))
        .select("path", "_e.*"), "listing")


def cumulative_sizes(entries: DataFrame) -> DataFrame:
    """Total size below every directory.

    Sizes first collapse to the parent directory, so what is exploded over the
    ancestors is one row per directory, not one per file; partial sums then
    absorb a root that collects everything.
    """
    files = entries.where((F.col("type") != "dir") & F.col("error").isNull())
    per_dir = (
        files.select(ancestors(F.col("path")).alias("a"), F.coalesce("size", F.lit(0)).alias("size"))
        .groupBy("a").agg(F.sum("size").alias("size"))
        .select(F.explode("a").alias("path"), "size")
    )
    seeds = entries.where(F.col("type") == "dir").select("path", F.lit(0).cast("bigint").alias("size"))
    spark = entries.sparkSession
    root = spark.createDataFrame([(".", 0)], "path string, size bigint")
    return per_dir.unionByName(seeds).unionByName(root).groupBy("path").agg(F.sum("size").alias("size"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per path of either snapshot: type, status, sizes, change; '.' is left out."""
    def sized(entries: DataFrame, side: str) -> DataFrame:
        dirs = cumulative_sizes(entries).withColumnRenamed("size", "_cum")
        return entries.join(dirs, "path", "left").select(
            "path",
            F.struct(F.col("type"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("_cum", F.lit(0)).alias("cum"),
                     F.col("mtime")).alias(side),
        )

    both = sized(before, "a").join(sized(after, "b"), "path", "full_outer").where(F.col("path") != ".")
    is_dir = (F.coalesce(F.col("a.type") == "dir", F.lit(False))
              | F.coalesce(F.col("b.type") == "dir", F.lit(False)))
    one_sided = F.coalesce("a.type", "b.type")
    special = (F.col("a").isNull() | F.col("b").isNull()) & one_sided.isin("symlink", "other")
    kind = F.when(special, one_sided).when(is_dir, "dir").otherwise("file")

    def size(side: str) -> Column:
        return F.coalesce(F.when(is_dir, F.col(f"{side}.cum")).otherwise(F.col(f"{side}.size")), F.lit(0))

    change = size("b") - size("a")
    touched = ~is_dir & ~F.col("a.mtime").eqNullSafe(F.col("b.mtime"))
    status = (
        F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "DELETED")
        .when(change > 0, "GROWN").when(change < 0, "SHRUNK")
        .when(touched, "MODIFIED_MTIME").otherwise("UNCHANGED")
    )
    return both.select(
        "path", kind.alias("type"), status.alias("status"), size("a").alias("size_s1"),
        size("b").alias("size_s2"), change.alias("change"),
        F.col("a.mtime").alias("mtime_s1"), F.col("b.mtime").alias("mtime_s2"),
    )


def top_changes(diff: DataFrame, status: str, n: int, dirs: bool) -> DataFrame:
    """The n largest changes of one status among directories or files."""
    kind = (F.col("type") == "dir") if dirs else (F.col("type") != "dir")
    return diff.where((F.col("status") == status) & kind).orderBy(
        F.desc(F.abs("change")), "path"
    ).limit(n)


def _glob(pattern: str, star: str) -> str:
    out = ""
    for ch in pattern:
        out += star if ch == "*" else (star[:-1] if ch == "?" else ("\\" + ch if ch in r".+^${}()|[]\\" else ch))
    return f"^{out}$"


def _segment_matches(path: Column, rx: str) -> Column:
    return F.exists(F.split(path, "/"), lambda s: (s != "") & s.rlike(rx))


def excluded(path: Column, paths: list[str] = (), globs: list[str] = (), root: str | None = None) -> Column:
    """Is the path below an excluded path, or does a glob match its name, itself or one of its segments?"""
    hit = F.lit(False)
    for p in paths:
        base = p.rstrip("/")
        hit = hit | (path == base) | path.startswith(base + "/")
    for g in globs:
        rx = _glob(g, ".*")
        hit = hit | path.rlike(rx) | _segment_matches(path, rx)
        if root:
            relative = F.regexp_replace(path, "^" + _glob(root.rstrip("/"), ".*")[1:-1] + "/?", "")
            hit = hit | relative.rlike(rx)
    return hit


DEFAULT_IGNORED = (".git", "node_modules", "report")


def ignored(path: Column, patterns: list[str] = ()) -> Column:
    """Segment names, path prefixes (patterns with '/') and globs that stay inside one segment."""
    hit = F.lit(False)
    for p in dict.fromkeys([*DEFAULT_IGNORED, *patterns]):
        if "*" in p or "?" in p:
            rx = _glob(p, "[^/]*")
            hit = hit | path.rlike(rx) | basename(path).rlike(rx)
        elif "/" in p:
            pre = p.rstrip("/")
            hit = hit | (path == pre) | path.startswith(pre + "/")
        else:
            hit = hit | F.array_contains(F.split(path, "/"), p)
    return hit
