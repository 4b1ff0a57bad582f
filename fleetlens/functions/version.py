"""Version strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetlens.functions.url import let


def numbers(version: Column) -> Column:
    """Every digit run as bigint; a missing version is [0]."""
    runs = F.transform(
        F.regexp_extract_all(F.coalesce(version, F.lit("")), F.lit(r"\d+"), F.lit(0)),
        lambda d: d.cast("bigint"),
    )
    return let(runs, lambda r: F.when(F.size(r) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(r))


def _padded(nums: Column, width: Column) -> Column:
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(width - F.size(nums), F.lit(0)))
    return F.concat(nums, zeros)


def _padded_less(x: Column, y: Column) -> Column:
    def compare(pair: Column) -> Column:
        width = F.greatest(F.size(pair["x"]), F.size(pair["y"]))
        return _padded(pair["x"], width) < _padded(pair["y"], width)

    return let(F.struct(x.alias("x"), y.alias("y")), compare)


def less_than(a: Column, b: Column) -> Column:
    """Numeric comparison of all digit runs, the shorter one padded with zeros."""
    return _padded_less(numbers(a), numbers(b))


SEMVER = r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[.\-+].*)?$"


def semver(version: Column) -> Column:
    """array<bigint> of major, minor, patch; null when the text is not a version."""
    text = F.regexp_replace(F.trim(version), r"(?i)^v", "")
    part = lambda i: F.coalesce(
        F.regexp_extract(text, SEMVER, i).try_cast("bigint"), F.lit(0).cast("bigint")
    )
    return F.when(text.rlike(SEMVER), F.array(part(1), part(2), part(3)))


def split_numbers(version: Column) -> Column:
    """Leading integer of each part between dots and dashes; other parts count as 0."""
    return F.transform(
        F.split(F.coalesce(version, F.lit("")), r"[.-]"),
        lambda p: F.coalesce(
            F.regexp_extract(p, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")
        ),
    )


def older_than(a: Column, b: Column) -> Column:
    """Part-wise comparison of split_numbers, the shorter side padded with zeros."""
    return _padded_less(split_numbers(a), split_numbers(b))


def jump(current: Column, latest: Column) -> Column:
    """major / minor / patch / none / unknown; a current version ahead of latest is none."""
    def classify(pair: Column) -> Column:
        c, n = pair["c"], pair["n"]
        return (
            F.when(c.isNull() | n.isNull(), "unknown")
            .when(c >= n, "none")
            .when(n[0] > c[0], "major")
            .when(n[1] > c[1], "minor")
            .otherwise("patch")
        )

    return let(F.struct(semver(current).alias("c"), semver(latest).alias("n")), classify)
