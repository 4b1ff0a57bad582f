"""Secrets packs: leaked credentials in text, drift between environments, exposed files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import mask as M, text as X
from fleetlens.functions.url import basename, dirname
from fleetlens.operators.disk import ignored


@dataclass(frozen=True)
class SecretRule:
    name: str
    pattern: str
    group: int
    severity: str
    confidence: str
    # Every match holds one of these lower-case texts; lines without any are skipped cheaply.
    hints: tuple[str, ...]
    min_entropy: float | None = None

    def possible(self, low: Column) -> Column:
        out = F.lit(False)
        for hint in self.hints:
            out = out | low.contains(hint)
        return out


# Credential patterns. Fixed values.
RULES = (
    SecretRule("aws", r"\b((?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16})\b", 1, "high", "high", ("akia", "asia", "agpa", "aroa")),
    SecretRule("gcp", r"\b(AIza[0-9A-Za-z_-]{35})\b", 1, "high", "high", ("aiza",)),
    SecretRule("stripe", r"\b((?:sk|rk)_live_[0-9a-zA-Z]{16,})\b", 1, "high", "high", ("_live_",)),
    SecretRule("github_pat", r"\b(gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255})\b", 1, "high", "high", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    SecretRule("private_key", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----)", 1, "high", "high", ("private key",)),
    SecretRule("db_url", r"\b((?:mysql|mariadb|postgres(?:ql)?|mongodb(?:\+srv)?|redis|amqp)://[^\s'\"@:/]+:([^\s'\"@]{3,})@[^\s'\"]+)", 2, "high", "high", ("://",)),
    SecretRule("wp_salts", r"define\(\s*['\"]((?:AUTH|SECURE_AUTH|LOGGED_IN|NONCE)_(?:KEY|SALT))['\"]\s*,\s*['\"]([^'\"]{16,})['\"]\s*\)", 2, "medium", "high", ("define",)),
    SecretRule("generic_high_entropy", r"(?i)(?:secret|token|passw(?:or)?d|api[_-]?key|access[_-]?key|auth[_-]?key|credential)[A-Za-z0-9_-]*[\"']?\s*(?:[:=]|=>)\s*[\"']?([A-Za-z0-9+/=_-]{20,})", 1, "medium", "medium",
               ("secret", "token", "passw", "api", "access", "auth", "credential"), 3.8),
)
# Values that are no secrets. Fixed value.
PLACEHOLDER = r"(?i)^(x+|\*+|\.+|your[_-]|changeme|example|placeholder|<.*>$)"
MATCHES = "array<struct<rule:string,severity:string,confidence:string,min_entropy:double,whole:string,secret:string>>"


def scan_lines(lines: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings of (file, line, text, location, commit, seq) lines, whatever their length.

    Plain substring tests drop clean lines before any pattern runs.
    """
    low = F.lower("text")
    hinted = F.lit(False)
    for r in rules:
        hinted = hinted | r.possible(low)
    usable = lines.where(hinted)

    def matches(r: SecretRule) -> Column:
        found = F.zip_with(
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)),
            lambda whole, secret: F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
                F.lit(r.min_entropy).cast("double").alias("min_entropy"), whole.alias("whole"), secret.alias("secret")))
        return F.when(r.possible(low), found).otherwise(F.array().cast(MATCHES))

    per_rule = F.concat(*[matches(r) for r in rules])
    hits = usable.select("file", "line", "location", "commit", "seq", F.inline(per_rule))
    weak = F.col("min_entropy").isNotNull() & (
        F.col("secret").rlike(PLACEHOLDER) | (X.entropy(F.col("secret")) < F.col("min_entropy")))
    preview = F.when(
        F.col("rule") == "private_key", F.lit("private key header, key withheld")
    ).otherwise(M.masked_preview(F.col("whole"), F.col("secret")))
    return hits.where(~weak).select(
        "file", "line", "location", "commit", "seq", "rule", "severity", "confidence", preview.alias("masked"),
        M.mask(F.col("secret")).alias("masked_secret"), M.fingerprint(F.col("secret")).alias("fingerprint"))


def file_lines(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Lines of the (file, text) worth scanning: not ignored, no *.example, no binaries."""
    ok = (~ignored(F.col("file"), ignore) & ~F.col("file").endswith(".example")
          & ~F.col("text").contains("\u0000"))
    return files.where(ok).select(
        "file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "text")
    ).select("file", (F.col("pos") + 1).alias("line"), "text", F.lit("worktree").alias("location"),
             F.lit(None).cast("string").alias("commit"), (F.col("pos") + 1).cast("bigint").alias("seq"))


def without_allowed(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop allowlisted secrets; `allowed` holds lines: a sha256, a literal value, or a # comment."""
    line = F.trim("line")
    hashes = allowed.where((line != "") & ~line.startswith("#")).select(
        F.when(line.rlike(r"(?i)^[0-9a-f]{64}$"), F.lower(line)).otherwise(M.fingerprint(line)).alias("fingerprint")).distinct()
    return findings.join(hashes, "fingerprint", "left_anti")


def merge_locations(findings: DataFrame) -> DataFrame:
    """One row per (file, rule, fingerprint): where it was seen, its live line and its first commit."""
    live = F.col("location") == "worktree"
    return findings.groupBy("file", "rule", "fingerprint").agg(
        F.when(F.count_distinct("location") > 1, "both").otherwise(F.min("location")).alias("location"),
        F.coalesce(F.max(F.when(live, F.col("line"))), F.min_by("line", "seq")).alias("line"),
        F.min_by("commit", F.when(F.col("commit").isNotNull(), F.col("seq"))).alias("commit"),
        F.first("severity").alias("severity"), F.first("confidence").alias("confidence"),
        F.min("masked").alias("masked"))


def env_drift(values: DataFrame, envs: list[str], shapes: bool = True) -> DataFrame:
    """missing_key and shape_mismatch findings of (env, key, value) rows over the declared environments.

    One grouped row per key carries at most one shape per environment.
    """
    per_key = values.groupBy("key", "env").agg(F.max_by(X.value_shape(F.col("value")), "seq").alias("shape")).groupBy("key").agg(
        F.array_sort(F.collect_list("env")).alias("present"),
        F.array_sort(F.collect_list(F.concat_ws("=", "env", "shape"))).alias("shapes"),
        F.count_distinct("shape").alias("n_shapes"))
    missing = F.array_except(F.array(*[F.lit(e) for e in sorted(envs)]), F.col("present"))
    differs = F.lit(shapes) & (F.col("n_shapes") > 1)
    hits = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.struct(F.lit("missing_key").alias("rule"), F.array_join(missing, ",").alias("detail"))),
        F.when(differs, F.struct(F.lit("shape_mismatch").alias("rule"), F.array_join("shapes", ",").alias("detail")))))
    return per_key.select("key", F.explode(hits).alias("f")).select("key", "f.rule", "f.detail")


def exposed_probes(probes: DataFrame) -> DataFrame:
    """Verdict of probed config paths (url, status, body) that answered 200."""
    config = X.looks_like_config(F.col("body"))
    return probes.where("status = 200").select(
        "url", F.when(config, "exposed_config").otherwise("reachable_path").alias("rule"),
        F.when(config, "high").otherwise("low").alias("severity"))


def sensitive_files(files: DataFrame) -> DataFrame:
    """Tracked environment files, private keys, and config files that have an example beside them."""
    name = F.lower(basename(F.col("path")))
    env = (name == ".env") | (name.startswith(".env.") & (name != ".env.example"))
    key = name.endswith(".pem") | name.endswith(".key")
    hits = F.array_compact(F.array(F.when(env, F.lit("environment_file")), F.when(key, F.lit("private_key"))))
    direct = files.select("path", F.explode(hits).alias("rule"))
    folder = dirname(F.col("path"))
    examples = files.where(basename(F.col("path")) == "config.example.yml").select(folder.alias("dir")).distinct()
    paired = files.where(name == "config.yml").withColumn("dir", folder).join(examples, "dir", "left_semi")
    return direct.unionByName(paired.select("path", F.lit("config_with_example").alias("rule")))
