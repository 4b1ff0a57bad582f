"""Masking and redaction."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

REDACTED = "[REDACTED]"


def mask(secret: Column) -> Column:
    n = F.length(secret)
    return (
        F.when(n <= 8, F.lit("****"))
        .when(n <= 14, F.concat(F.substring(secret, 1, 2), F.lit("****"), F.right(secret, F.lit(2))))
        .otherwise(F.concat(F.substring(secret, 1, 3), F.lit("****"), F.right(secret, F.lit(4))))
    )


def masked_preview(matched: Column, secret: Column) -> Column:
    """The match with its secret masked; longer than 120 characters is cut to 117 plus dots."""
    preview = F.replace(matched, secret, mask(secret))
    cut = F.when(
        F.length(preview) > 120, F.concat(F.substring(preview, 1, 117), F.lit("..."))
    ).otherwise(preview)
    usable = (secret != "") & matched.contains(secret)
    return F.when(usable, cut).otherwise(mask(matched))


def fingerprint(secret: Column) -> Column:
    return F.sha2(secret, 256)


def redact_userinfo(text: Column) -> Column:
    """scheme://user:password@host -> scheme://[REDACTED]@host"""
    return F.regexp_replace(text, r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", r"$1\[REDACTED\]@")


# Names whose value is always hidden. Fixed values.
SENSITIVE_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|auth|credential|private[_-]?key)"


def redact_flags(command: Column) -> Column:
    """--password=x, --token x and NAME=x pairs of a command line lose their value."""
    name = r"(?:password|passwd|pass|secret|token|api[_-]?key|auth|credential|key)"
    out = F.regexp_replace(
        command, rf"(?i)(--?[a-z0-9_-]*{name}[a-z0-9_-]*)(=|\s+)(\"[^\"]*\"|'[^']*'|[^\s\"'-]\S*)",
        r"$1$2\[REDACTED\]",
    )
    return F.regexp_replace(
        out, rf"(?i)\b([a-z0-9_]*{name}[a-z0-9_]*)=(\"[^\"]*\"|'[^']*'|[^\s\"'\[]\S*)", r"$1=\[REDACTED\]"
    )


def redact_text(text: Column) -> Column:
    return redact_flags(redact_userinfo(text))


def redact_map(m: Column) -> Column:
    """Values under sensitive keys are replaced, all others keep their text."""
    return F.transform_values(
        m, lambda k, v: F.when(k.rlike(SENSITIVE_NAME), F.lit(REDACTED)).otherwise(v)
    )


def redact_known(text: Column, secrets: list[str]) -> Column:
    """Known secret values (three characters or more) replaced, longest first."""
    for secret in sorted((s for s in secrets if len(s) >= 3), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


# Names whose string value is hidden in result records. Fixed values.
HIDDEN_NAME = r"(?i)(password|secret|token|key|auth|pass|pwd)"
#: A JSON text falls into string literals (with the colon, if they are names) and what stands between; an open literal goes to the end.
#: Nothing is given back, so a text of any length and depth is cut in linear time and without a stack.
JSON_TOKEN = r'(?s)"(?:[^"\\]++|\\(?:.|\z))*+(?:"(?:\s*+:\s*+)?|\z)|[^"]++'
JSON_NAME = r'"\s*:\s*\z'


def redact_json(text: Column, secrets: Sequence[str] = (), hidden: str = HIDDEN_NAME) -> Column:
    """A JSON text with its secrets hidden at any depth; all else stays as written, order, repeated names and blanks included.

    A string value of a hidden name becomes [REDACTED]; other strings lose known
    secrets (three characters or more) and the password of scheme://user:password@.
    Numbers, objects and arrays below a hidden name are not hidden as a whole, their
    strings are judged by their own name. Broken JSON is treated alike, literal by
    literal. Null gives null.
    """
    known = sorted({json.dumps(x, ensure_ascii=a)[1:-1] for x in secrets if len(x) >= 3 for a in (True, False)}, key=lambda x: (-len(x), x))

    def name(token: Column) -> Column:
        literal = F.regexp_replace(token, r"\s*:\s*\z", "")
        return F.when(token.contains("\\"), F.get_json_object(F.concat(F.lit('{"k":'), literal, F.lit("}")), "$.k")).otherwise(literal)

    def clean(token: Column) -> Column:
        for secret in known:
            token = F.replace(token, F.lit(secret), F.lit(REDACTED))
        return F.regexp_replace(token, r'([a-zA-Z][a-zA-Z0-9+.-]*+:(?:\\?/){2}[^\s/@:"\\]++:)[^\s/@"\\]++@', r"$1\[REDACTED\]@")

    def rebuilt(tokens: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            before = F.get(tokens, i - 1)
            value = token.startswith('"') & ~token.rlike(JSON_NAME)
            hides = F.coalesce(before.startswith('"') & before.rlike(JSON_NAME) & name(before).rlike(hidden), F.lit(False))
            return F.when(value & hides, F.lit(f'"{REDACTED}"')).when(value, clean(token)).otherwise(token)

        return F.array_join(F.transform(tokens, one), "")

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0))), rebuilt)[0]
