"""Fixed schemas shared by sources, packs and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


FINDING = struct(
    pack=_S, rule=_S, entity_type=_S, entity_id=_S, severity=_S, score=_I, confidence=_S,
    message=_S, before=_S, after=_S, location=_S, fix=_S, attrs=T.MapType(_S, _S),
)
PAGE = struct(
    url=_S, title=_S, meta_desc=_S, date=_S, headings=T.ArrayType(_S), content=_S,
    links=T.ArrayType(_S), slug=_S,
)
CRAWL_FIELDS = (
    "status", "title", "description", "canonical", "robots", "language", "H1",
    "schema_types", "content_fingerprint",
)
CRAWL = struct(url=_S, **{name: _S for name in CRAWL_FIELDS})
VISITED = struct(
    url=_S, status=_I, depth=_I, content_type=_S, bytes=_L, hash=_S, redirect_to=_S,
    timestamp=_D, body=_S,
)
REDIRECT = struct(
    source=_S, target=_S, status=_I, classification=_S, strategy=_S, notes=_S, required=_B,
)
FILE_ENTRY = struct(path=_S, type=_S, size=_L, mtime=_D, error=_S)
STATEMENT = struct(
    time=_S, user_host=_S, query_ms=_D, lock_ms=_D, rows_sent=_L, rows_examined=_L, sql=_S,
)
PERF_DIGEST = struct(
    DIGEST_TEXT=_S, COUNT_STAR=_L, SUM_TIMER_WAIT=_D, SUM_ROWS_EXAMINED=_L, SUM_ROWS_SENT=_L,
    QUANTILE_95=_D,
)
PROBE_RUN = struct(
    ts=_L,
    results=T.ArrayType(struct(
        target=_S, host=_S, status=_S,
        checks=T.MapType(_S, struct(status=_S, days_left=_I, issues=T.ArrayType(_S))),
    )),
    alerts=T.ArrayType(struct(key=_S, ts=_L, host=_S, severity=_S, message=_S)),
)
RESPONSE = struct(
    path=_S, status=_I, headers=T.MapType(_S, _S), body=_S, durationMs=_D, timedOut=_B, error=_S,
)
EXTENSION = struct(
    name=_S, status=_S, update=_S, version=_S, update_version=_S, auto_update=_S,
)
ENVELOPE = struct(
    contract_version=_S, tool=struct(name=_S, version=_S), status=_S,
    summary=struct(total=_L, passed=_L, failed=_L, warnings=_L),
    results=T.ArrayType(_S), warnings=T.ArrayType(_S), errors=T.ArrayType(_S),
    timing=struct(start_time=_S, end_time=_S, duration_ms=_L), artifacts=T.ArrayType(_S),
)
