"""Requests and results as JSON text: one object a request, one line a result row. What is unknown is refused."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.plans import qlang

KINDS = ("prefix", "substring", "wildcard", "regex", "path_terms")
RESULT = "path string, size long, mtime long, is_dir boolean, size_exact boolean"


class BadRequest(ValueError):
    """A request of an unknown kind or order, or with fields missing or of the wrong type."""


def encode_request(kind: str, pattern: str, limit: int, order: str, now: int) -> str:
    text = json.dumps({"kind": kind, "pattern": pattern, "limit": limit, "order": order, "now": now})
    decode_request(text)
    return text


def decode_request(text: str) -> tuple[qlang.Query, str, int]:
    """(query, order, limit) of a request; BadRequest if anything in it is unknown."""
    try:
        r = json.loads(text)
    except ValueError as e:
        raise BadRequest("no JSON") from e
    fields = {"kind": str, "pattern": str, "limit": int, "order": str, "now": int}
    if not isinstance(r, dict) or set(r) != set(fields) or any(type(r[k]) is not t for k, t in fields.items()):
        raise BadRequest(f"a request has the fields {sorted(fields)}")
    if r["kind"] not in KINDS:
        raise BadRequest(f"unknown kind: {r['kind']!r}")
    try:
        order = qlang.parse_order(r["order"])
    except ValueError as e:
        raise BadRequest(str(e)) from e
    return qlang.to_query(r["pattern"], r["now"], r["kind"]), order, r["limit"]


def encode_results(found: DataFrame) -> DataFrame:
    """(line) for every result row, in its order."""
    return found.select(F.to_json(F.struct("path", "size", "mtime", "is_dir", "size_exact")).alias("line"))


def decode_results(lines: DataFrame) -> DataFrame:
    """Result rows of lines; a line that is none fails the job."""
    return lines.select(F.from_json("line", RESULT, {"mode": "FAILFAST"}).alias("r")).select("r.*")
