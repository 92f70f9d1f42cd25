"""Secret scan (operator 10, DataFrame functions only).

Three base patterns find assignments, access keys and hex runs. On top, candidate strings (long runs of the usual
secret alphabet) are scored by the Shannon entropy of a sliding window. The window's entropy follows from
S = sum of c * log2(c) over its character counts c (H = log2(w) - S / w); moving the window by one changes two counts
only, so S and the count map are updated for those two, and neither is made anew. c * log2(c) is held as an integer (times 2^20), so that
updates add up without rounding. Each character class (hex; letters and digits; base64 with symbols) has its own
threshold. Candidates that an allow-list names (words, numbers, UUIDs, placeholders, paths) are suppressed.

Spark has no function for the places of all matches, so a match's place is the sum of the lengths of the pieces that
split() leaves before it and of the matches before it. Everything is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm._common import table

# Fixed values of the contract.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ACCESS = "AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ with those under 18 characters dropped
HEX = "[0-9a-f]{16,}"  # likewise, of 16 characters or more
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_LEAST = 12


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ASSIGN_WORDS)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"  # of candidates
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Class, the characters that it is made of, and the least bits a character that one window must have.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 3.1), ("alnum", "^[A-Za-z0-9]+$", 3.65), ("base64", "^[A-Za-z0-9+/_=-]+$", 3.8)]
#: A candidate that one of these matches is no secret.
ALLOW = [
    "^[A-Za-z_/+=-]+$",  # words, identifiers, paths, rules of = and -
    "^[0-9_/+=-]+$",  # numbers, dates, telephone numbers
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    "EXAMPLE|example|XXXX|xxxx|0123456789|1234567890|abcdefgh|ABCDEFGH",  # placeholders
    "^[a-z]+([-_/][a-z0-9]+){3,}$",  # slugs and lower-case paths
]
_SCALE = 1 << 20
_F = [0] + [round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)]


def _limit(bits: float) -> int:
    """The largest S (scaled) of a window with at least so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)


def _prefix(steps: Column) -> Column:
    """Exclusive prefix sums of an array of longs, in blocks of 256 (linear but for a 256th)."""
    zero = F.lit(0).cast("long")
    add = lambda a, b: a + b
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 256).cast("int")), lambda b: F.aggregate(F.slice(steps, b * 256 + 1, F.lit(256)), zero, add))
    base = F.aggregate(blocks, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    start = F.transform(steps, lambda _, i: F.element_at(base, F.floor(i / 256).cast("int") + 1) + F.aggregate(F.slice(steps, F.floor(i / 256).cast("int") * 256 + 1, i % 256), zero, add))
    return F.when(F.size(steps) > 0, start).otherwise(F.array().cast("array<bigint>"))


def _with_spans(df: DataFrame, name: str, kind: int, pattern: str, group: int | None = None, least: int = 0) -> DataFrame:
    """df with `name`: array of (start, kind, end, match) of the pattern's leftmost matches in __text."""
    hit, m, g, steps, at = (f"__{name}_{x}" for x in ("hit", "m", "g", "steps", "at"))
    none = F.array().cast("array<string>")
    df = df.withColumn(hit, F.col("__text").rlike(pattern))
    df = df.withColumn(m, F.when(F.col(hit), F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.col(hit), F.slice(F.split("__text", pattern, -1), F.lit(1), F.size(m))).otherwise(none))
    df = df.withColumn(steps, F.zip_with(g, m, lambda a, b: (F.char_length(a) + F.char_length(b)).cast("long")))
    df = df.withColumn(at, _prefix(F.col(steps)))
    spans = F.transform(
        F.arrays_zip(F.col(at).alias("at"), F.col(g).alias("g"), F.col(m).alias("m")),
        lambda x: F.struct(
            (x["at"] + F.char_length(x["g"])).alias("start"),
            F.lit(kind).alias("kind"),
            (x["at"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("end"),
            x["m"].alias("match"),
        ),
    )
    if group is not None:
        value = f"__{name}_v"
        df = df.withColumn(value, F.when(F.col(hit), F.regexp_extract_all("__text", F.lit(pattern), F.lit(group))).otherwise(none))
        spans = F.filter(spans, lambda _, i: F.char_length(F.element_at(F.col(value), i + 1)) >= least)
    return df.withColumn(name, spans).drop(hit, m, g, steps, at, f"__{name}_v")


def least_s(text: Column) -> Column:
    """The least S (scaled) over all windows of a candidate string of at least WINDOW characters, by incremental counts.

    One pass over the characters carries the window's count map: 5 bits for each character of the alphabet, 12 counts in
    a long. Each step adds the character that enters and takes off the one that leaves, reading and changing these two
    counts only.
    """
    f = F.array(*[F.lit(x) for x in _F])
    fn = lambda c: F.element_at(f, c + 1)
    shift = lambda name, x, bits: F.call_function(name, x, bits)
    codes = F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)

    def count(counts: Column, code: Column) -> Column:
        return shift("shiftright", F.element_at(counts, F.floor(code / 12).cast("int") + 1), code % 12 * 5).bitwiseAND(F.lit(31)).cast("int")

    def one(code: Column, word: Column) -> Column:
        return F.when(F.floor(code / 12).cast("int") == word, shift("shiftleft", F.lit(1).cast("long"), code % 12 * 5)).otherwise(F.lit(0).cast("long"))

    def move(state: Column, i: Column) -> Column:  # from the window that ends before i to the one that ends at i
        new = F.element_at(codes, i)
        out = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(-1))
        n_out = F.when(out >= 0, count(state["counts"], F.greatest(out, F.lit(0)))).otherwise(F.lit(0))
        n_new = count(state["counts"], new) - F.when(out == new, 1).otherwise(0)
        s = state["s"] - fn(n_out) + fn(F.greatest(n_out - 1, F.lit(0))) - fn(n_new) + fn(n_new + 1)
        counts = F.transform(state["counts"], lambda x, word: x + one(new, word) - F.when(out >= 0, one(out, word)).otherwise(F.lit(0).cast("long")))
        low = F.when(i >= WINDOW, F.least(state["low"], s)).otherwise(state["low"])
        return F.struct(s.alias("s"), low.alias("low"), counts.alias("counts"))

    start = F.struct(F.lit(0).alias("s"), F.lit((1 << 31) - 1).alias("low"), F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // 12)).alias("counts"))
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, move, lambda s: s["low"])


def _is_secret(text: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | text.rlike(pattern)
    limit = F.lit(None).cast("int")
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(text.rlike(pattern), F.lit(_limit(bits))).otherwise(limit)
    return F.when(allowed, False).otherwise(least_s(text) <= limit)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `secrets`: array of (start, kind, end, match), by start, then kind as in KINDS.

    start and end are code points of the whole text, end exclusive; kind is an index into KINDS. Base matches of one
    kind never overlap; an entropy span may repeat a base match. A null or empty text has none; null ids and repeated
    rows give a row each; other columns are not read.
    """
    df = docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    df = _with_spans(df, "assign", 0, ASSIGN, 2, ASSIGN_LEAST)
    df = _with_spans(df, "access", 1, ACCESS)
    df = _with_spans(df, "hexes", 2, HEX)
    df = _with_spans(df, "strings", 3, CANDIDATE)
    df = df.withColumn("strings", F.filter("strings", lambda x: _is_secret(x["match"])))
    return df.select(F.col("__id").alias(id_col), F.array_sort(F.concat("assign", "access", "hexes", "strings")).alias("secrets"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col replaced by mark; null texts stay null, all columns stay."""
    found = find_secrets(docs.withColumn("__row", F.struct(*[docs[c] for c in docs.columns])), "__row", text_col)
    values = F.array_distinct(F.transform("secrets", lambda x: x["match"]))
    values = F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.char_length(v).alias("n"), v.alias("v")))))  # longest first
    text = F.col("__row")[text_col]
    clean = F.aggregate(values, text, lambda t, v: F.replace(t, v["v"], F.lit(mark)))
    return found.select(*[(clean if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", count(0), count(1), count(2), F.sha2(_joined(F.filter("secrets", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), count(3)
    )


def _sql_spans(kind: int, pattern: str, keep: str = "TRUE") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT row, s + 0 AS s, {kind} AS k, s + length(m) AS e, m FROM (
  SELECT row, m, v, length(g) + CAST(coalesce(sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
    SELECT row, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', {2 if kind == 0 else 0})) AS v,
      unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}', 0))]) AS g, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i
    FROM d WHERE regexp_matches(t, '{p}'))) WHERE {keep}"""


def _oracle() -> str:
    allowed = " OR ".join("regexp_matches(m, '%s')" % p for p in ALLOW)
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN {_limit(b)}" for _, p, b in CLASSES) + " END"
    f = "[" + ", ".join(map(str, _F)) + "]"
    window = f"substr(m, w, {WINDOW})"
    s = f"list_sum([({f})[len(string_split({window}, c))] FOR c IN list_distinct(string_split({window}, ''))])"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
strings AS ({_sql_spans(3, CANDIDATE)}),
windows AS (SELECT row, s, k, e, m, unnest(range(1, length(m) - {WINDOW} + 2)) AS w FROM strings WHERE NOT ({allowed})),
scored AS (SELECT row, s, k, e, m, min({s.replace("[len(", "[len(")}) AS low FROM windows GROUP BY ALL),
spans AS ({_sql_spans(0, ASSIGN, f"length(v) >= {ASSIGN_LEAST}")} UNION ALL {_sql_spans(1, ACCESS)} UNION ALL {_sql_spans(2, HEX)}
  UNION ALL SELECT row, s, k, e, m FROM scored WHERE low <= {limit}),
g AS (SELECT row, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(({kinds})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN g USING (row)"""


ORACLE = {"op10_secret_scan": _oracle()}
QUERIES = {"op10_secret_scan": op10_secret_scan}
