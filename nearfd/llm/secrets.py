"""Secrets in whole texts: fixed patterns, and free-standing tokens told apart by who owns them corpus-wide.

1. One pass finds spans: ``assign`` (a key word, a sign, a value), ``access`` (key ids), ``hex`` (long hexadecimal runs)
   and candidates: free-standing tokens that mix letters and digits and overlap none of the former.
2. Only hashes of the values leave that pass.  They are counted corpus-wide by distinct owners and distinct
   repositories.  A value that many owners or repositories share is a widely copied example; a value of few owners
   looks live.
3. Candidates that look live become spans of kind ``token``.  Spans of the fixed patterns always stay; how many of
   them are copied examples is reported beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def either_case(word: str) -> str:
    """``word`` with each letter as a class of its two cases (the flag for it would also match other alphabets)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


KINDS = ("assign", "access", "hex", "token")
KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+_]+"
LEAST = (8, 16, 32)  # characters of an assigned value, of an access key, of a hexadecimal run

SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value", T.BinaryType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))


@dataclass(frozen=True)
class Secrets:
    """A candidate has ``min_token`` characters, ``letters`` letters, ``digits`` digits and ``distinct`` different
    characters at least.  ``example_owners`` owners or ``example_repos`` repositories make a value an example."""

    min_token: int = 16
    letters: int = 4
    digits: int = 4
    distinct: int = 8
    example_owners: int = 3
    example_repos: int = 6


def text_spans(text: str, cfg: Secrets = Secrets()) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of a text in order of start and kind; places are code points, ends exclusive."""
    found = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(ASSIGN, text) if len(m[2]) >= LEAST[0]]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= LEAST[1]]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(HEX, text) if len(m[0]) >= LEAST[2]]
    taken = sorted((s, e) for s, _, e, _ in found)
    at = reach = 0
    for m in re.finditer(TOKEN, text):
        v = m[0]
        if len(v) < cfg.min_token:
            continue
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        digits = sum(c.isdigit() for c in v)
        letters = sum(c.isalpha() for c in v)
        if reach <= m.start() and digits >= cfg.digits and letters >= cfg.letters and len(set(v)) >= cfg.distinct:
            found.append((m.start(), 3, m.end(), v))
    return sorted(found)


def _scanner(cfg: Secrets):
    probe = "|".join([rf"({KEYS})[\"']? *[:=]", f"AKIA[A-Z0-9]{{{LEAST[1] - 4}}}", f"[A-Za-z0-9+_]{{{min(cfg.min_token, LEAST[2])}}}"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            some = np.flatnonzero(pc.match_substring_regex(texts, probe).fill_null(False).to_numpy(zero_copy_only=False))
            spans: list = [[]] * batch.num_rows
            for i in some:
                spans[i] = [{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).digest()[:16]}
                            for s, k, e, v in text_spans(texts[int(i)].as_py(), cfg)]
            keep = [batch.column(n) for n in batch.schema.names if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(spans, _ARROW)], names=[*names, "spans"])

    return scan


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))))


def value_ownership(scanned: DataFrame, cfg: Secrets = Secrets()) -> DataFrame:
    """``value, n_owners, n_repos, n_places, example`` of every value hash of ``scanned`` (owner, repo, spans).

    Equal (value, owner, repository) triples are counted inside each task first, so a value that fills a third of
    the corpus sends one row per task, owner and repository.
    """
    triples = (scanned.select("owner", "repo", F.explode("spans.value").alias("value"))
               .groupBy("value", "owner", "repo").agg(F.count("*").alias("n")))
    owners = triples.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    counted = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))
    return counted.withColumn("example", (F.col("n_owners") >= cfg.example_owners) | (F.col("n_repos") >= cfg.example_repos))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",),
                 repo_cols: tuple[str, ...] = ("source", "lang"), cfg: Secrets = Secrets()) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_examples, span_list``, one row per row of
    ``docs``.

    A repository is an owner and the values of ``repo_cols``; null owners are one owner.  ``spans`` and ``base_sha256``
    are digests of the spans, ``span_list`` has them as structs with a flag for copied examples; ``n_examples`` counts
    the fixed-pattern spans whose value is one.  Texts are read whole; null and empty ones have no spans.  Repeated
    rows, null and repeated ids each keep their own row.  Other columns of ``docs`` play no part, whatever their
    names; an empty table gives an empty table.
    """
    owner = [F.col(c) for c in owner_cols]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.to_json(F.array(*[F.to_json(F.struct(o.alias("v"))) for o in owner])).alias("owner"),
                       F.to_json(F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in repo_cols])).alias("repo"))
    out = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("spans", SPANS)])
    scanned = materialize(rows.mapInArrow(_scanner(cfg), out).withColumn("row", F.monotonically_increasing_id()), "secrets")
    known = materialize(value_ownership(scanned, cfg).select("value", "example"), "ownership")
    # a hot value makes a skewed join of short rows, which adaptive execution splits
    spans = (scanned.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
             .join(known, "value")
             .filter("kind < 3 OR NOT example")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "example"))).alias("list")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")
    full = scanned.select("id", "row").join(spans, "row", "left").withColumn("list", F.coalesce("list", none))

    def number(kind: int) -> Column:
        return F.size(F.filter("list", lambda s: s.kind == kind)).cast("long")

    base = F.filter("list", lambda s: s.kind < 3)
    return full.select(
        F.col("id").alias(id_col), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("list")).alias("spans"), number(3).alias("n_token"),
        F.size(F.filter(base, lambda s: s.example)).cast("long").alias("n_examples"), F.col("list").alias("span_list"))


def secrets_sql(cfg: Secrets = Secrets()) -> str:
    """DuckDB SQL for the digest columns of ``find_secrets`` on the table ``documents``."""
    q = lambda p: p.replace("'", "''")
    places = "\n  UNION ALL ".join(
        f"SELECT doc_id, source, lang, {kind} AS kind, regexp_extract_all(t, '{q(p)}') AS ms, regexp_split_to_array(t, '{q(p)}') AS gaps"
        f" FROM d WHERE regexp_matches(t, '{q(p)}')" for kind, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN)))
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
p AS ({places}),
m AS (SELECT doc_id, source, lang, kind, ms[i] AS m, CASE kind WHEN 0 THEN regexp_extract(ms[i], '{q(ASSIGN)}', 2) ELSE ms[i] END AS v,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM p)),
base AS (SELECT *, s + length(m) AS e FROM m WHERE kind < 3 AND length(v) >= CASE kind WHEN 0 THEN {LEAST[0]} WHEN 1 THEN {LEAST[1]} ELSE {LEAST[2]} END),
cand AS (SELECT *, s + length(m) AS e FROM m WHERE kind = 3 AND length(v) >= {cfg.min_token}
         AND len(regexp_extract_all(v, '[0-9]')) >= {cfg.digits} AND len(regexp_extract_all(v, '[A-Za-z]')) >= {cfg.letters}
         AND len(list_distinct(regexp_extract_all(v, '.'))) >= {cfg.distinct}),
free AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)),
spots AS (SELECT * FROM base UNION ALL SELECT * FROM free),
known AS (SELECT v, count(DISTINCT (source)) FILTER (source IS NOT NULL) + max(CAST(source IS NULL AS INTEGER)) >= {cfg.example_owners}
            OR count(DISTINCT (coalesce(source, '?'), coalesce(lang, '?'))) >= {cfg.example_repos} AS example FROM spots GROUP BY v),
kept AS (SELECT doc_id, kind, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e AS x, s, e, example
         FROM spots JOIN known USING (v) WHERE kind < 3 OR NOT example),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        count(*) FILTER (kind = 3) AS n_token, count(*) FILTER (kind < 3 AND example) AS n_examples,
        coalesce(string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 3), '') AS base, string_agg(x, ',' ORDER BY s, kind, e) AS spans
      FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN g USING (doc_id)"""
