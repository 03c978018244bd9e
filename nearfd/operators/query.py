"""Conjunctive filter queries as immutable specifications.

A ``QuerySpec`` is a list of predicates that becomes Spark column expressions;
nothing is turned into query text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric, choose_metrics
from .rfd import Rfd
from .simjoin import similarity_join

IN_LIST_LIMIT = 1000  # longer lists are joined; the result is the same

# fixed values: operator signs and their plain spellings
SIGNS = {
    "=": "=", "==": "=",
    "≠": "≠", "!=": "≠", "<>": "≠",
    "∈": "∈", "in": "∈",
    "∉": "∉", "not in": "∉",
    ">": ">", "≥": "≥", ">=": "≥",
    "<": "<", "≤": "≤", "<=": "≤",
    "~": "contains", "contains": "contains",
    "prefix": "prefix", "suffix": "suffix",
    "between": "between", "ranges": "ranges", "integers": "integers",
    "similar": "similar", "similar to match": "similar to match", "similar by list": "similar by list",
}
ORDERED = (">", "≥", "<", "≤")


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _empty(v: Any) -> bool:
    return v is None or (isinstance(v, (str, list, tuple, dict, range)) and len(v) == 0)


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Any

    def condition(self) -> Column:
        """The predicate as a column expression."""
        c, v = F.col(f"`{self.column}`"), self.value
        match self.op:
            case "=":
                return c == F.lit(v)
            case "≠":
                return ~c.eqNullSafe(F.lit(v))
            case "∈":
                return c.isin(list(v))
            case "∉":
                return c.isNull() | ~c.isin(list(v))
            case ">":
                return c > F.lit(v)
            case "≥":
                return c >= F.lit(v)
            case "<":
                return c < F.lit(v)
            case "≤":
                return c <= F.lit(v)
            case "between":
                return c.between(F.lit(v[0]), F.lit(v[1]))
            case "ranges" | "integers":
                cond = F.lit(False)
                for lo, hi in v:
                    cond = cond | c.between(F.lit(lo), F.lit(hi))
                return cond & (c == F.floor(c)) if self.op == "integers" else cond
            case "contains":
                return c.rlike(v)
            case "prefix":
                return c.startswith(v)
            case "suffix":
                return c.endswith(v)
            case "similar":
                sources, t = v
                cond = F.lit(False)
                for s in sources:
                    cond = cond | (F.levenshtein(c, F.lit(s), int(t)) >= 0)
                return cond
        raise ValueError(f"{self.op!r} is not a plain condition")

    def is_plain(self) -> bool:
        """False if the predicate needs a join."""
        if self.op in ("∈", "∉"):
            return len(self.value) <= IN_LIST_LIMIT
        return self.op not in ("similar to match", "similar by list")

    def filter(self, df: DataFrame) -> DataFrame:
        if self.is_plain():
            return df.filter(self.condition())
        c = F.col(f"`{self.column}`")
        if self.op in ("∈", "∉"):
            values = list(dict.fromkeys(v for v in self.value if v is not None))
            if any(isinstance(v, float) for v in values) and all(map(_number, values)):
                values = [float(v) for v in values]
            # the list keeps its own type, so the comparison coerces as isin does
            listed = df.sparkSession.createDataFrame([(v,) for v in values], ["_v"])
            return df.join(listed, c == F.col("_v"), "left_semi" if self.op == "∈" else "left_anti")
        if self.op == "similar by list":
            sources, pairs = self.value
            near = pairs.filter(F.col("r").isin(list(sources))).select(F.col("l").alias("_v")).distinct()
            return df.join(near, c == F.col("_v"), "left_semi")
        pattern, t = self.value
        matches = df.filter(c.rlike(pattern)).select(c).distinct()
        return similarity_join(df, matches, {self.column: ("edit", t)}, "left_semi")


@dataclass(frozen=True)
class QuerySpec:
    """AND of predicates; an empty one selects everything."""

    predicates: tuple[Predicate, ...] = ()

    def __init__(self, items: Iterable = ()) -> None:
        preds = []
        for item in items:
            p = item if isinstance(item, Predicate) else Predicate(*item)
            if p.op not in SIGNS:
                raise ValueError(f"unknown operator {p.op!r}")
            if not _empty(p.value):
                preds.append(Predicate(p.column, SIGNS[p.op], p.value))
        object.__setattr__(self, "predicates", tuple(preds))

    # ------------------------------------------------------------ builders

    @classmethod
    def from_dict(cls, query: Mapping[str, Any]) -> QuerySpec:
        """``{col: scalar | '%x%' | list | range | {'min':.., 'max':..}}``."""
        out = []
        for col, v in query.items():
            if _empty(v):
                continue
            if isinstance(v, range):
                if not v:
                    continue
                out.append((col, "between", (v[0], v[-1])))
            elif isinstance(v, Mapping):
                out.append((col, "between", (v["min"], v["max"])))
            elif isinstance(v, (list, tuple)):
                out.append((col, "∈", list(v)))
            elif isinstance(v, str) and len(v) > 1 and v.startswith("%") and v.endswith("%"):
                out.append((col, "contains", v[1:-1]))
            elif isinstance(v, str) and v.startswith("%"):
                out.append((col, "suffix", v[1:]))
            elif isinstance(v, str) and v.endswith("%"):
                out.append((col, "prefix", v[:-1]))
            else:
                out.append((col, "=", v))
        return cls(out)

    @classmethod
    def from_operators(cls, operators: Mapping[str, str], values: Mapping[str, Any]) -> QuerySpec:
        if set(operators) != set(values):
            raise ValueError("operators and values have different columns")
        return cls([(c, op, values[c]) for c, op in operators.items()])

    @classmethod
    def from_strings(cls, df: DataFrame, items: Iterable[tuple[str, str, str]]) -> QuerySpec:
        """Predicates from text values, typed by the column; lists in brackets."""
        out = []
        for col, op, text in items:
            sign = SIGNS.get(op)
            if sign is None:
                raise ValueError(f"unknown operator {op!r}")
            numeric = isinstance(df.schema[col].dataType, T.NumericType)
            if sign in ORDERED and not numeric:
                raise ValueError(f"{op} needs a numeric column, {col} is not")

            def typed(s: str) -> Any:
                if not numeric:
                    return s
                try:
                    return int(s)
                except ValueError:
                    return float(s)

            if text == "":
                continue
            if sign in ("∈", "∉"):
                parts = text.replace("[", "").replace("]", "").split(",")
                out.append((col, sign, [typed(p.strip()) for p in parts]))
            else:
                out.append((col, sign, typed(text)))
        return cls(out)

    def add(self, column: str, op: str, value: Any) -> QuerySpec:
        return QuerySpec([*self.predicates, Predicate(column, op, value)])

    # ------------------------------------------------------------- queries

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(p.column for p in self.predicates))

    def condition(self) -> Column:
        cond = F.lit(True)
        for p in self.predicates:
            cond = cond & p.condition()
        return cond

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that satisfy every predicate; plain ones first, so they push down."""
        plain = QuerySpec([p for p in self.predicates if p.is_plain()])
        out = df.filter(plain.condition()) if plain.predicates else df
        for p in self.predicates:
            if p.is_plain():
                continue
            if p.op == "similar to match" and p.column in df.columns:
                # the matches come from the whole table, not from the filtered rows
                pattern, t = p.value
                c = F.col(f"`{p.column}`")
                matches = df.filter(c.rlike(pattern)).select(c).distinct()
                out = similarity_join(out, matches, {p.column: ("edit", t)}, "left_semi")
            else:
                out = p.filter(out)
        return out

    def pretty(self) -> str:
        if not self.predicates:
            return "All"
        return " AND ".join(
            f"{p.column.title().replace('_', ' ')} {p.op} {p.value}" for p in self.predicates)

    def to_json(self) -> str:
        """The predicates as text; one over a table of similar values becomes the list of the values it accepts."""
        out = []
        for p in self.predicates:
            op, value = p.op, p.value
            if op == "similar by list":
                sources, pairs = value
                op, value = "∈", sorted(r[0] for r in pairs.filter(F.col("r").isin(list(sources))).select("l").distinct().collect())
            out.append([p.column, op, value])
        return json.dumps(out, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> QuerySpec:
        return cls([tuple(item) for item in json.loads(text)])


def whole_range(v: float, t: float) -> tuple[int, int]:
    """Closed bounds around a value, cut to whole numbers toward zero."""
    return math.trunc(v - t), math.trunc(v + t + 1) - 1


def extend_query(spec: QuerySpec, rfd: Rfd, df: DataFrame, mode: str = "interval",
                 anchored: bool = False, metrics: Mapping[str, Metric | DataFrame] | None = None) -> QuerySpec:
    """Widen each predicate by the dependency's threshold of its attribute.

    Numbers become ranges (``mode='integers'``: only the whole numbers in them),
    strings become similarity predicates, order bounds move outward, ``≠`` and
    ``∉`` stay.  A wildcard reaches the neighbours of every value it matches; the
    match ignores where the wildcard stands unless ``anchored``.  ``metrics`` are those
    the dependency was found with; a taxonomy is given as its table of similar values.
    """
    if mode not in ("interval", "integers"):
        raise ValueError("mode is 'interval' or 'integers'")
    kinds = choose_metrics(df, [c for c in spec.fields if c in rfd], metrics)
    many = "integers" if mode == "integers" else "ranges"
    out: list[Predicate] = []
    for p in spec.predicates:
        if p.column not in rfd:
            out.append(p)
            continue
        t = rfd[p.column]
        kind = kinds[p.column]
        v = p.value
        if p.op in (">", "≥") and _number(v):
            out.append(Predicate(p.column, p.op, v - t))
        elif p.op in ("<", "≤") and _number(v):
            out.append(Predicate(p.column, p.op, v + t))
        elif t <= 0 or p.op in ("≠", "∉"):
            if not (p.op == "=" and kind == "days"):
                out.append(p)
        elif isinstance(kind, DataFrame) and p.op in ("=", "∈"):
            out.append(Predicate(p.column, "similar by list", (v if p.op == "∈" else [v], kind)))
        elif p.op == "between":
            out.append(Predicate(p.column, "between", (v[0] - t, v[1] + t)))
        elif p.op == "=" and kind == "abs":
            out.append(Predicate(p.column, many, [whole_range(v, t)]))
        elif p.op == "=" and kind == "edit":
            out.append(Predicate(p.column, "similar", ([v], t)))
        elif p.op == "=":
            continue  # other types cannot be extended: the predicate is dropped
        elif p.op == "∈" and all(_number(x) for x in v):
            out.append(Predicate(p.column, many, merge_ranges(whole_range(x, t) for x in v)))
        elif p.op == "∈" and all(isinstance(x, str) for x in v):
            out.append(Predicate(p.column, "similar", (list(dict.fromkeys(v)), t)))
        elif p.op in ("contains", "prefix", "suffix"):
            # the text of a prefix or suffix is no pattern
            pattern = v if p.op == "contains" else "\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            if anchored and p.op == "prefix":
                pattern = "^" + pattern
            elif anchored and p.op == "suffix":
                pattern += "$"
            out.append(Predicate(p.column, "similar to match", (pattern, t)))
        else:
            out.append(p)
    return QuerySpec(out) if out else spec


def merge_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of whole-number ranges; neighbours are not joined, so that
    the real-valued reading of each range stays as it was."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(set(ranges)):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
