"""JSON in free text: damaged documents, fragments, parameters."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def fragments(text: str) -> list[str]:
    """Every JSON object or array that stands in a text, outermost ones, in order."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while True:
        m = re.compile(r"[{\[]").search(text or "", at)
        if not m:
            return out
        try:
            value, end = decoder.raw_decode(text, m.start())
            out.append(json.dumps(value, ensure_ascii=False))
            at = end
        except ValueError:
            at = m.start() + 1


def repair(text: str) -> str | None:
    """The JSON document in a text with fences, prose around it, trailing commas or Python literals; null if there is none."""
    if not text:
        return None
    body = re.sub(r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "", text.strip())
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    tries = [body]
    if starts:
        first = min(starts)
        last = max(body.rfind("}"), body.rfind("]"))
        tries.append(body[first : last + 1])
    for t in tries:
        for candidate in (t, re.sub(r",(\s*[}\]])", r"\1", t)):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False)
            except ValueError:
                pass
        try:
            value = ast.literal_eval(t)
            if isinstance(value, dict | list):
                return json.dumps(value, ensure_ascii=False)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    return next(iter(fragments(body)), None)


@pandas_udf(T.ArrayType(T.StringType()))
def json_fragments(s: pd.Series) -> pd.Series:
    return s.map(fragments)


@pandas_udf(T.StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    return s.map(repair)


def canonical_json(c: Column) -> Column:
    """A JSON document with the keys of every object in order and without spaces, so that equal documents are equal strings; null if damaged."""
    return F.to_json(F.try_parse_json(c))


def distinct_items(c: Column) -> Column:
    """Of an array of JSON objects each one once, at its first place, as canonical JSON; what is no document goes."""
    return F.array_distinct(F.filter(F.transform(c, canonical_json), lambda x: x.isNotNull()))


def _frozen(value: object) -> object:
    if isinstance(value, dict):
        return {k: _frozen(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [_frozen(v) for v in value]
    return str(value or "").strip().lower()


@pandas_udf(T.StringType())
def frozen(s: pd.Series) -> pd.Series:
    """Key of a JSON value for comparison: objects with their keys in order, all leaves as trimmed text in lower case, empty ones as empty text."""

    def key(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_frozen(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return s.map(key)


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))


def search_terms(problems: Column, overall: Column) -> Column:
    """Terms of the sub-problems (array of structs with search_terms) and the overall ones, in order, without blanks."""
    return F.filter(F.concat(F.flatten(F.transform(problems, lambda p: p["search_terms"])), overall), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")


def merge_params(defaults: Column, given: Column) -> Column:
    """Given parameters over the defaults; nulls among them do not count."""
    known = F.map_filter(given, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(known, k)), known)


def first_list(c: Column, keys: tuple[str, ...]) -> Column:
    """The first of these arrays, in a VARIANT, that is there."""
    return F.coalesce(*(F.try_variant_get(c, f"$.{k}", "array<variant>") for k in keys))
