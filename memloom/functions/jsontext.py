"""JSON values: deep merge, lexical projection, canonical form, redaction by key. Arrow-batched where JSON must be walked."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of keys whose values are secret.
SENSITIVE_KEY = re.compile(r"api[_ -]?key|access[_ -]?key|secret|token|password|passwd|private[_ -]?key|client[_ -]?secret", re.I)


def merge_objects(old: Any, new: Any) -> Any:
    """Objects merge key by key; anything else, null too, replaces; arrays are replaced whole."""
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: merge_objects(old[k], v) if k in old else v for k, v in new.items()}}
    return new


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def lexical(value: Any) -> str:
    """Keys and scalars of a JSON value, depth first, a line each; NUL becomes a space."""
    out: list[str] = []

    def walk(v: Any) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                out.append(k)
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)
        else:
            out.append(v if isinstance(v, str) else json.dumps(v))

    walk(value)
    return "\n".join(out).replace("\0", " ")


def redact_keys(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: "<redacted:credential>" if SENSITIVE_KEY.search(k) else redact_keys(v) for k, v in value.items()}
    return [redact_keys(v) for v in value] if isinstance(value, list) else value


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


@F.pandas_udf(StringType())
def lexical_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else lexical(_parsed(v)))


@F.pandas_udf(StringType())
def json_merge(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([b if a is None else canonical(merge_objects(_parsed(a), _parsed(b))) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(StringType())
def json_canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical(_parsed(v)))


@F.pandas_udf(StringType())
def json_redact(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical(redact_keys(_parsed(v))))


def register(spark: SparkSession) -> None:
    """The SQL function ``lexical_text``."""
    spark.udf.register("lexical_text", lexical_text)
