"""Secret redaction for plain strings and for arrays, maps and structs of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.functions.text import pattern

# --- fixed values: (pattern, ignore case), applied in order --------------------------------
SECRETS = [
    (r"sb_secret_[A-Za-z0-9_-]{20,}", False),
    (r"sb_publishable_[A-Za-z0-9_-]{20,}", False),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}", False),
    (r"sk-or-v1-[A-Za-z0-9]{40,}", False),
    (r"whsec_[A-Za-z0-9]{20,}", False),
    (r"rk_live_[A-Za-z0-9]{20,}", False),
    (r"authorization:\s*[^\s]+", True),
    (r"cookie:\s*[^\s]+", True),
    (r"\b[A-Za-z0-9_-]*[Kk][Ee][Yy][A-Za-z0-9_-]*\s*[=:]\s*[^\s]+", False),
    (r"\b[A-Za-z0-9_-]*[Ss][Ee][Cc][Rr][Ee][Tt][A-Za-z0-9_-]*\s*[=:]\s*[^\s]+", False),
    (r"\b[A-Za-z0-9_-]*[Tt][Oo][Kk][Ee][Nn][A-Za-z0-9_-]*\s*[=:]\s*[^\s]+", False),
]
MASK = "***"


def redact(text: Column) -> Column:
    return reduce(
        lambda acc, rule: F.regexp_replace(acc, pattern(*rule), MASK), SECRETS, text
    )


def redact_value(col: Column, kind: T.DataType) -> Column:
    """Redact every string inside a nested column; other values pass unchanged."""
    if isinstance(kind, T.StringType):
        return redact(col)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: redact_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda _, v: redact_value(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [redact_value(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col
