"""Schemas, enumerations and typed values that the whole library shares."""

from __future__ import annotations

import enum
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Status(enum.Enum):
    """What an operation came to. Expected failures are values, not exceptions."""

    ok = "ok"
    duplicate_id = "duplicate_id"
    not_found = "not_found"
    dimension_mismatch = "dimension_mismatch"
    invalid_argument = "invalid_argument"


class Metric(enum.Enum):
    """How two vectors are scored; a higher score is better under each."""

    cosine = "cosine"
    dot_product = "dot_product"
    euclidean = "euclidean"

    @property
    def code(self) -> int:
        """The number of the metric in files."""
        return list(Metric).index(self)

    @classmethod
    def from_code(cls, code: int) -> Metric:
        """The metric of a number; cosine for an unknown one."""
        return list(cls)[code] if 0 <= code < len(cls) else cls.cosine


class Mode(enum.Enum):
    lsm = "lsm"
    legacy = "legacy"


#: A typed value of metadata: its type, and the payload under the field of that type.
VALUE = "struct<t:string,i:bigint,d:double,b:boolean,s:string>"
METADATA = f"map<string,{VALUE}>"
ROWS = "id bigint, is_deleted boolean, values array<float>"
VERSIONS = f"generation int, {ROWS}"
RESULTS = "rank int, id bigint, score float"
OPS = f"seq bigint, op string, id bigint, values array<float>, metadata {METADATA}"
LOG = "lsn bigint, op string, id bigint, dimensions int, values array<float>, checkpoint_lsn bigint"

Scalar = bool | int | float | str


def tagged(value: Scalar) -> dict[str, Any]:
    """A Python value as a typed value; bool comes before int, which it subclasses. NaN and integers beyond 64 bits are errors."""
    out: dict[str, Any] = dict.fromkeys("tidbs")
    if isinstance(value, bool):
        out.update(t="bool", b=value)
    elif isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError("integer metadata must fit 64 bits")
        out.update(t="int64", i=value)
    elif isinstance(value, float):
        if math.isnan(value):
            raise ValueError("NaN metadata has no equality")
        out.update(t="double", d=value)
    elif isinstance(value, str):
        out.update(t="string", s=value)
    else:
        raise TypeError(f"not a metadata value: {value!r}")
    return out


def untagged(value: Any) -> Scalar:
    """The Python value of a typed value (a row or dict)."""
    return value[{"int64": "i", "double": "d", "bool": "b", "string": "s"}[value["t"]]]


def tagged_column(kind: str, payload: Column) -> Column:
    """A column of typed values of one kind: int64, double, bool or string. NaN becomes null, which equals nothing."""
    field = {"int64": "i", "double": "d", "bool": "b", "string": "s"}[kind]
    parts = [F.lit(kind).alias("t")]
    for name, sql in (("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string")):
        parts.append((payload if name == field else F.lit(None)).cast(sql).alias(name))
    made = F.struct(*parts)
    fine = payload.isNotNull() & (~F.isnan(payload) if kind == "double" else F.lit(True))
    return F.when(fine, made)


def tagged_literal(value: Scalar) -> Column:
    """A literal typed value."""
    row = tagged(value)
    kind = row["t"]
    return tagged_column(kind, F.lit(untagged(row)))
