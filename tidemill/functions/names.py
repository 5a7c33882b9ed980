"""Names: snake case, columns of meta fields, short hashes."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: str) -> str:
    return re.sub(r"([a-z])([A-Z]+)", r"\1_\2", name).lower()


def snake_case_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z])([A-Z]+)", r"$1_$2"))


def column_of(field: str) -> str:
    return f"meta_{snake_case(field)}"


def short_hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:10]


def short_hash_column(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 10)
