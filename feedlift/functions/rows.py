"""A whole row as JSON text or as a map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlift.functions.text import as_column, blank_if_null

_KEEP_NULLS = {"ignoreNullFields": "false"}


def row_properties(columns: Sequence[str], *, id_col: str = "id", include_id: bool = True) -> Column:
    """Row as JSON with its types and its NULLs; every column named is serialised."""
    kept = [c for c in columns if include_id or c != id_col]
    return F.to_json(F.struct(*[as_column(c) for c in kept]), _KEEP_NULLS)


def row_context(columns: Sequence[str], first: dict[str, Column] | None = None) -> Column:
    """Row as JSON of texts, NULL as empty text, columns without a name left out.

    ``first`` puts extra fields in front. A feed column of the same name keeps its
    own value but moves to the front.
    """
    fields: dict[str, Column] = dict(first or {})
    for c in columns:
        if c:
            fields[c] = blank_if_null(c)
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), _KEEP_NULLS)


def row_map(columns: Sequence[str]) -> Column:
    """Row as map of texts, NULL as empty text."""
    return F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[blank_if_null(c) for c in columns]),
    )
