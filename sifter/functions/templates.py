"""Filling ``{field}`` templates with Spark columns (and, for the oracle, SQL expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{(\w+)\}")


def parts(template: str) -> list[tuple[str, str]]:
    """The template as ('lit', text) / ('field', name) pieces in order."""
    out, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            out.append(("lit", template[pos:m.start()]))
        out.append(("field", m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append(("lit", template[pos:]))
    return out


def fill(template: str, **values: Column) -> Column:
    """``template.format(**values)`` as one native ``concat``."""
    return F.concat(*[F.lit(v) if kind == "lit" else values[v] for kind, v in parts(template)])


def sql_fill(template: str, **values: str) -> str:
    """The same for a SQL engine: ``concat('lit', expr, ...)``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "concat(" + ", ".join(q(v) if kind == "lit" else values[v] for kind, v in parts(template)) + ")"
