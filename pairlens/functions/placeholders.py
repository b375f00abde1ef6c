"""Text with placeholders ``{{[a.b.0] * 100|.1f}}``: arithmetic over paths of a VARIANT, said in SQL and compiled to one Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = re.compile(r"\{\{(.+?)(?:\|([^{}|]*))?\}\}")
PATH = re.compile(r"\[([^\[\]]+)\]")
ALLOWED = re.compile(r"[\s\d.+*/()-]*\Z")  # besides paths
FORMAT = re.compile(r"(\.\d+f|d|s)\Z")


def path(dotted: str) -> str:
    """``a.b.0.c`` as a VARIANT path; numbers are places in arrays."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.strip().split("."))


def value(doc: str, expression: str) -> Column:
    """The number that an expression gives on column ``doc``; a path that is not there, or no number, stops the job and is named.

    Only numbers, ``+ - * /`` and brackets may stand between the paths: SQL's own rules read them, nothing else gets through.
    """
    if not ALLOWED.match(PATH.sub("", expression)):
        raise ValueError(f"not arithmetic over [paths]: {expression}")
    for p in PATH.findall(expression):
        if "'" in p or "\\" in p:
            raise ValueError(f"no path: {p}")
    sql = PATH.sub(lambda m: f"""nvl(try_variant_get(`{doc}`, "{path(m[1])}", 'double'), cast(raise_error('unresolved path {m[1]}') as double))""", expression)
    return F.expr(f"cast({sql} as double)")


def filled(doc: str, template: str) -> Column:
    """The template with its placeholders filled: ``d`` rounds, ``.2f`` keeps digits, ``s`` or none takes a path's text as it is."""
    parts, at = [], 0
    for m in SLOT.finditer(template):
        form = m[2] or "s"
        if not FORMAT.match(form):
            raise ValueError(f"unknown format {form}")
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if form == "s":
            p = PATH.match(m[1].strip())
            if not p or p.end() != len(m[1].strip()):
                raise ValueError(f"a format is needed for {m[1]}")
            parts.append(F.coalesce(F.try_variant_get(F.col(doc), path(p[1]), "string"), F.raise_error(F.lit(f"unresolved path {p[1]}")).cast("string")))
        elif form == "d":
            parts.append(F.bround(value(doc, m[1])).cast("long").cast("string"))
        else:
            digits = int(form[1:-1])
            text = F.format_string(f"%.{digits}f", value(doc, m[1]))
            parts.append(F.when(text.rlike("^-[0.]*$"), F.substring(text, 2, 1000)).otherwise(text))  # no negative zero
    return F.concat(*parts, F.lit(template[at:]))
