"""Questions in plain language: a caller's model writes a query, the engine runs it as the principal."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .engine import Engine

Generate = Callable[[str, str], str]  # (instructions, question) -> text

INSTRUCTIONS = "Answer with one Spark SQL SELECT over the listed tables, named schema_table, and nothing else."
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n(.*?)\n?\s*```\s*$", re.DOTALL)


def bare(text: str) -> str:
    """The query without code fences and a closing semicolon."""
    found = _FENCE.match(text)
    return (found.group(1) if found else text).strip().rstrip(";").strip()


def ask(engine: Engine, principal: str, question: str, generate: Generate) -> tuple[str, DataFrame]:
    """(query, rows): the context and the rows are what the principal may see, and the query may only read."""
    context = json.dumps(engine.context(principal), default=str)
    query = bare(generate(f"{INSTRUCTIONS}\n{context}", question))
    return query, engine.sql(principal, query)


def interpret(question: str, rows: DataFrame, generate: Generate, most: int = 50) -> str:
    """An answer in words from the first rows."""
    shown = [r.asDict(recursive=True) for r in rows.limit(most).collect()]
    return generate("Answer the question from these rows.\n" + json.dumps(shown, default=str), question)
