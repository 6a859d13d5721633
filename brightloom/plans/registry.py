"""The registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.plans.harness import CHUNKS_SQL, DOCUMENTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tokens of every chunk, as the lexical operators see them.
WITH = f"WITH d AS ({DOCUMENTS_SQL}), c AS ({CHUNKS_SQL}), w AS (SELECT chunk_id, document_id, chunk_index, content, content_length, regexp_extract_all(lower(content), '[\\pL\\pN_]+') AS words FROM c)"


def query(sql: str | None = None) -> Callable:
    """Register a function under its name; ``sql`` may use the tables d, c and w of ``WITH``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{WITH}", WITH) if "{WITH}" in sql or sql.startswith("WITH") else f"{WITH} {sql}"
        return f

    return add


def literal(value) -> str:
    """A Python value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


def boundary_cut(text: str, room: str) -> str:
    """SQL of a text's cut to ``room`` characters at the boundaries of blocks."""
    cut = f"left({text}, {room})"
    last = lambda sep: f"CASE WHEN contains({cut}, {sep}) THEN length({cut}) - strpos(reverse({cut}), reverse({sep})) - length({sep}) + 1 ELSE -1 END"  # noqa: E731  from 0
    seps = ["'.' || chr(10)", "'. '", "'?' || chr(10)", "'? '", "'!' || chr(10)", "'! '", "'.—'", "'—'", "';' || chr(10)", "'; '"]
    at = " ".join(f"WHEN {last('(' + s + ')')} >= floor({room} * 0.5) THEN regexp_replace(left({cut}, {last('(' + s + ')')} + length({s})), '\\s+$', '') || ' [...]'" for s in seps)
    space = last("' '")
    return f"CASE WHEN length({text}) <= {room} THEN {text} {at} WHEN {space} > 0 THEN left({cut}, {space}) || ' [...]' ELSE {cut} || '[...]' END"


class Fixture:
    """Inline rows, as a DataFrame and as a SQL table expression."""

    def __init__(self, ddl: str, *rows: tuple):
        self.ddl, self.rows = ddl, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.ddl)

    def sql(self, alias: str = "t") -> str:
        names = ", ".join(part.strip().split()[0] for part in self.ddl.split(","))
        return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows) + f") {alias}({names})"


def load() -> None:
    """Import the modules that register queries."""
    from brightloom.plans import answer_queries, catalog_queries, extra_queries, grounding_queries, retrieval_queries, text_queries  # noqa: F401
