"""Schema files of layers: what they declare about columns, and how that is laid over the columns found.

A file is small and is read by the driver; what it says joins the column report as a DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Declared:
    """What a schema says about a column."""

    name: str
    type: str | None = None
    description: str = ""
    required: bool = False
    primary_key: bool = False
    foreign_key: str | None = None


# The names under which a column's properties are given, the first that says something counts.
_NAMES = {
    "name": ("name", "column_name", "column"), "type": ("type", "data_type"), "description": ("description", "desc"), "required": ("required", "not_null", "notNull"),
    "primary_key": ("primary_key", "pk", "primaryKey"), "foreign_key": ("foreign_key", "references", "fk"),
}
_KINDS = {"type": (str, "a text"), "description": (str, "a text"), "required": (bool, "true or false")}
SHOWN = 8


class SchemaError(ValueError):
    """A schema that can't be used; its text lists what is wrong."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        more = [f"and {len(problems) - SHOWN} more"] if len(problems) > SHOWN else []
        super().__init__("; ".join([*problems[:SHOWN], *more]))


def _entries(container, where: str, problems: list[str]) -> Iterator[tuple[str, str | None, object]]:
    """(where, name from a key, what is said) of each column of a list or an object."""
    if not isinstance(container, (list, dict)):
        problems.append(f"{where} is neither a list nor an object")
    elif not container:
        problems.append(f"{where} is empty")
    elif isinstance(container, list):
        yield from ((f"{where}[{i}]", None, said) for i, said in enumerate(container))
    else:
        yield from ((f"{where}.{key}", key, said) for key, said in container.items())


def _tables(tables, problems: list[str]) -> Iterator[tuple[str, str | None, object, dict]]:
    if not isinstance(tables, dict) or not tables:
        problems.append("tables is not an object of tables")
        return
    for name, table in tables.items():
        if not isinstance(table, dict):
            problems.append(f"tables.{name} is not an object")
            continue
        if not isinstance(table.get("primary_key", ""), (str, type(None))):
            problems.append(f"tables.{name}.primary_key is not the name of a column")
        if not isinstance(table.get("foreign_keys", {}), (dict, type(None))):
            problems.append(f"tables.{name}.foreign_keys is not an object")
        yield from ((*entry, table) for entry in _entries(table.get("columns"), f"tables.{name}.columns", problems))


def _pick(said: dict, what: str):
    return next((said[n] for n in _NAMES[what] if said.get(n) not in (None, "", False)), None)


def _declared(where: str, key: str | None, said, table: dict, problems: list[str]) -> Declared | None:
    """One column; a bare text is its type within a table, its description elsewhere."""
    if not isinstance(said, (str, dict)):
        problems.append(f"{where} is neither an object nor a text")
        return None
    said = said if isinstance(said, dict) else {"type" if table else "description": said}
    name = key if key is not None else _pick(said, "name")
    if not isinstance(name, str) or not name.strip():
        problems.append(f"{where} has no name")
        return None
    for what, (kind, words) in _KINDS.items():
        wrong = [n for n in _NAMES[what] if said.get(n) is not None and not isinstance(said[n], kind)]
        problems += [f"{where}.{n} is not {words}" for n in wrong[:1]]
    keys, notes = table.get("foreign_keys"), table.get("descriptions")
    target = keys[name] if isinstance(keys, dict) and name in keys else _pick(said, "foreign_key")
    if isinstance(target, dict):
        target = ".".join(str(target[k]) for k in ("table", "column") if target.get(k))
    note = _pick(said, "description") or (notes.get(name) if isinstance(notes, dict) else None)
    primary = bool(_pick(said, "primary_key")) or name == table.get("primary_key")
    return Declared(name.strip().lower(), _pick(said, "type"), str(note or "").strip(), bool(_pick(said, "required")) or primary, primary, target or None)


def parse_schema(text: str) -> dict[str, Declared]:
    """The columns that a schema declares, by name in small letters; SchemaError lists all that is wrong with it.

    It is an object with `fields` or `columns` (a list or an object), with `tables` of columns, or of columns itself.
    Of a column that several tables have, the last counts, unless it says less than the one before.
    """
    try:
        data = json.loads(text)
    except ValueError as e:
        raise SchemaError([f"no JSON: {e}"]) from e
    if not isinstance(data, dict):
        raise SchemaError(["not an object"])
    problems: list[str] = []
    if "tables" in data:
        said = list(_tables(data["tables"], problems))
    else:
        within = next((n for n in ("fields", "columns") if data.get(n) is not None), None)
        said = [(*entry, {}) for entry in _entries(data[within] if within else data, within or "schema", problems)]
    out: dict[str, Declared] = {}
    for entry in said:
        column = _declared(*entry, problems)
        if column is None:
            continue
        before = out.get(column.name)
        if not (before and (before.description or before.primary_key) and not (column.description or column.primary_key)):
            out[column.name] = column
    if problems or not out:
        raise SchemaError(problems or ["no columns"])
    return out


def schema_frame(spark: SparkSession, declared: dict[str, Declared]) -> DataFrame:
    """name, type, description, required, primary_key and foreign_key of the declared columns."""
    rows = [(d.name, d.type, d.description, d.required, d.primary_key, d.foreign_key) for d in declared.values()]
    return spark.createDataFrame(rows, "name string, type string, description string, required boolean, primary_key boolean, foreign_key string")


def overlaid(report: DataFrame, declared: dict[str, Declared]) -> DataFrame:
    """A column report (column, dtype, …) with type, description, source, required, primary_key and foreign_key.

    Columns that the schema doesn't have keep their dtype as type; source is schema where it gives a description.
    """
    schema = schema_frame(report.sparkSession, declared).select(F.col("name").alias("_name"), F.col("type").alias("_type"), F.col("description").alias("_description"), "required", "primary_key", "foreign_key")
    joined = report.join(F.broadcast(schema), F.lower(F.trim("column")) == F.col("_name"), "left")  # a schema is a file that the driver has read
    no = F.lit(False)
    return joined.select(
        *report.columns, F.coalesce("_type", "dtype").alias("type"), F.coalesce("_description", F.lit("")).alias("description"), F.when(F.col("_description") != "", "schema").otherwise("").alias("source"),
        F.coalesce("required", no).alias("required"), F.coalesce("primary_key", no).alias("primary_key"), "foreign_key",
    )
