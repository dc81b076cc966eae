"""Layers as named views, and read-only SQL over them."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sql_functions
from lodestone.scratch import exists, file_system, remove

#: Nodes of a parsed plan that only read; a plan with any other is refused.
READING = frozenset({
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "Sort",
    "SubqueryAlias", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Union", "Unpivot", "WithWindowDefinition",
})
#: Functions that make rows of their arguments and nothing else.
TABLE_FUNCTIONS = frozenset({"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"})
#: Functions that reach outside of the query.
REFUSED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})


def sanitized(names: list[str]) -> list[str]:
    """Column names of letters, digits and _, all different; of the id columns the first is id, the others source_id."""
    plain = [re.sub(r"[^0-9a-z]+", "_", n.lower()).strip("_") or "col" for n in names]
    out: list[str] = []
    taken = set(plain)
    ids = 0
    for name in plain:
        if re.fullmatch(r"id(_\d+)?", name):
            name = "id" if not ids else "source_id" if ids == 1 else f"source_id_{ids - 1}"
            ids += 1
        base, n = name, 0
        while name in out or (n and name in taken):
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class Catalog:
    """Layers registered under display names; each is a temporary view.

    With a path, layers are stored there and a later catalog of the same path has them again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.layers, self.path = spark, {}, path
        if path and exists(spark, path):
            fs, at = file_system(spark, path)
            for folder in (str(s.getPath()) for s in fs.listStatus(at)):
                if exists(spark, f"{folder}/meta/_SUCCESS"):
                    layer = json.loads(spark.read.text(f"{folder}/meta").first()[0])
                    self.layers[layer["name"]] = layer
                    spark.read.parquet(f"{folder}/data").createOrReplaceTempView(quoted(layer["name"]))

    def _folder(self, name: str) -> str:
        return f"{self.path}/{hashlib.sha1(name.encode()).hexdigest()[:16]}"

    def register(self, name: str, df: DataFrame, geometry: str = "GEOMETRY", descriptions: dict[str, str] | None = None) -> DataFrame:
        """Names the layer's columns so that SQL can, describes those without a description, and replaces a layer of this name."""
        df = df.toDF(*sanitized(df.columns))
        layer = {"name": name, "geometry_type": geometry, "n_columns": len(df.columns), "descriptions": {c: (descriptions or {}).get(c, describe(c, t)) for c, t in df.dtypes}}
        if self.path:
            remove(self.spark, f"{self._folder(name)}/meta")  # the layer is whole again when that stands
            df.write.mode("overwrite").parquet(f"{self._folder(name)}/data")
            self.spark.createDataFrame([(json.dumps(layer),)], "value string").coalesce(1).write.text(f"{self._folder(name)}/meta")
            df = self.spark.read.parquet(f"{self._folder(name)}/data")
        df.createOrReplaceTempView(quoted(name))
        self.layers[name] = layer
        return df

    def drop(self, name: str) -> None:
        self.layers.pop(name, None)
        self.spark.sql(f"drop view if exists {quoted(name)}")
        if self.path:
            remove(self.spark, self._folder(name))

    def columns(self) -> DataFrame:
        rows = [(n, layer["geometry_type"], c, d) for n, layer in self.layers.items() for c, d in layer["descriptions"].items()]
        return self.spark.createDataFrame(rows, "name string, geometry_type string, column string, description string")

    def listing(self) -> DataFrame:
        """A row for each layer with its columns as an array of structs."""
        return self.columns().groupBy("name", "geometry_type").agg(F.array_sort(F.collect_list(F.struct("column", "description"))).alias("columns"))

    def query(self, sql: str, **args) -> DataFrame:
        """Runs one reading statement over registered layers only; it may call the functions of sql_functions."""
        text = portable(sql)
        check(self.spark, text, set(self.layers))
        if re.search(r"(?i)\bst_\w+\s*\(", text):
            sql_functions.register(self.spark)
        return self.spark.sql(text, args=args or None)


# Names of columns that name a feature, and of those that tell its kind.
NAMES, KINDS = ("name_en", "name_ar", "title", "label", "display_name"), ("tags", "type", "category", "amenity", "classification", "description")


def suggested(columns: list[str]) -> list[str]:
    """The columns to show of a layer: its names, else those with `name` in theirs, then those that tell its kind."""
    names = [c for c in columns if c == "name"] + [c for c in columns if c != "name" and ("name:" in c or c in NAMES)]
    names = names or [c for c in columns if "name" in c.lower()]
    return list(dict.fromkeys([*names, *(c for c in columns if c in KINDS)]))


def schema_text(catalog: Catalog) -> str:
    """The layers and their columns as a text for a model that writes SQL."""
    quoted = lambda c: c if re.fullmatch(r"\w+", c) else f'"{c}"'
    out = ["Layers, each with its columns:"]
    for name, layer in catalog.layers.items():
        told = ", ".join(f"{c} — {d}" for c, d in layer["descriptions"].items()) or "(no columns)"
        out += [f'- "{name}", geometry {layer["geometry_type"]}: {told}', f"  shown best: {', '.join(map(quoted, suggested(list(layer['descriptions'])))) or 'none'}"]
    return "\n".join(out)


def describe(column: str, dtype: str) -> str:
    """A plain description for a column that has none."""
    words = column.replace("_", " ").strip()
    kind = "number" if dtype in ("int", "bigint", "double", "float") or dtype.startswith("decimal") else "text" if dtype == "string" else dtype
    return f"{words.capitalize()} ({kind})"


def portable(sql: str) -> str:
    """Casts of PostgreSQL that Spark has not, outside of quoted text: ::text, bare ::numeric, ::geography."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")", sql)
    for i in range(0, len(parts), 2):
        part = re.sub(r"(?i)::\s*text\b", "::string", parts[i])
        part = re.sub(r"(?i)::\s*numeric\b(?!\s*\()", "::decimal(38,10)", part)
        parts[i] = re.sub(r"(?i)::\s*geography\b", "", part)
    return "".join(parts)


def _each(seq) -> list:
    """The elements of a Scala sequence."""
    return [seq.apply(i) for i in range(seq.size())]


def _refused(plan, seen: frozenset[str], subquery) -> str | None:
    """What in a parsed plan keeps it from being run, or None; seen: names that may be read at this place.

    A common table expression is seen by those after it and by the query itself, not by those before, nor outside of
    its WITH; by itself only where it is recursive.
    """
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        return f"{kind} is not allowed"
    if kind == "UnresolvedTableValuedFunction":
        name = [str(x).lower() for x in _each(plan.name())]
        if len(name) != 1 or name[0] not in TABLE_FUNCTIONS:
            return f"not allowed: {'.'.join(name)}"
    if kind == "UnresolvedRelation":
        name = [str(x) for x in _each(plan.multipartIdentifier())]
        return None if len(name) == 1 and name[0].lower() in seen else f"not allowed: {'.'.join(name)}"
    if kind == "UnresolvedWith":
        for relation in _each(plan.cteRelations()):
            name = relation._1().lower()
            if bad := _refused(relation._2(), seen | {name} if plan.allowRecursion() else seen, subquery):
                return bad
            seen = seen | {name}
    stack = _each(plan.expressions())
    while stack:
        e = stack.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction" and _each(e.nameParts())[-1].lower() in REFUSED_FUNCTIONS:
            return f"not allowed: {_each(e.nameParts())[-1]}"
        if subquery.isInstance(e) and (bad := _refused(e.plan(), seen, subquery)):
            return bad
        stack += _each(e.children())
    return next((bad for child in _each(plan.children()) if (bad := _refused(child, seen, subquery))), None)


def check(spark: SparkSession, sql: str, allowed: set[str]) -> None:
    """Raises unless sql is one reading statement whose tables are all allowed; what isn't known to read is refused."""
    if not sql.strip():
        raise ValueError("an empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:
        raise ValueError(f"not one SQL statement: {str(e).splitlines()[0]}") from e
    subquery = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    if bad := _refused(plan, frozenset(a.lower() for a in allowed), subquery):
        raise ValueError(bad)
