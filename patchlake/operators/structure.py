"""Functions, classes, imports and calls of Python source files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from patchlake.functions import paths

FUNCTION = (
    "struct<name:string,qualified_name:string,parent_class:string,function_type:string,line_start:int,line_end:int,"
    "parameters:array<string>,is_async:boolean,decorators:array<string>,docstring:string,source_code:string,calls:array<string>>"
)
CLASS = "struct<name:string,line_start:int,line_end:int,docstring:string,decorators:array<string>>"
IMPORT = "struct<type:string,module:string,name:string,alias:string,level:int>"
SCHEMA = f"file_path string, parsed boolean, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>"


def _dotted(node: ast.expr) -> str:
    """Source of a name or attribute; plain dotted names need no printer."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else ast.unparse(node)


def _called(node: ast.AST) -> list[str]:
    return [
        _dotted(call.func) for call in ast.walk(node) if isinstance(call, ast.Call) and isinstance(call.func, (ast.Name, ast.Attribute))
    ]


def _structure(code: str) -> dict | None:
    """Items of one file, or None if it does not parse.

    A stack of (node, enclosing class) stands for the tree walk. Of a class only
    the body is entered, so its bases and decorators do not count.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found: dict[str, list] = {"functions": [], "classes": [], "imports": []}
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, owner = stack.pop()
        below = ast.iter_child_nodes(node)
        match node:
            case ast.ClassDef():
                span = {"name": node.name, "line_start": node.lineno, "line_end": node.end_lineno}
                found["classes"].append(
                    span | {"docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list]}
                )
                below, owner = iter(node.body), node.name
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                found["functions"].append(
                    {
                        "name": node.name,
                        "qualified_name": node.name if owner is None else f"{owner}.{node.name}",
                        "parent_class": owner,
                        "function_type": "function" if owner is None else "method",
                        "line_start": node.lineno,
                        "line_end": node.end_lineno,
                        "parameters": [a.arg for a in node.args.args],
                        "is_async": isinstance(node, ast.AsyncFunctionDef),
                        "decorators": [ast.unparse(d) for d in node.decorator_list],
                        "docstring": ast.get_docstring(node),
                        "source_code": ast.get_source_segment(code, node),
                        "calls": _called(node),
                    }
                )
            case ast.Import():
                found["imports"] += [
                    {"type": "import", "module": a.name, "name": None, "alias": a.asname, "level": 0} for a in node.names
                ]
            case ast.ImportFrom():
                found["imports"] += [
                    {"type": "from", "module": node.module, "name": a.name, "alias": a.asname, "level": node.level}
                    for a in node.names
                ]
        stack.extend((child, owner) for child in reversed(list(below)))
    return found


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, code in zip(batch["file_path"], batch["code"]):
            items = None if code is None else _structure(code)
            rows.append({"file_path": path, "parsed": items is not None} | (items or {"functions": [], "classes": [], "imports": []}))
        yield pd.DataFrame(rows, columns=["file_path", "parsed", "functions", "classes", "imports"])


def extract_structure(sources: DataFrame) -> DataFrame:
    """Structure of each row of ``sources`` (file_path, code); ``parsed`` is false where there is none.

    The syntax tree needs Python, so this one step runs over Arrow batches; each
    file is on its own. Parsing costs far more than moving, and a table of sources
    may be one block of a file, so the sources are dealt out first. The number of
    parts is given, else they would be joined again for being small.
    """
    spark = sources.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = sources.select("file_path", "code").repartition(parts, "file_path")
    return dealt.mapInPandas(_extract, SCHEMA)


def repository_dataset(files: DataFrame, structure: DataFrame) -> DataFrame:
    """One row per parsed file with its facts and structure."""
    return files.join(structure.filter("parsed").drop("parsed"), "file_path")


def summary(files: DataFrame, structure: DataFrame) -> DataFrame:
    """Files, parsed and failed ones, and items found, in one row."""
    counts = structure.agg(
        F.count_if("parsed").alias("parsed_files"),
        F.count_if(~F.col("parsed")).alias("failed_files"),
        *[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("functions", "classes", "imports")],
    )
    return counts.withColumn("source_files", files.agg(F.count(F.lit(1))).scalar())


def _items(structure: DataFrame, column: str) -> DataFrame:
    return structure.select("file_path", F.posexplode(column).alias("position", "item")).select("file_path", "position", "item.*")


def function_table(structure: DataFrame) -> DataFrame:
    return _items(structure, "functions")


def class_table(structure: DataFrame) -> DataFrame:
    return _items(structure, "classes")


def import_table(structure: DataFrame) -> DataFrame:
    return _items(structure, "imports").withColumnRenamed("type", "kind")


def call_table(structure: DataFrame) -> DataFrame:
    return function_table(structure).select(
        "file_path", "qualified_name", "parent_class", "line_start", F.explode("calls").alias("call")
    )


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def code_files(files: DataFrame, path: Column | None = None) -> DataFrame:
    """Files of a tree that count as source, with language and name.

    ``files`` has file_path (relative) and size_bytes. Ignored directory names
    exclude a file wherever they occur in its path.
    """
    where = F.col("file_path") if path is None else path
    return (
        files.filter(~paths.in_ignored_directory(where))
        .withColumns({"language": paths.language(where), "extension": paths.suffix(where), "filename": F.substring_index(where, "/", -1)})
        .filter("language is not null")
    )
