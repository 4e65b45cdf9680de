"""Import and call resolution of a code base as joins; node and edge tables.

Input tables (one row per item, Python files only):

* ``files``: file_path, and for the graph language and size_bytes
* ``functions``: file_path, name, qualified_name, parent_class, line_start
* ``classes``: file_path, name, line_start
* ``imports``: file_path, kind ("import" or "from"), module, name, alias, level
  and a position that orders the imports of a file
* ``calls``: the columns of the calling function that make its id, parent_class,
  and call, the dotted name as written
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake.functions.paths import module_name
from patchlake.session import stored


def item_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat(path, F.lit("::"), name, F.lit("::L"), line)


def function_id() -> Column:
    return item_id(F.col("file_path"), F.col("qualified_name"), F.col("line_start"))


def own_method(call: Column, parent_class: Column) -> Column:
    """``self.x`` inside class C means ``C.x``; other calls stay as written."""
    return F.when(
        call.startswith("self.") & F.coalesce(parent_class != "", F.lit(False)),
        F.concat(parent_class, F.lit("."), F.substring(call, 6, 2147483647)),
    ).otherwise(call)


# --- modules and imports --------------------------------------------------


def module_map(files: DataFrame, order: str = "file_path") -> DataFrame:
    """File of each module; of several files for one module the last in ``order``."""
    named = files.filter(F.col("file_path") != "").select(
        module_name(F.col("file_path")).alias("module"), "file_path", F.col(order).alias("__order")
    )
    return named.filter("module is not null").groupBy("module").agg(F.max_by("file_path", "__order").alias("target_path"))


def _prefixes(dotted: Column) -> Column:
    """The dotted name and its prefixes, longest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def _candidates(kind: Column, module: Column, name: Column) -> Column:
    """Modules an import may mean, best first."""
    whole = F.array(module)
    prefixes = _prefixes(module)
    member = F.when((kind == "from") & F.coalesce(name != "", F.lit(False)), F.array(F.concat_ws(".", module, name)))
    empty = F.array().cast("array<string>")
    return F.when(module != "", F.concat(whole, F.coalesce(member, empty), F.slice(prefixes, 2, F.size(prefixes)))).otherwise(empty)


def resolve_modules(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """Target file of each distinct (kind, module, name); rows without one are left out.

    All candidates are looked up by one join and the best one found is kept.
    """
    keys = ["kind", "module", "name"]
    distinct = wanted.select(*keys).distinct()
    ranked = distinct.select(*keys, F.posexplode(_candidates(F.col("kind"), F.col("module"), F.col("name"))).alias("choice", "candidate"))
    known = modules.select(F.col("module").alias("candidate"), "target_path")
    return ranked.join(known, "candidate").groupBy(*keys).agg(F.min_by("target_path", "choice").alias("target_path"))


def resolve_imports(imports: DataFrame, modules: DataFrame, resolve_relative: bool = False) -> DataFrame:
    """Imports with ``target_path``, null where the import leaves the code base.

    The number of leading dots is ignored by default: ``from .app import x``
    looks for a module ``app``. ``resolve_relative`` puts the package of the
    importing file in front instead.
    """
    asked = imports
    module = F.col("module")
    if resolve_relative:
        own = F.split(module_name(F.col("file_path")), r"\.")
        is_package = F.col("file_path").endswith("__init__.py")
        depth = F.size(own) - F.col("level") + F.when(is_package, 1).otherwise(0)
        package = F.array_join(F.slice(own, F.lit(1), F.greatest(depth, F.lit(0))), ".")
        module = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(package, F.lit("")), F.nullif(module, F.lit("")))).otherwise(module)
    asked = asked.withColumn("__module", module)
    found = resolve_modules(asked.select("kind", F.col("__module").alias("module"), "name"), modules)
    return _join_keys(asked, found, {"kind": "kind", "__module": "module", "name": "name"}).drop("__module")


def _join_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on keys that may be null; ``right`` has one row per key."""
    renamed = right.withColumnsRenamed({r: f"__r_{r}" for r in keys.values()})
    condition = None
    for l, r in keys.items():
        test = F.col(l).eqNullSafe(F.col(f"__r_{r}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, "left").drop(*[f"__r_{r}" for r in keys.values()])


def visible_names(imports: DataFrame, position: str) -> DataFrame:
    """Names each file can use because of its imports; a later import of a name wins."""
    alias = F.nullif(F.col("alias"), F.lit(""))
    visible = F.when(F.col("kind") == "from", F.coalesce(alias, F.col("name"))).otherwise(
        F.coalesce(alias, F.substring_index("module", ".", 1))
    )
    usable = (F.col("kind") == "from") | (F.col("module") != "")
    value = F.struct("module", F.when(F.col("kind") == "from", F.col("name")).alias("name"))
    return (
        imports.filter(usable)
        .withColumn("visible", visible)
        .filter(F.col("visible") != "")
        .groupBy("file_path", "visible")
        .agg(F.max_by(value, position).alias("bound"))
        .select("file_path", "visible", F.col("bound.module").alias("bound_module"), F.col("bound.name").alias("bound_name"))
    )


# --- calls ----------------------------------------------------------------


def _lookup_rows(functions: DataFrame) -> DataFrame:
    names = F.array_distinct(F.array("qualified_name", "name"))
    return functions.select("file_path", F.explode(names).alias("known"), function_id().alias("id")).distinct()


def file_lookup(functions: DataFrame) -> DataFrame:
    """Per file and name, qualified or simple: number of functions and one id."""
    return _lookup_rows(functions).groupBy("file_path", "known").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def global_lookup(functions: DataFrame) -> DataFrame:
    return _lookup_rows(functions).groupBy("known").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))


def _find_in_file(wanted: DataFrame, lookup: DataFrame, path: str, name: str, out: str) -> DataFrame:
    """Adds count and id of ``name`` in the file; if there is none, of its last part."""
    rows = lookup.select(F.col("file_path").alias("__p"), F.col("known").alias("__k"), F.struct("n", "id").alias("__hit"))
    last = F.element_at(F.split(F.col(name), r"\."), -1)
    found = wanted.withColumn("__last", last)
    for key, hit in ((name, "__whole"), ("__last", "__part")):
        found = found.join(rows, (F.col(path) == F.col("__p")) & (F.col(key) == F.col("__k")), "left")
        found = found.withColumnRenamed("__hit", hit).drop("__p", "__k")
    return found.withColumn(out, F.coalesce("__whole", "__part")).drop("__last", "__whole", "__part")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, modules: DataFrame, position: str) -> DataFrame:
    """Calls with ``target_id``, ``resolution`` and ``disposition``.

    Same file first, then the whole code base, then imports; only a step that
    finds nothing passes the call on, so a name found twice stays ambiguous.
    The cascade runs over distinct (file, class, call): a name that is called
    everywhere is resolved once per file, not once per call.
    """
    keys = ["file_path", "parent_class", "call"]
    distinct = calls.select(*keys).distinct().withColumn("target", own_method(F.col("call"), F.col("parent_class")))
    per_file = stored(file_lookup(functions), "file_lookup")
    local = _find_in_file(distinct, per_file, "file_path", "target", "same_file")
    everywhere = global_lookup(functions).select(F.col("known").alias("target"), F.struct("n", "id").alias("direct"))
    # Both later steps and the answers read these rows; they are made once.
    direct = stored(local.join(everywhere, "target", "left"), "direct")

    first = F.substring_index("call", ".", 1)
    rest = F.when(F.contains(F.col("call"), F.lit(".")), F.nullif(F.substring(F.col("call"), F.length(first) + 2, F.lit(2147483647)), F.lit("")))
    open_calls = (
        direct.filter(F.col("same_file").isNull() & F.col("direct").isNull())
        .select("file_path", "call")
        .distinct()
        .withColumns({"visible": first, "rest": rest})
    )
    bound = (
        open_calls.join(visible_names(imports, position), ["file_path", "visible"])
        .withColumn("name", F.nullif(F.concat_ws(".", "bound_name", "rest"), F.lit("")))
        .filter("bound_module is not null and name is not null")
        .withColumns({"kind": F.lit("from"), "module": F.col("bound_module")})
    )
    placed = bound.join(resolve_modules(bound, modules), ["kind", "module", "name"])
    imported = _find_in_file(placed.select("file_path", "call", "name", "target_path"), per_file, "target_path", "name", "imported")
    imported = imported.filter("imported is not null").select("file_path", "call", "imported")

    hit = F.coalesce("same_file", "direct", "imported")
    step = (
        F.when(F.col("same_file").isNotNull(), "same_file").when(F.col("direct").isNotNull(), "direct").otherwise("import")
    )
    n = F.coalesce(hit["n"], F.lit(0))
    answers = direct.join(imported, ["file_path", "call"], "left").select(
        *keys,
        F.when(n == 1, hit["id"]).alias("target_id"),
        F.when(n == 1, step).alias("resolution"),
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("disposition"),
    )
    return _join_keys(calls, answers, {k: k for k in keys})


def plain_call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls looked up by qualified name over the whole code base only.

    A name that several function rows share is ambiguous, even if two of the
    rows have the same id.
    """
    names = functions.select(F.col("qualified_name").alias("target"), function_id().alias("id"))
    lookup = names.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id"))
    n = F.coalesce("n", F.lit(0))
    return (
        calls.withColumn("target", own_method(F.col("call"), F.col("parent_class")))
        .join(lookup, "target", "left")
        .withColumn("disposition", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved"))
        .withColumn("target_id", F.when(n == 1, F.col("target_id")))
        .drop("target", "n")
    )


def plain_edges(resolved: DataFrame) -> DataFrame:
    """Edges of the plain call graph; parallel calls make one edge."""
    return resolved.filter("target_id is not null").select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst")).distinct()


# --- nodes and edges ------------------------------------------------------


def _merged(df: DataFrame) -> DataFrame:
    """Items with the same id as one node."""
    others = [c for c in df.columns if c != "id"]
    return df.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) if c == "node_type" else F.max(c).alias(c) for c in others])


def function_nodes(functions: DataFrame) -> DataFrame:
    """Nodes of functions and methods, the only ends of calls."""
    return _merged(
        functions.select(
            function_id().alias("id"), F.lit("function").alias("node_type"), "name", "qualified_name", "parent_class",
            F.when(F.col("parent_class") != "", "method").otherwise("function").alias("function_type"),
            F.col("file_path").alias("file"), "line_start",
        )
    )


def nodes(repository: str, files: DataFrame, classes: DataFrame, functions: DataFrame, resolved_imports: DataFrame) -> DataFrame:
    """One row per node id over the five node types."""
    spark = files.sparkSession
    root = spark.range(1).select(
        F.lit(f"repository:{repository}").alias("id"), F.lit("repository").alias("node_type"), F.lit(repository).alias("name")
    )
    optional = [c for c in ("language", "size_bytes") if c in files.columns]
    file_nodes = files.select(
        F.concat(F.lit("file::"), "file_path").alias("id"), F.lit("file").alias("node_type"), F.col("file_path").alias("path"), *optional
    )
    class_nodes = classes.select(
        item_id(F.col("file_path"), F.col("name"), F.col("line_start")).alias("id"),
        F.lit("class").alias("node_type"), "name", F.col("file_path").alias("file"), "line_start",
    )
    external = external_imports(resolved_imports).select("external").distinct().select(
        F.concat(F.lit("external_module::"), "external").alias("id"), F.lit("external_module").alias("node_type"), F.col("external").alias("name")
    )
    result = root
    for part in (file_nodes, _merged(class_nodes), function_nodes(functions), external):
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def external_imports(resolved_imports: DataFrame) -> DataFrame:
    name = F.coalesce("module", "name")
    return resolved_imports.filter("target_path is null").withColumn("external", name).filter(F.col("external") != "")


def contains_edges(repository: str, files: DataFrame, classes: DataFrame, functions: DataFrame, class_order: str = "line_start") -> DataFrame:
    """Repository to file, file to class, class or file to function."""
    relation = F.lit("CONTAINS").alias("relation")
    file_id = F.concat(F.lit("file::"), "file_path")
    class_id = item_id(F.col("file_path"), F.col("name"), F.col("line_start"))
    to_files = files.select(F.lit(f"repository:{repository}").alias("src"), file_id.alias("dst"), relation)
    to_classes = classes.select(file_id.alias("src"), class_id.alias("dst"), relation)
    owner = classes.groupBy("file_path", F.col("name").alias("parent_class")).agg(F.max_by(class_id, class_order).alias("class_id"))
    to_functions = functions.join(owner, ["file_path", "parent_class"], "left").select(
        F.coalesce("class_id", file_id).alias("src"), function_id().alias("dst"), relation
    )
    return to_files.unionByName(to_classes).unionByName(to_functions)


def import_edges(resolved_imports: DataFrame) -> DataFrame:
    src = F.concat(F.lit("file::"), "file_path").alias("src")
    facts = [F.col("kind").alias("import_type"), "module", F.col("name").alias("imported_name"), "alias", "level"]
    internal = resolved_imports.filter("target_path is not null").select(
        src, F.concat(F.lit("file::"), "target_path").alias("dst"), F.lit("IMPORTS_INTERNAL").alias("relation"), *facts
    )
    outside = external_imports(resolved_imports).select(
        src, F.concat(F.lit("external_module::"), "external").alias("dst"), F.lit("IMPORTS_EXTERNAL").alias("relation"),
        *[f for f in facts if not (isinstance(f, str) and f == "module")],
    )
    return internal.unionByName(outside, allowMissingColumns=True)


def call_edges(resolved_calls: DataFrame) -> DataFrame:
    """One edge per resolved call; parallel edges stay."""
    return resolved_calls.filter("target_id is not null").select(
        F.col("caller_id").alias("src"), F.col("target_id").alias("dst"), F.lit("CALLS").alias("relation"),
        F.col("call").alias("original_call"), "resolution",
    )


def resolution_stats(resolved_calls: DataFrame, resolved_imports: DataFrame) -> DataFrame:
    """The eight counters in one row."""
    calls = resolved_calls.select(F.coalesce("resolution", "disposition").alias("outcome"))
    imports = resolved_imports.select(
        F.when(F.col("target_path").isNotNull(), "internal").when(F.coalesce("module", "name") != "", "external").alias("outcome")
    )
    outcomes = calls.unionByName(imports).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))

    def total(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome").isin(*names), F.col("n"))), F.lit(0))

    return outcomes.agg(
        total("same_file", "direct", "import").alias("resolved_calls"),
        total("ambiguous").alias("ambiguous_calls"),
        total("unresolved").alias("unresolved_calls"),
        total("internal").alias("internal_imports"),
        total("external").alias("external_imports"),
        total("direct").alias("direct_resolved"),
        total("same_file").alias("same_file_resolved"),
        total("import").alias("import_resolved"),
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per node type or per relation."""
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("records"))


def first_edges(edges: DataFrame, node_table: DataFrame, relation: str, limit: int, order: list[str]) -> DataFrame:
    """The first edges of a relation with the attributes of both ends.

    The limit comes before the joins, so they see ``limit`` edges only; the
    chosen ends are looked up among the nodes once for both sides.
    """
    chosen = stored(edges.filter(F.col("relation") == relation).orderBy(*order).limit(limit), "first_edges")
    ends = chosen.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    file = F.coalesce(*[c for c in ("file", "path") if c in node_table.columns])
    found = stored(node_table.join(ends, "id", "left_semi").select("id", "qualified_name", file.alias("file")), "first_nodes")
    result = chosen
    for end in ("src", "dst"):
        names = found.select(F.col("id").alias(end), F.col("qualified_name").alias(f"{end}_name"), F.col("file").alias(f"{end}_file"))
        result = result.join(names, end, "left")
    return result


# --- subgraphs ------------------------------------------------------------


def find_nodes(node_table: DataFrame, text: str) -> DataFrame:
    """Nodes whose qualified name contains ``text``."""
    return node_table.filter(F.contains(F.coalesce("qualified_name", F.lit("")), F.lit(text)))


def display_label(node_table: DataFrame) -> DataFrame:
    candidates = [F.nullif(F.col(c), F.lit("")) for c in ("qualified_name", "name", "path")]
    return node_table.withColumn("label", F.coalesce(*candidates, F.col("id")))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """Ids within ``depth`` steps of ``start`` (column id), edges taken both ways, with the step.

    Each step looks up the frontier in the edges from both ends; the frontier is
    made distinct, rid of known ids and stored before it is used again, so the
    plan of a step does not repeat the earlier ones. An empty frontier ends it.
    """
    pairs = stored(edges.select("src", "dst").distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    frontier = stored(start.select("id").distinct().withColumn("step", F.lit(0)), "frontier")
    seen = frontier
    for step in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = stored(reached.join(seen, "id", "left_anti").withColumn("step", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    inside = ids.select("id")
    return edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(
        inside.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
