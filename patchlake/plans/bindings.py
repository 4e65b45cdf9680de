"""The given tables as change-history tables.

Each binding is one select; the column expressions are valid in Spark SQL and in
DuckDB, so a result can be compared between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUBJECT = """case o_orderkey % 12
    when 0 then 'Fix crash in parser #12'
    when 1 then 'Add support for new config'
    when 2 then 'fix typo in docs'
    when 3 then 'Merge branch main'
    when 4 then 'Resolve issue 7: wrong result, add test'
    when 5 then 'Update tests after rename'
    when 6 then 'Prevent failure and broken state; regression test'
    when 7 then 'Improve error message'
    when 8 then 'prefix cleanup'
    when 9 then 'Release 1.2'
    when 10 then 'Implement feature, fixes bug'
    else '' end"""

COMMITS = {
    "commit_hash": "concat('c', o_orderkey)",
    "repo_id": "concat('repo', o_custkey % 15)",
    "author": "concat('dev', o_custkey % 40)",
    "ts": "o_orderdate",
    "parent_count": "case when o_orderkey % 50 = 0 then 0 when o_orderkey % 11 = 0 then 2 else 1 end",
    "subject": SUBJECT,
    "body": "o_orderstatus",
}

CHANGE_PATH = """case when l_partkey % 37 = 0 then 'web/package-lock.json'
    when l_suppkey % 6 = 5 then concat('tests/test_m', l_partkey % 40, '.py')
    else concat('src/pkg', l_suppkey % 6, '/m', l_partkey % 40,
                case l_partkey % 5 when 3 then '.js' when 4 then '.md' else '.py' end) end"""

CHANGES = {
    "commit_hash": "concat('c', l_orderkey)",
    "file_path": CHANGE_PATH,
}
CHANGE_SUMS = {
    "insertions": "sum(cast(l_quantity as bigint))",
    "deletions": "sum(cast(l_linenumber as bigint))",
    "flag": "max(l_returnflag)",
}

FUNCTION_FILE = "concat('src/pkg', p_size % 6, '/m', p_partkey % 40, '.py')"
FUNCTIONS = {
    "fn_no": "p_partkey",
    "file_path": FUNCTION_FILE,
    "name": "concat('f', p_partkey % 1520)",
    "parent_class": "case when p_partkey % 4 = 0 then concat('C', p_partkey % 7) end",
    "line_start": "cast(p_partkey % 500 + 1 as int)",
}

CALLS = {
    "fn_no": "l_partkey",
    "call": """case l_linenumber % 4
    when 0 then concat('self.f', l_suppkey * 4 % 1520)
    when 1 then concat('f', l_orderkey % 1520)
    when 2 then concat('m', l_suppkey % 40, '.f', l_orderkey % 1520)
    else 'os.path.join' end""",
}

IMPORTS = {
    "file_path": FUNCTION_FILE,
    "kind": "case when l_linenumber % 2 = 0 then 'import' else 'from' end",
    "module": """case l_linenumber % 5
    when 0 then 'os'
    when 1 then concat('pkg', l_suppkey % 6)
    when 2 then concat('pkg', l_suppkey % 6, '.m', l_suppkey % 40)
    when 3 then concat('pkg', l_suppkey % 6, '.m', l_suppkey % 40, '.deep')
    end""",
    "name": "case when l_linenumber % 2 = 1 then concat('m', l_orderkey % 40) end",
    "alias": "case when l_suppkey % 3 = 0 then concat('m', l_suppkey % 40) end",
    "level": "case when l_linenumber % 2 = 1 and l_suppkey % 7 = 0 then 1 else 0 end",
}
IMPORT_POSITION = "concat(kind, '|', coalesce(module, ''), '|', coalesce(name, ''), '|', coalesce(alias, ''), '|', level)"

REPOSITORIES = {
    "repo_id": "concat('cust', c_custkey)",
    "name": "c_name",
    "owner": "c_mktsegment",
    "clone_url": "concat('https://example.org/', c_custkey)",
    "language": "case when c_nationkey % 5 = 0 then 'java' when c_nationkey % 7 = 3 then null else 'Python' end",
    "license": """case c_custkey % 6 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'GPL-3.0'
        when 4 then 'ISC' when 5 then 'BSD-3-Clause' end""",
    "is_fork": "c_custkey % 11 = 0",
    "archived": "c_custkey % 13 = 0",
    "collection_status": "case c_custkey % 9 when 0 then 'failed' when 1 then 'pending' when 2 then null else 'complete' end",
    "quality_status": "case c_custkey % 4 when 0 then 'accepted' when 1 then 'review' end",
    "source_file_count": "case when c_custkey % 19 = 0 then null else c_custkey % 60 end",
}


def _select(exprs: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in exprs.items()]


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(COMMITS))


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per commit and path, with line counts.

    Rows are dealt out by commit, which serves the aggregate and what is joined or
    counted per commit afterwards. Lines hardly share a path within a commit, so
    nothing could be combined before the shuffle.
    """
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_select(CHANGES), "l_quantity", "l_linenumber", "l_returnflag")
    return rows.repartition("commit_hash").groupBy("commit_hash", "file_path").agg(*[F.expr(e).alias(n) for n, e in CHANGE_SUMS.items()])


def file_changes(spark: SparkSession, sf_dir: str, of_message: dict[str, Column] | None = None) -> DataFrame:
    """File changes with the author, time and message of their commit, or with columns made of the message where commits are read."""
    info = commits(spark, sf_dir).select(
        "commit_hash",
        "repo_id",
        F.col("author").alias("author_name"),
        F.lit(None).cast("string").alias("author_email"),
        F.col("ts").alias("timestamp"),
        F.col("subject").alias("message"),
        "parent_count",
    )
    if of_message:
        info = info.withColumns(of_message).drop("message")
    return numstat(spark, sf_dir).join(info, "commit_hash")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as patches: every line gets a mark that depends on its length and place."""
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.length(line) + i) % 3 + 1), line),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array_join(marked, "\n").alias("patch"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr(*_select(FUNCTIONS))
        .withColumn("qualified_name", F.concat_ws(".", "parent_class", "name"))
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a file; two of seven names are left undefined."""
    return (
        functions(spark, sf_dir)
        .filter(F.col("parent_class").isNotNull() & ~F.col("parent_class").isin("C5", "C6"))
        .groupBy("file_path", F.col("parent_class").alias("name"))
        .agg(F.min("line_start").alias("line_start"))
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_select(CALLS))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*_select(IMPORTS)).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(spark, sf_dir).select("file_path").distinct().withColumn("language", F.lit("python"))


def positioned_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports(spark, sf_dir).withColumn("position", F.expr(IMPORT_POSITION))


def caller_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the file, class and id of the calling function."""
    callers = functions(spark, sf_dir).select(
        "fn_no", "file_path", "parent_class",
        F.concat("file_path", F.lit("::"), "qualified_name", F.lit("::L"), "line_start").alias("caller_id"),
    )
    return calls(spark, sf_dir).join(callers, "fn_no")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories; ten commits per order, none known for some."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 10).alias("n"))
    known = F.expr("case when c_custkey % 17 = 0 then null else coalesce(n, 0) end").alias("commit_count")
    customers = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return customers.selectExpr("c_custkey", *_select(REPOSITORIES), "n").withColumn("commit_count", known).drop("n")


def repository_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen repositories that the commits belong to."""
    return commits(spark, sf_dir).select("repo_id").distinct().select(
        "repo_id", F.col("repo_id").alias("name"), F.lit("someone").alias("owner"),
        F.expr("case when repo_id in ('repo3', 'repo8') then 'java' else 'Python' end").alias("language"),
        F.concat(F.lit("https://example.org/"), "repo_id").alias("clone_url"),
    )


def commit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files by the hash of their commit, which is all that names it here."""
    return numstat(spark, sf_dir).select(
        "commit_hash", F.col("file_path").alias("path"),
        F.col("insertions").alias("added_lines"), F.col("deletions").alias("deleted_lines"),
    )


def commit_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch of a commit is that of the document with its author's customer number; some have none."""
    text = patches(spark, sf_dir).select(F.col("doc_id").alias("o_custkey"), "patch", F.length("patch").alias("patch_chars"))
    keys = table(spark, sf_dir, "orders").selectExpr("o_custkey", *[f"{COMMITS[c]} as {c}" for c in ("repo_id", "commit_hash")])
    return keys.join(text, "o_custkey").drop("o_custkey")


def patched_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with their parent and the key of their patch in :func:`patch_texts`."""
    return table(spark, sf_dir, "orders").selectExpr(*_select(COMMITS), "o_custkey as patch_id").withColumn(
        "parent", F.concat(F.lit("p"), "commit_hash")
    )


def patch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patch; several commits may have the same one."""
    return patches(spark, sf_dir).select(F.col("doc_id").alias("patch_id"), "patch", F.length("patch").alias("patch_chars"))


def documents_as_file_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file diff per document, in the commit with the same number."""
    return patches(spark, sf_dir).select(
        F.concat(F.lit("c"), "doc_id").alias("commit_hash"),
        F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.concat(F.lit("src/"), "source", F.lit(".py"))).alias("new_path"),
        F.concat(F.lit("old/"), "source", F.lit(".py")).alias("old_path"),
        (F.col("lang") == "de").alias("added"), (F.col("lang") == "fr").alias("deleted"), (F.col("lang") == "es").alias("renamed"),
        "patch",
    )


# --- the same tables as DuckDB common table expressions --------------------


def _sql_select(exprs: dict[str, str]) -> str:
    return ", ".join(_select(exprs))


CTE = {
    "commits": f"select {_sql_select(COMMITS)} from orders",
    "numstat": f"select {_sql_select(CHANGES)}, cast(sum(cast(l_quantity as bigint)) as bigint) as insertions, "
    "cast(sum(cast(l_linenumber as bigint)) as bigint) as deletions, max(l_returnflag) as flag from lineitem group by 1, 2",
    "file_changes": "select n.*, c.repo_id, c.author as author_name, c.ts as timestamp, c.subject as message, c.parent_count "
    "from numstat n join commits c using (commit_hash)",
    "patches": "select doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), "
    "lambda line, i: ['+', '-', ' '][(length(line) + i - 1) % 3 + 1] || line), chr(10)) as patch from documents",
    "functions": f"select *, case when parent_class is null then name else parent_class || '.' || name end as qualified_name "
    f"from (select {_sql_select(FUNCTIONS)} from part)",
    "classes": "select file_path, parent_class as name, min(line_start) as line_start from functions "
    "where parent_class is not null and parent_class not in ('C5', 'C6') group by 1, 2",
    "calls": f"select {_sql_select(CALLS)} from lineitem",
    "files": "select distinct file_path from functions",
    "callers": "select fn_no, file_path, parent_class, file_path || '::' || qualified_name || '::L' || line_start as caller_id, "
    "call from calls join functions using (fn_no)",
    "repositories": f"select c_custkey, {_sql_select(REPOSITORIES)}, case when c_custkey % 17 = 0 then null else coalesce(n, 0) end as commit_count "
    "from customer left join (select o_custkey, count(*) * 10 as n from orders group by 1) on c_custkey = o_custkey",
    "commit_patches": f"select {COMMITS['repo_id']} as repo_id, {COMMITS['commit_hash']} as commit_hash, patch "
    "from orders join patches on doc_id = o_custkey",
    "file_patches": "select 'c' || doc_id as commit_hash, case when lang <> 'fr' then 'src/' || source || '.py' end as new_path, "
    "'old/' || source || '.py' as old_path, lang = 'de' as added, lang = 'fr' as deleted, lang = 'es' as renamed, patch from patches",
    "positioned_imports": f"select *, {IMPORT_POSITION} as position from imports",
    "imports": f"select distinct {_sql_select(IMPORTS)} from lineitem join part on l_partkey = p_partkey",
}
_NEEDS = {
    "file_changes": ["commits", "numstat"],
    "classes": ["functions"],
    "files": ["functions"],
    "callers": ["functions", "calls"],
    "commit_patches": ["patches"],
    "file_patches": ["patches"],
    "positioned_imports": ["imports"],
}


def with_bindings(names: list[str], query: str) -> str:
    """``query`` with the bindings it uses placed before it."""
    ordered: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    ctes = ",\n".join(f"{n} as ({CTE[n]})" for n in ordered)
    body = query.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
