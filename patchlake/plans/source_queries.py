"""Readers and sinks as queries: a given table is written as text by Spark, read back and compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from patchlake.plans import bindings as b
from patchlake.plans.bindings import with_bindings
from patchlake.session import scratch_path
from patchlake.sources import gitlog, tables, tree

QUERIES = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[f"q_{fn.__name__}"] = fn
        if sql:
            ORACLE[f"q_{fn.__name__}"] = sql
        return fn

    return register


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXTS = _schema(doc_id=LongType(), text=StringType(), lang=StringType())
_DOC_COLUMNS = "doc_id, md5(text) as text_md5, case when lang <> 'es' then lang end as lang"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"))


@_query(f"select {_DOC_COLUMNS} from documents")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S3: JSON Lines written and read strictly; blank lines between the records are skipped."""
    path = scratch_path(spark, "jsonl")
    tables.write_jsonl(_texts(spark, sf_dir), f"{path}/a")
    spark.read.text(f"{path}/a").select(F.concat("value", F.lit("\n")).alias("value")).write.text(f"{path}/b")
    return tables.read_jsonl(spark, f"{path}/b", TEXTS).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@_query(
    """select doc_id, md5(text) as text_md5, 'good' as kind from documents where doc_id % 7 <> 0
    union all select null, md5('broken ' || doc_id || ' {'), 'bad' from documents where doc_id % 7 = 0"""
)
def jsonl_lax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: the tolerant reader; lines that are no objects come back as text."""
    path = scratch_path(spark, "jsonl")
    rows = _texts(spark, sf_dir)
    broken = F.concat(F.lit("broken "), F.col("doc_id").cast("string"), F.lit(" {"))
    line = F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.to_json(F.struct(*rows.columns)))
    rows.select(line.alias("value")).write.text(path)
    good, bad = tables.read_jsonl_lax(spark, path, TEXTS)
    return good.select("doc_id", F.md5("text").alias("text_md5"), F.lit("good").alias("kind")).unionByName(
        bad.select(F.lit(None).cast("bigint").alias("doc_id"), F.md5("line").alias("text_md5"), F.lit("bad").alias("kind"))
    )


@_query(
    """with l as (
      select doc_id, lang, doc_id % 7 = 0 as bad,
        coalesce(sum(case when doc_id % 5 = 0 then 2 else 1 end) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from documents)
    select doc_id, lang, cast(before + 1 as bigint) as line_no from l where bad"""
)
def jsonl_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: lines that are no objects, with their numbers in the files of a language laid end to end, blank lines between the records."""
    path = scratch_path(spark, "jsonl")
    rows = _texts(spark, sf_dir).drop("lang").join(b.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    broken = F.concat(F.lit("broken "), F.col("doc_id").cast("string"), F.lit(" {"))
    line = F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.to_json(F.struct(*rows.columns)))
    blank = F.when(F.col("doc_id") % 5 == 0, F.lit("\n")).otherwise(F.lit(""))
    files = rows.select("lang", F.concat(line, blank).alias("value"), "doc_id").repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    files.drop("doc_id").write.partitionBy("lang").text(path)
    bad = tables.bad_lines(spark, path, TEXTS)
    # The parts of a language are in the order of their names; each goes on where the one before it ended.
    group = F.regexp_extract("file", "/lang=([^/]*)/", 1)
    sizes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    earlier = F.sum("lines").over(Window.partitionBy(group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file", F.coalesce(earlier, F.lit(0)).alias("start"))
    return bad.join(starts, "file").select(
        F.regexp_extract("line", r"\d+", 0).cast("bigint").alias("doc_id"), group.alias("lang"), (F.col("start") + F.col("line_no")).alias("line_no")
    )


@_query(
    """select '{"doc_id":' || doc_id || ',"lang":' || case when lang = 'es' then 'null' else '"' || lang || '"' end || ',"source":"é' || source || '"}' as line
    from documents"""
)
def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the text of the sink, with null fields and non-ASCII characters as they are."""
    path = scratch_path(spark, "jsonl")
    rows = _texts(spark, sf_dir).select("doc_id", "lang").join(
        b.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("é"), "source").alias("source")), "doc_id"
    )
    tables.write_jsonl(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@_query("select c_custkey, c_name from customer")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: files of one JSON array each, at most 1,000 objects long; a path without files gives no rows."""
    path = scratch_path(spark, "arrays")
    item = F.struct("c_custkey", "c_name")
    blocks = b.table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 1000").alias("block")).agg(F.collect_list(item).alias("items"))
    blocks.select("block", F.to_json("items").alias("value")).write.partitionBy("block").text(f"{path}/a")
    schema = _schema(c_custkey=LongType(), c_name=StringType())
    none = tables.read_json_array(spark, f"{path}/none", schema)
    return tables.read_json_array(spark, f"{path}/a", schema).select("c_custkey", "c_name").unionByName(none)


_LOG_SQL = """select commit_hash, case when parent_count > 0 then 'p1' || commit_hash else '' end as parent, cast(parent_count as int) as parent_count,
    author, cast(ts as date) as day, trim(subject) as subject, body || chr(10) || '  x' as body from commits where commit_hash not like '%7'"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as a log; those whose hash ends in 7 lack their last field."""
    path = scratch_path(spark, "log")
    rows = b.commits(spark, sf_dir)
    mark = F.lit(gitlog.FIELD_END)
    parents = F.concat_ws(
        " ",
        F.when(F.col("parent_count") > 0, F.concat(F.lit("p1"), "commit_hash")),
        F.when(F.col("parent_count") > 1, F.concat(F.lit("p2"), "commit_hash")),
    )
    body = F.when(~F.col("commit_hash").endswith("7"), F.concat(mark, F.lit("  "), "body", F.lit("\n  x \n"))).otherwise(F.lit(""))
    record = F.concat(
        F.lit("\n"), "commit_hash", mark, parents, mark, "author", mark, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), mark, "subject", body
    )
    rows.select(record.alias("value")).write.option("lineSep", gitlog.RECORD_END).text(path)
    return gitlog.read_commit_log(spark, path, "repo")


@_query(with_bindings(["commits"], _LOG_SQL))
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: a commit log with several records per file."""
    return _log(spark, sf_dir).select(
        "commit_hash", "parent", "parent_count", "author", F.col("ts").cast("date").alias("day"), "subject", "body"
    )


@_query(with_bindings(["commits"], f"select commit_hash, day from ({_LOG_SQL}) order by day desc, commit_hash limit 25"))
def commit_log_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: its first 25 commits, the feature of the reader."""
    log = _log(spark, sf_dir).select("commit_hash", F.col("ts").cast("date").alias("day"))
    return gitlog.first_commits(log, [F.desc("day"), "commit_hash"], 25)


@_query(
    with_bindings(
        ["numstat"],
        """select commit_hash, file_path as path, insertions as added_lines, deletions as deleted_lines from numstat
        where flag <> 'A' and insertions % 13 <> 0""",
    )
)
def numstat_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5: line counts of all commits in a few files, every line with its commit; binary and broken counts go."""
    path = scratch_path(spark, "numstat")
    added = F.when(F.col("flag") == "A", "-").when(F.col("insertions") % 13 == 0, F.concat("insertions", F.lit("x"))).otherwise(
        F.col("insertions").cast("string")
    )
    line = F.concat_ws("\t", F.lit("repo"), "commit_hash", added, F.col("deletions").cast("string"), "file_path")
    b.numstat(spark, sf_dir).select(line.alias("value")).write.text(path)
    return gitlog.read_keyed_numstat(spark, path).select("commit_hash", "path", "added_lines", "deleted_lines")


@_query(
    with_bindings(
        ["numstat"],
        """select commit_hash, case when flag = 'A' then null else file_path end as old_path, case when flag = 'N' then null when flag = 'R' then 'to/' || file_path
        else file_path end as new_path, flag = 'A' as added, flag = 'N' as deleted, flag = 'R' as renamed from numstat""",
    )
)
def name_status_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input of S7: added, deleted, renamed and modified files, every line with its commit."""
    path = scratch_path(spark, "names")
    status = F.when(F.col("flag") == "A", "A").when(F.col("flag") == "N", "D").when(F.col("flag") == "R", "R087").otherwise("M")
    moved = F.when(F.col("flag") == "R", F.concat(F.lit("to/"), "file_path"))
    line = F.concat_ws("\t", F.lit("repo"), "commit_hash", status, "file_path", moved)
    b.numstat(spark, sf_dir).select(line.alias("value")).write.text(path)
    return gitlog.read_name_status(spark, path).drop("repo_id")


@_query(
    with_bindings(
        ["file_patches"],
        "select commit_hash, old_path, new_path, added, deleted, renamed, md5(patch) as patch_md5 from file_patches",
    )
)
def patch_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input of S8: patches with their commit, paths and status, several to a file."""
    path = scratch_path(spark, "patches")
    rows = b.documents_as_file_patches(spark, sf_dir)
    status = F.when(F.col("added"), "A").when(F.col("deleted"), "D").when(F.col("renamed"), "R").otherwise("M")
    fields = [F.lit("repo"), F.col("commit_hash"), status, F.col("old_path"), F.coalesce("new_path", F.lit("")), F.col("patch")]
    record = F.concat_ws(gitlog.FIELD_END, *fields)
    rows.select(record.alias("value")).write.option("lineSep", gitlog.RECORD_END).text(path)
    return gitlog.read_patches(spark, path).select(
        "commit_hash", "old_path", "new_path", "added", "deleted", "renamed", F.md5("patch").alias("patch_md5")
    )


@_query(
    """select 'pkg/src/m' || p_partkey || case p_partkey % 3 when 0 then '.py' when 1 then '.JS' else '.go' end as file_path,
    case p_partkey % 3 when 0 then 'python' when 1 then 'javascript' else 'go' end as language, cast(p_size as bigint) as size_bytes
    from part where p_partkey % 5 <> 0 and p_partkey % 7 <> 0"""
)
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9: a listing of files below a root whose name occurs again inside; ignored folders and other files go."""
    suffix = F.when(F.col("p_partkey") % 7 == 0, ".md").when(F.col("p_partkey") % 3 == 0, ".py").when(F.col("p_partkey") % 3 == 1, ".JS").otherwise(".go")
    folder = F.when(F.col("p_partkey") % 5 == 0, "node_modules/src/").otherwise("pkg/src/")
    listing = b.table(spark, sf_dir, "part").select(
        F.concat(F.lit("file:/src/"), folder, F.lit("m"), "p_partkey", suffix).alias("path"), F.col("p_size").cast("bigint").alias("size_bytes")
    )
    return tree.below(listing, "file:/src").select("file_path", "language", "size_bytes")


@_query("select 'd' || doc_id || '.py' as file_path, md5(text || chr(65533) || 'end') as code_md5 from documents")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11: file bytes as text; bytes that are no UTF-8 vanish, genuine replacement characters stay."""
    content = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.lit("�end").cast("binary"), F.unhex(F.lit("C3")))
    files = b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), content.alias("content")
    )
    return tree.source_text(files).select("file_path", F.md5("code").alias("code_md5"))


_PREDICTED = "case when doc_id % 4 = 0 then 1 else 0 end"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = (F.col("doc_id") % 4 == 0).cast("double") * 0.5 + 0.25
    return b.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("record_id"), F.col("quality").cast("bigint").alias("true_label"),
        F.expr(_PREDICTED).cast("bigint").alias("predicted_label"), (1 - share).alias("probability_non_bug_fix"), share.alias("probability_bug_fix"),
    )


@_query(
    f"""select doc_id::varchar as record_id, quality::bigint as true_label, ({_PREDICTED})::bigint as predicted_label,
    (1 - (0.25 + 0.5 * ({_PREDICTED})))::double as probability_non_bug_fix, (0.25 + 0.5 * ({_PREDICTED}))::double as probability_bug_fix from labels"""
)
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12: prediction records as JSON Lines and back."""
    path = scratch_path(spark, "predictions")
    rows = _predictions(spark, sf_dir)
    tables.write_predictions(rows, path)
    return tables.read_jsonl(spark, path, rows.schema)


@_query(
    f"""select doc_id::varchar as "index", quality::bigint as actual, (1 - (0.25 + 0.5 * ({_PREDICTED})))::double as non_bug_fix_probability,
    (0.25 + 0.5 * ({_PREDICTED}))::double as bug_fix_probability from labels"""
)
def probability_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12: the short form as Parquet and back."""
    path = scratch_path(spark, "probabilities")
    tables.write_parquet(tables.probability_table(_predictions(spark, sf_dir), "record_id"), path)
    return spark.read.parquet(path)
