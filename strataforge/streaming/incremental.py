"""Incremental maintenance of a catalog, in one batch or as a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from ..catalog import Catalog, analyse
from ..operators import graph, ranking, resolve
from ..schemas import UNIT_CHILDREN
from ..sources.files import is_env_example


def apply_changes(c: Catalog, changes: DataFrame, files: DataFrame) -> Catalog:
    """The catalog after ``changes`` (file_path, change_type, old_path), reading new text from ``files``.

    Rows of changed files go by anti-join, rows of the new versions come from the same
    extraction as a full run. Deep rows of changed files are made again, calls are
    resolved again, and clusters and templates, which look at everything, are derived anew.
    """
    gone = changes.select("file_path").union(changes.where("old_path IS NOT NULL").select(F.col("old_path").alias("file_path"))).distinct()
    fresh_paths = changes.where("change_type <> 'deleted'").select("file_path").distinct()
    fresh = analyse(files.join(fresh_paths, "file_path", "left_semi").select(files.columns))
    dead = c["code_units"].join(gone, "file_path", "left_semi")
    kept = c.drop_units(dead.select("id"))
    tables = {"files": _swap(c["files"], fresh["files"], gone, "file_path"), "code_units": kept["code_units"].unionByName(fresh["code_units"])}
    for name in UNIT_CHILDREN:
        if name != "pattern_templates":
            tables[name] = kept[name].unionByName(fresh[name])
    tables["file_dependencies"] = _swap(c["file_dependencies"], fresh["file_dependencies"], gone, "source_file")
    tables["module_patterns"] = _swap(c["module_patterns"], fresh["module_patterns"], gone, "file_path")
    old_models = c["schema_models"].join(gone, "file_path", "left_anti").select(c["schema_models"].columns)
    tables["schema_models"] = old_models.unionByName(fresh["schema_models"])
    fields = c["schema_model_fields"]
    tables["schema_model_fields"] = fields.join(old_models.select(F.col("id").alias("model_id")), "model_id", "left_semi").select(fields.columns).unionByName(fresh["schema_model_fields"])
    env_changed = not changes.where(is_env_example(F.col("file_path"))).isEmpty()
    tables["env_variables"] = fresh["env_variables"] if env_changed else c["env_variables"]
    tables["file_hashes"] = _swap(c["file_hashes"], fresh["file_hashes"], gone, "file_path")
    for name in ("code_units", "code_unit_patterns", "file_dependencies"):
        tables[name] = graph.settle(tables[name], name)
    # A target may have gone or become ambiguous: all calls are resolved from their names again.
    calls = tables["function_calls"].drop("callee_unit_id", "callee_file_path").withColumns({"callee_unit_id": F.lit(None).cast("string"), "callee_file_path": F.lit(None).cast("string")})
    calls = graph.settle(calls, "calls")
    found = resolve.resolve_calls(calls, tables["code_units"]).select("id", F.col("callee_unit_id").alias("u"), F.col("callee_file_path").alias("f"))
    calls = calls.join(found, "id").withColumns({"callee_unit_id": F.col("u"), "callee_file_path": F.col("f")})
    tables["function_calls"] = calls.select(c["function_calls"].columns)
    tables["file_clusters"], tables["file_cluster_members"] = graph.clusters(tables["file_dependencies"])
    top = tables["code_units"].where("parent_unit_id IS NULL")
    tables["pattern_templates"], tables["pattern_template_followers"] = ranking.templates(top, tables["code_unit_patterns"])
    return Catalog(c.spark, tables)


def _swap(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.withColumnRenamed("file_path", key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Parts of a merged table: a batch rewrites only those that its keys fall in.
PARTS = 64


def stream_latest(reader: DataStreamReader, source: str, target: str, checkpoint: str, key: str, order: list[str], parts: int = PARTS) -> StreamingQuery:
    """A file stream merged into ``target``: Parquet with the last row of each key.

    Each micro-batch is reduced to one row a key and joined with the parts of the table that
    its keys fall in; these are written to a version folder named by the batch, so a batch that
    is run again after a failure writes the same folder. A part's newest folder counts; folders
    that no reader and no second try needs any more are deleted. ``parts`` stays the same for a table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = latest(batch, key, order).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        own = graph.settle(own, "stream-batch")
        touched = {r[0] for r in own.select("__part").distinct().collect()}
        before = _parts(spark, target, number)
        paths = [before[p][0] for p in sorted(touched & before.keys())]
        whole = own.drop("__part")
        if paths:
            whole = latest(spark.read.schema(batch.schema).parquet(*paths).unionByName(whole), key, order)
        whole = whole.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        whole.write.mode("overwrite").partitionBy("__part").parquet(f"{target}/v{number:012d}")
        graph.forget(own)
        for versions in before.values():
            _delete(spark, *versions[1:])

    return reader.load(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _names(spark, folder: str, start: str) -> list[str]:
    """Names below a folder that begin so, in order; none without the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith(start)) if fs.exists(path) else []


def _versions(spark, target: str, before: int | None = None) -> list[str]:
    """Version folders, the newest first; only those before a batch, if one is given."""
    return [f"{target}/{n}" for n in reversed(_names(spark, target, "v")) if before is None or int(n[1:]) < before]


def _parts(spark, target: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each part, the newest first."""
    found: dict[int, list[str]] = {}
    for version in _versions(spark, target, before):
        for name in _names(spark, version, "__part="):
            found.setdefault(int(name.split("=")[1]), []).append(f"{version}/{name}")
    return found


def _delete(spark, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_latest(spark, target: str) -> DataFrame:
    """The merged table as it is now."""
    return spark.read.parquet(*[v[0] for _, v in sorted(_parts(spark, target).items())])


def stream_catalog(reader: DataStreamReader, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """D27 as a stream: file versions (file_path, version, content, deleted) keep a catalog under ``root`` up to date.

    Of a file that comes several times in a batch the highest version counts. The catalog before
    the last stays for readers and for a second try of the batch; older ones are deleted.
    """
    from ..sources.files import with_file_columns

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = graph.settle(latest(batch, "file_path", ["version", "content"]), "batch")
        before = _versions(spark, root, number)
        changes = batch.select("file_path", F.when(F.col("deleted"), "deleted").otherwise("modified").alias("change_type"), F.lit(None).cast("string").alias("old_path"))
        done = apply_changes(Catalog(spark, root=before[0] if before else None), changes, with_file_columns(batch.where("NOT deleted")))
        done.write(f"{root}/v{number:012d}")
        graph.forget(batch)
        _delete(spark, *before[1:])

    return reader.load(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_catalog(spark, root: str) -> Catalog:
    """The catalog that a stream keeps."""
    found = _versions(spark, root)
    return Catalog(spark, root=found[0] if found else None)
