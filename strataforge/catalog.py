"""The catalog: typed Parquet tables of one analysed corpus."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import graph, imports, lines, patterns, ranking, resolve, units
from .schemas import TABLES, UNIT_CHILDREN, UPSERT_KEYS
from .sources.files import is_env_example, is_schema_file, last_by, should_process


class Catalog:
    """Tables by name: DataFrames given, or Parquet under ``root``; a missing one is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, root: str | None = None):
        self.spark, self.root, self.tables = spark, root, dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            schema = T.StructType.fromDDL(TABLES[name])
            if self.root and self._exists(f"{self.root}/{name}"):
                self.tables[name] = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
            else:
                self.tables[name] = self.spark.createDataFrame([], schema)
        return self.tables[name]

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def migrate(self) -> Catalog:
        """The tables that ``root`` lacks are made, empty; run again it does nothing.

        Columns that an older table lacks are read as null, so they need no step of their own.
        """
        for name, schema in TABLES.items():
            if not self._exists(f"{self.root}/{name}"):
                self.spark.createDataFrame([], T.StructType.fromDDL(schema)).write.parquet(f"{self.root}/{name}")
        return Catalog(self.spark, root=self.root)

    @cached_property
    def units_top(self) -> DataFrame:
        """Units without a parent: what most queries see."""
        return self["code_units"].where("parent_unit_id IS NULL")

    @property
    def units_flat(self) -> DataFrame:
        return self["code_units"]

    def find(self, name: str, /, **equal) -> DataFrame:
        """Rows whose columns equal the values given; None is no condition. Pushed to the scan."""
        df = self[name]
        for column, value in equal.items():
            if value is not None:
                df = df.where(F.col(column) == value)
        return df

    def clusters_of(self, file_path: str) -> DataFrame:
        """Clusters a file belongs to."""
        return self["file_clusters"].join(self["file_cluster_members"].where(F.col("file_path") == file_path), F.col("id") == F.col("cluster_id"), "left_semi")

    def write(self, root: str, names: tuple[str, ...] | None = None) -> Catalog:
        """The tables as Parquet under ``root``, sorted for scans by their usual key."""
        for name in names or tuple(self.tables):
            df = self.tables[name]
            key = next((c for c in ("file_path", "source_file", "code_unit_id", "caller_unit_id", "parent_unit_id") if c in df.columns), None)
            (df.sortWithinPartitions(key) if key else df).write.mode("overwrite").parquet(f"{root}/{name}")
        return Catalog(self.spark, root=root)

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """§1.4: of old and new rows the last by ``seq`` for each key of the table."""
        return last_by(self[name].unionByName(rows), UPSERT_KEYS[name])

    def drop_units(self, gone: DataFrame) -> dict[str, DataFrame]:
        """All tables after the units in ``gone`` (id), and their children, are removed."""
        doomed = gone.select("id").union(self["code_units"].join(gone.select(F.col("id").alias("parent_unit_id")), "parent_unit_id", "left_semi").select("id")).distinct()
        kept = {"code_units": self["code_units"].join(doomed, "id", "left_anti").select(self["code_units"].columns)}
        for name, column in UNIT_CHILDREN.items():
            df = self[name]
            kept[name] = df.join(doomed.select(F.col("id").alias(column)), column, "left_anti").select(df.columns)
        followers = self["pattern_template_followers"]
        live = kept["pattern_templates"].select(F.col("id").alias("template_id"))
        kept["pattern_template_followers"] = followers.join(live, "template_id", "left_semi").select(followers.columns)
        return kept

    def drop_files(self, paths: DataFrame) -> dict[str, DataFrame]:
        """All tables after the units of the files in ``paths`` (file_path) are removed, with all that hangs on them."""
        return self.drop_units(self["code_units"].join(paths, "file_path", "left_semi").select("id"))

    def record_run(self, result: DataFrame) -> DataFrame:
        """Run results with this one appended; its id is one more than the last."""
        last = self["analysis_results"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
        return self["analysis_results"].unionByName(result.crossJoin(F.broadcast(last)).withColumn("id", F.col("m") + 1).drop("m"))

    def latest_run(self) -> DataFrame:
        return self["analysis_results"].orderBy(F.desc("id")).limit(1)


def analyse(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), skip_tests: bool = False) -> Catalog:
    """§3.1: every table of the catalog from files (file_path, content, seq, sha256, language)."""
    spark = files.sparkSession
    code = files.where(should_process(F.col("file_path"), include, exclude, skip_tests))
    whole = graph.settle(units.units_with_bodies(code), "units")
    found, bodies = whole.drop("body"), units.bodies_of(whole)
    tables = {"files": files, "code_units": found, "code_unit_patterns": graph.settle(patterns.unit_patterns(bodies, found), "patterns")}
    tables["module_patterns"] = patterns.module_patterns(code, found)
    told = lines.js_imports(code.where(F.col("language").isin(*units.JS_FILES))).unionByName(imports.other_imports(code))
    told = told.withColumn("id", F.sha2(F.concat_ws("|", "source_file", "target_file"), 256)).select("id", "source_file", "target_file", "import_type", "imported_names", F.col("seq").cast("long").alias("seq"))
    tables["file_dependencies"] = graph.settle(last_by(told, UPSERT_KEYS["file_dependencies"]), "imports")
    tables |= lines.deep_rows(bodies)
    resolved = resolve.resolve_calls(tables["function_calls"], found).select("id", F.col("callee_unit_id").alias("u"), F.col("callee_file_path").alias("f"))
    calls = tables["function_calls"].join(resolved, "id").withColumns({"callee_unit_id": F.col("u"), "callee_file_path": F.col("f")}).drop("u", "f")
    tables["function_calls"] = graph.settle(calls.select("id", "caller_unit_id", "callee_name", "callee_file_path", "callee_unit_id", "line_number", "is_async", "seq"), "calls")
    env = lines.env_variables(files.where(is_env_example(F.col("file_path"))))
    tables["env_variables"] = last_by(env.withColumn("seq", F.struct("file_path", "line_number")), ("name",)).select(F.sha2("name", 256).alias("id"), "name", "description", "has_default", "line_number")
    models, fields = units.schema_models(files.where(is_schema_file(F.col("file_path")) | F.col("language").isin(*units.JS_FILES)))
    tables["schema_models"], tables["schema_model_fields"] = models, fields
    tables["file_clusters"], tables["file_cluster_members"] = graph.clusters(tables["file_dependencies"])
    top = found.where("parent_unit_id IS NULL")
    tables["pattern_templates"], tables["pattern_template_followers"] = ranking.templates(top, tables["code_unit_patterns"])
    tables["file_hashes"] = files.select("file_path", F.col("sha256").alias("hash"), F.current_timestamp().alias("last_analyzed"))
    return Catalog(spark, tables)
