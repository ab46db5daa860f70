"""Call targets by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(callee: Column) -> Column:
    """Without ``new`` and ``this.``, the last dotted part."""
    plain = F.regexp_replace(F.regexp_replace(callee, r"\Anew ", ""), r"\Athis\.", "")
    return F.substring_index(plain, ".", -1)


def resolve_calls(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Calls with callee_unit_id, callee_file_path and ``outcome``.

    Candidates are counted per name, and per name and file, before any call is joined:
    a call meets at most one row of each, however many units share its name.
    ``calls`` has id, caller_unit_id, callee_name, callee_unit_id; ``units`` id, name, file_path, is_exported.
    """
    by_name = units.groupBy("name").agg(
        F.count("*").alias("n"), F.min("id").alias("only"), F.min("file_path").alias("only_file"),
        F.count_if("is_exported").alias("n_exported"), F.min(F.when(F.col("is_exported"), F.struct("id", "file_path"))).alias("exported"),
    )
    by_file = units.groupBy("name", "file_path").agg(F.count("*").alias("n_file"), F.min("id").alias("in_file")).where("n_file = 1").select("name", "file_path", "in_file")
    callers = units.select(F.col("id").alias("caller_unit_id"), F.col("file_path").alias("caller_file"))
    open_calls = calls.select("id", "caller_unit_id", "callee_name", "callee_unit_id", *(["callee_file_path"] if "callee_file_path" in calls.columns else []))
    if "callee_file_path" not in calls.columns:
        open_calls = open_calls.withColumn("callee_file_path", F.lit(None).cast("string"))
    joined = (
        open_calls.withColumn("name", base_name(F.col("callee_name")))
        .join(callers, "caller_unit_id", "left")
        .join(by_name, "name", "left")
        .join(by_file.withColumnRenamed("file_path", "caller_file"), ["name", "caller_file"], "left")
    )
    already = F.col("callee_unit_id").isNotNull()
    how = (
        F.when(already, "kept").when(F.col("n").isNull(), "no_match").when(F.col("n") == 1, "unique")
        .when(F.col("in_file").isNotNull(), "same_file").when(F.col("n_exported") == 1, "exported").otherwise("ambiguous")
    )
    joined = joined.withColumn("outcome", how)
    chosen = F.when(already, F.col("callee_unit_id")).when(how == "unique", F.col("only")).when(how == "same_file", F.col("in_file")).when(how == "exported", F.col("exported.id"))
    file = F.when(already, F.col("callee_file_path")).when(how == "unique", F.col("only_file")).when(how == "same_file", F.col("caller_file")).when(how == "exported", F.col("exported.file_path"))
    return joined.select("id", "caller_unit_id", "callee_name", chosen.alias("callee_unit_id"), file.alias("callee_file_path"), "outcome")


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Total, resolved, ambiguous and no_match of the calls that were open."""
    o = F.col("outcome")
    return resolved.where(o != "kept").agg(
        F.count("*").alias("total"), F.count_if(o.isin("unique", "same_file", "exported")).alias("resolved"),
        F.count_if(o == "ambiguous").alias("ambiguous"), F.count_if(o == "no_match").alias("no_match"),
    )
