"""Upserts, reloads, partitioned sinks and quality checks on plain Parquet tables."""

from __future__ import annotations

import io
from collections.abc import Callable
from contextlib import redirect_stdout

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riverflux.functions.risk import partition_label
from riverflux.operators.ordering import numbered


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], update: list[str], order: str | Column) -> DataFrame:
    """existing with batch merged in: for a known key only the update columns change, and the batch's last row wins; a
    new key takes the update columns of its last row and the rest of its first. order: what tells the batch's rows of a
    key apart, of any type that has an order; of rows equal in it the one with the largest values is the last, so the
    result never depends on how the batch is spread."""
    rest = F.struct(*existing.columns)
    at = F.struct(F.lit(True).alias("new"), (F.col(order) if isinstance(order, str) else order).alias("order"), rest.alias("row"))
    new = batch.withColumn("at_", at).select(*existing.columns, "at_")
    nothing = F.lit(None).cast(new.schema["at_"].dataType["order"].dataType)
    both = existing.withColumn("at_", F.struct(F.lit(False).alias("new"), nothing.alias("order"), rest.alias("row"))).unionByName(new)  # before all of the batch
    return both.groupBy(*keys).agg(*[(F.max_by if c in update else F.min_by)(c, "at_").alias(c) for c in existing.columns if c not in keys]).select(*existing.columns)


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By range label, so that a time filter on part prunes folders; sorted within for min/max pruning."""
    rows = df.withColumn("part", partition_label(F.col("measured_at")))
    # by label and day: a label's rows are spread over tasks, not gathered in one
    rows.repartition("part", F.to_date("measured_at")).sortWithinPartitions("station_id", "measured_at").write.mode(mode).partitionBy("part").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    """Replace a table's rows, however often it is run."""
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Append rows of the predictions table, numbered on from the largest prediction_id there. One writer at a time."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    last = (spark.read.parquet(path).agg(F.max("prediction_id")).first()[0] if there else None) or 0
    rows = numbered(df, ["station_id", "for_date", "predicted_at"], "prediction_id", last + 1).withColumn("prediction_id", F.col("prediction_id").cast("int"))
    rows.write.mode("append").partitionBy("for_date").parquet(path)


def add_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Surrogate keys 1.. in an order."""
    return numbered(df, order, id_col)


def add_column_if_missing(df: DataFrame, name: str, type_: str, default=None) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(type_))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphan_rows(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return df.join(parent.select(key), key, "left_anti")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, order: list[str] | None = None) -> DataFrame:
    """df as a table in buckets of its keys, sorted by them and order; tables with as many buckets of the same keys are joined,
    and grouped by these, without a shuffle. Rows are dealt by bucket before, so that each bucket is one file."""
    rows = df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *(order or [])).saveAsTable(table)
    return df.sparkSession.table(table)


def screen(df: DataFrame, rules: dict[str, Column], path: str) -> dict[str, int]:
    """Write df at path in one pass: rows that no rule is true of below accepted=true, the others below accepted=false with
    the names of the rules in violated; and count them on the way. The result has a count for each rule, accepted and rows.

    A rule that is null is not violated."""
    broken = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    marked = df.withColumn("violated", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))).withColumn("accepted", F.size("violated") == 0)
    seen = Observation("screen")
    counts = [F.count_if(F.array_contains("violated", n)).alias(n) for n in rules]
    marked.observe(seen, F.count_if("accepted").alias("accepted"), F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").partitionBy("accepted").parquet(path)
    return dict(seen.get)


def run_script(spark, text: str, args: dict | None = None) -> list[tuple[str, str | None]]:
    """Run a script's statements one after the other; each with its error, if it failed. Comment lines
    go, and a statement ends at a semicolon outside of quotes. args: values for parameters like :day, which are bound and
    never become part of the text."""
    done, current, quoted = [], [], False
    body = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("--"))
    for c in body + ";":
        quoted ^= c == "'"
        if c == ";" and not quoted:
            statement = "".join(current).strip()
            current = []
            if statement:
                try:
                    spark.sql(statement, args)
                    done.append((statement, None))
                except Exception as e:  # the next statement is independent of this one
                    done.append((statement, str(e).split("\n")[0]))
        else:
            current.append(c)
    return done


def run_sources(jobs: dict[str, Callable[[], int]]) -> list[tuple[str, int, str | None]]:
    """(name, rows, error) of each source's job; a source that fails does not keep the others from running."""
    report = []
    for name, job in jobs.items():
        try:
            report.append((name, job(), None))
        except Exception as e:  # whatever is wrong with one source, the next is independent of it
            report.append((name, 0, str(e).split("\n")[0]))
    return report


def create_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Name tables and queries for use in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def plan_text(df: DataFrame) -> str:
    """The query's formatted plan, for a log."""
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()
