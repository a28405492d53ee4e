"""Reading and writing files: shards, JSON lines, token lists, manifests and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.core import hash_order


def shards(spark: SparkSession, path: str, exclude: str = "/metadata/") -> list[str]:
    """Parquet files under a path, sorted, without those whose name has the excluded part."""
    return sorted(f for f in spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles() if exclude not in f)


def pick_shards(paths: list[str], n: int, seed: str) -> list[str]:
    """n of the paths by hash, sorted; all of them if there are fewer. Unpicked shards are never opened."""
    import hashlib

    return sorted(sorted(paths, key=lambda p: hashlib.md5(f"{seed}:{p.rsplit('/', 1)[-1]}".encode()).hexdigest())[: max(0, min(n, len(paths)))])


def capped_scan(rows: DataFrame, per_shard: int, order: str) -> DataFrame:
    """The first per_shard rows of each input file, in order."""
    w = Window.partitionBy("_file").orderBy(order)
    return rows.withColumn("_file", F.input_file_name()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_shard).drop("_file", "_r")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON lines under an explicit schema; bad lines fail the read, or are dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_examples(rows: DataFrame, path: str, split: str | None = None) -> None:
    """JSON lines, in a folder for each value of split. Task commits make each file whole or absent."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).json(path)


def write_checked(rows: DataFrame, path: str, least: int, **checks: str) -> None:
    """Parquet, written only if there are enough rows and no row breaks a check (SQL conditions that must hold)."""
    bad = [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in checks.items()]
    found = rows.agg(F.count("*").alias("_n"), *bad).first()
    failed = [k for k in checks if found[k]] + (["too few rows"] if found["_n"] < least else [])
    if failed:
        raise ValueError(f"not written: {', '.join(failed)}")
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files with a header, the given columns in their order; null and columns that rows lacks are empty, quotes doubled."""
    chosen = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*chosen).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_reconstruction(generic: DataFrame, group: list[str], path: str) -> None:
    """Parquet of scope, group_key, the group's own columns and its generic vector: control + generic + residual is the treated mean."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in group])
    generic.select(F.lit("|".join(group)).alias("scope"), name.alias("group_key"), *group, "generic").write.mode("overwrite").parquet(path)


def ordered_tokens(spark: SparkSession, path: str) -> DataFrame:
    """tok, idx of a text file's distinct lines in order of first sight; blanks and # lines are passed over."""
    lines = spark.read.text(path).select(F.trim("value").alias("tok"), F.monotonically_increasing_id().alias("at")).where("tok <> '' and not startswith(tok, '#')")
    first = lines.groupBy("tok").agg(F.min("at").alias("at"))
    return first.select("tok", (F.row_number().over(Window.orderBy("at")) - 1).alias("idx"))  # a token list is small by nature


def flagged_symbols(spark: SparkSession, path: str, symbol: str, flag: str) -> DataFrame:
    """tok, idx of a TSV's (gzipped or not) distinct symbols whose flag is 1, in file order."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path).withColumn("at", F.monotonically_increasing_id()).where(F.col(flag) == "1")
    first = rows.groupBy(F.trim(F.col(symbol)).alias("tok")).agg(F.min("at").alias("at"))
    return first.select("tok", (F.row_number().over(Window.orderBy("at")) - 1).alias("idx"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n, digest: order-free fingerprint of a table, from sums of the row hashes' halves; no row is gathered."""
    line = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(line, i, 12), 16, 10).cast("decimal(20,0)"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", part(1).cast("string"), part(13).cast("string"), part(25).cast("string")), 256).alias("digest"))


def missing_artifacts(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected names that aren't present."""
    return expected.join(present, "name", "left_anti")


def sampled_rows(rows: DataFrame, n: int, seed: str, ident: str) -> DataFrame:
    """n rows by hash order."""
    return rows.orderBy(hash_order(seed, ident), ident).limit(n)
