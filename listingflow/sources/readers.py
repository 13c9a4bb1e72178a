"""Readers of record files, registries, side files and captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow import schemas
from listingflow.functions.ids import id_or_hash, repair_url
from listingflow.sources.records import FILE, PLACE, read_pieces


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias(FILE), F.col("value"))


def read_arrays(spark: SparkSession, path: str, schema: T.StructType = schemas.HIT, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of files that hold one JSON array each, and the files that don't; files of no bytes are not read at all.

    Rows carry their file's name and place in it, which is the order of all that keeps
    the first; fields outside ``schema`` are in ``_extra``.  With ``fail_fast`` a bad file is an error.
    A file of any size is read by as many tasks as it has byte ranges; one with a damaged record gives none.
    """
    found, files = read_pieces(spark, path)
    reason = F.when((F.col("head") == "") & (F.col("n_records") + F.col("n_damaged") == 0), "empty").when((F.col("head") != "[") | F.col("open") | (F.col("n_damaged") > 0), "not an array").when(F.col("n_records") == 0, "no records")
    bad = files.withColumn("reason", reason).where("reason is not null")
    if fail_fast and (first := bad.first()):
        raise ValueError(f"{first[FILE]}: {first['reason']}")
    return typed(_maps(found.join(bad, FILE, "left_anti")), schema), bad.select(_name().alias(FILE), "reason")


def _name() -> Column:
    return F.substring_index(FILE, "/", -1)


def _maps(found: DataFrame) -> DataFrame:
    """Records as maps ``m`` of text, with their file's name."""
    return found.where(~F.col("damaged")).select(_name().alias(FILE), F.col(PLACE), F.from_json("text", T.MapType(T.StringType(), T.StringType())).alias("m"))


def read_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.HIT) -> tuple[DataFrame, DataFrame]:
    """Records of files with one JSON object a line, which are split over tasks however large they are, and the lines that hold none.

    ``_place`` orders the rows of a file by where its split and then the line lies.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias(FILE), F.monotonically_increasing_id().alias(PLACE), "value").where("trim(value) != ''")
    lines = lines.withColumn("m", F.from_json("value", T.MapType(T.StringType(), T.StringType())))
    return typed(lines.where("m is not null").select(FILE, PLACE, "m"), schema), lines.where("m is null").select(FILE, PLACE, "value")


def required(df: DataFrame, what: str = "records") -> DataFrame:
    """``df``, which must not be empty."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def scan_files(spark: SparkSession, path: str, endings: tuple = (".ts", ".js", ".json")) -> DataFrame:
    """``path`` and ``found`` of the files below ``path`` that seem to hold keys."""
    from listingflow.functions.security import SKIPPED_FOLDERS, keys_in

    wanted = "*{" + ",".join(endings) + "}"  # other files aren't opened
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), keys_in(F.col("value")).alias("found"))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return files.where(~skipped & (F.size("found") > 0))


def read_records(spark: SparkSession, path: str, schema: T.StructType = schemas.DETAIL) -> DataFrame:
    """Records of arrays, single objects and objects written one after another; ids from URL or file where missing.

    A damaged record costs no other: it ends at the next line that starts with a bracket.  See :func:`damaged_records`.
    """
    out = typed(_maps(read_pieces(spark, path)[0]), schema)
    if "id" in out.columns and "url" in out.columns:
        out = out.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), id_or_hash(F.col("url"), F.col(FILE))))
    return out


def damaged_records(spark: SparkSession, path: str) -> DataFrame:
    """File and text of what :func:`read_records` can't read."""
    return read_pieces(spark, path)[0].where("damaged").select(_name().alias(FILE), "text")


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of the map ``m`` by ``schema``; the rest in ``_extra``."""

    def one(f: T.StructField):
        text = F.try_element_at("m", F.lit(f.name))
        nested = isinstance(f.dataType, T.ArrayType | T.StructType)
        return (F.from_json(text, f.dataType) if nested else text.try_cast(f.dataType)).alias(f.name)

    names = F.array(*[F.lit(f.name) for f in schema])
    extra = F.map_filter("m", lambda k, v: ~F.array_contains(names, k)).alias("_extra")
    return rows.select(FILE, PLACE, *[one(f) for f in schema], extra)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Valid entries of a registry: its last version, the last complete snapshot of :func:`write_registry`, or JSON; none if it isn't there."""
    from listingflow.operators.registry import is_entry
    from listingflow.sources.versions import read_version, versions

    if versions(spark, path):
        return read_version(spark, path).where(is_entry())
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    if done:
        return spark.read.schema(schemas.REGISTRY).parquet(max(s.getPath().getParent().toString() for s in done)).where(is_entry())
    try:
        return spark.read.schema(schemas.REGISTRY).json(path, multiLine=True).where(is_entry())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.REGISTRY)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("listingId")).where("listingId != ''").distinct()


def with_descriptions(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``df`` with the text of its side file ``..._<id>.txt`` where there is one; of several the first by name."""
    texts = _files(spark, path).groupBy(F.regexp_extract(FILE, r"_([A-Za-z0-9-]+)\.txt$", 1).alias("_id_of_file")).agg(F.min_by("value", FILE).alias("_text"))
    joined = df.join(texts, F.col("id") == F.col("_id_of_file"), "left")
    return joined.withColumn("descriptionText", F.coalesce("_text", "descriptionText")).drop("_id_of_file", "_text")


def read_urls(df: DataFrame, host: str, url: str = "url") -> DataFrame:
    """Rows with a URL, repaired."""
    return df.where(F.col(url).isNotNull()).withColumn(url, repair_url(F.col(url), host))


def union(*frames: DataFrame) -> DataFrame:
    """All rows; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
