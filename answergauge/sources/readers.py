"""Typed scans. Every schema is stated, none is inferred by reading the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The column types of the lab fact table, its range dimension and
# the question set, and the text form of a collection time.
SAMPLES = (
    "sample_id STRING, test_name STRING, result_value DOUBLE, unit STRING, "
    "reference_low DOUBLE, reference_high DOUBLE, status STRING, technician STRING, "
    "instrument STRING, collected_at TIMESTAMP, batch_id STRING"
)
RANGES = "test_name STRING, unit STRING, reference_low DOUBLE, reference_high DOUBLE"
QUESTIONS = "question STRING, expected_answer STRING, expected_sample_id STRING, category STRING"
LAB_TIME = "yyyy-MM-dd HH:mm"
FULL_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"  # keeps a timestamp whole


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: str, timestamp_format: str = FULL_TIME,
    multi_line: bool = False, **options: str,
) -> DataFrame:
    """CSV with a header; quotes are doubled, an unreadable cell fails the job.

    ``multi_line`` reads cells with line breaks; a file is then one task.
    """
    settings = {"header": "true", "escape": '"', "mode": "FAILFAST", "multiLine": str(multi_line).lower(),
                "timestampFormat": timestamp_format, **options}
    return spark.read.schema(schema).options(**settings).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def with_rejects(spark: SparkSession, path: str, schema: str, kind: str = "csv", **options: str) -> DataFrame:
    """Every record of CSV (with a header) or JSON-lines files, readable or not.

    The columns of ``schema``, then ``file`` and, for a record that cannot be
    read as stated, ``record``, its text, and ``reason``; both are NULL for a
    good one. ``good_rows`` and ``rejects`` take the two apart. A reason names
    the first column whose cell does not have its type, or says that the number
    of cells is not that of the schema, or that the line is no JSON object. Empty lines are no records.
    """
    stated = spark.createDataFrame([], schema).schema
    whole = StructType([*stated.fields, StructField("_record", StringType())])
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_record", **options}
    if kind == "csv":
        settings = {"header": "true", "escape": '"', "timestampFormat": FULL_TIME, **settings}
    read = spark.read.schema(whole).options(**settings).format(kind).load(path)
    # a record is good or not by all its cells, so all are read whatever columns a query wants
    record = F.col("_record")
    for name in stated.names:
        record = F.when(F.col(name).isNull() | F.col(name).isNotNull(), record)
    rows = read.select(*stated.names, F.col("_metadata.file_path").alias("file"), record.alias("record"))
    reason = _csv_reason(stated, settings) if kind == "csv" else _json_reason(stated, settings)
    # a record's cells are looked at again only where it was rejected
    return rows.withColumn("reason", F.when(F.col("record").isNotNull(), reason))


def good_rows(read: DataFrame) -> DataFrame:
    return read.where("record IS NULL").drop("file", "record", "reason")


def rejects(read: DataFrame) -> DataFrame:
    return read.where("record IS NOT NULL").select("file", "reason", "record")


def _texts(schema: StructType, extra: int = 0) -> str:
    names = [f"`{f.name}` STRING" for f in schema.fields]
    return ", ".join(names + [f"`_more{i}` STRING" for i in range(extra)])


def _cell_reasons(schema: StructType, cell: Callable[[str], Column], settings: dict[str, str], otherwise: str) -> Column:
    reason = F.lit(otherwise)
    for field in reversed(schema.fields):
        text = cell(field.name)
        kind = field.dataType.simpleString()
        if kind == "timestamp":
            value = F.try_to_timestamp(text, F.lit(settings.get("timestampFormat", FULL_TIME)))
        else:
            value = text.try_cast(field.dataType)
        reason = F.when(text.isNotNull() & value.isNull(), f"{field.name} is not {kind}").otherwise(reason)
    return reason


def _csv_reason(schema: StructType, settings: dict[str, str]) -> Column:
    options = {"escape": settings["escape"], "sep": settings.get("sep", ",")}
    # one column more than stated shows a record that is too long; marks at the end one that is too short
    cells = F.from_csv("record", _texts(schema, 1), options)
    probe = F.from_csv(F.concat("record", F.lit(options["sep"] + "#")), _texts(schema, 1), options)
    fits = probe["_more0"].eqNullSafe("#")
    return F.when(~fits, F.lit("wrong number of cells")).otherwise(
        _cell_reasons(schema, lambda name: cells[name], settings, "unreadable"))


def _json_reason(schema: StructType, settings: dict[str, str]) -> Column:
    parsed = F.try_parse_json("record")
    an_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return F.when(parsed.isNull() | ~an_object, F.lit("no JSON object")).otherwise(_cell_reasons(
        schema, lambda name: F.try_variant_get(parsed, f"$.{name}", "string"), settings, "unreadable"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: path, block, line, text.

    A file is cut into byte ranges that different tasks read; a line that
    crosses a border belongs to the range where it starts. ``block`` is the
    range's first byte, ``line`` grows inside it, so (block, line) is the order
    of the file's lines. Nothing but a line has to fit in memory.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def read_sections(spark: SparkSession, path: str, heading: str, clause: str | None = None) -> DataFrame:
    """Sections of text files of any size: path, section_no, clause_no, text.

    A section starts at a line that matches ``heading``, a clause at one that
    matches ``clause``; both are counted from 1, and 0 is what stands before the
    first. Headings are counted per byte range and the counts summed up over the
    ranges, so a section that starts in one range and ends in another gets the
    same number in both, and no task reads more than its range. Only the lines
    of one clause come together. The text keeps its line feeds, without the last.
    """
    starts = F.col("text").rlike(clause) if clause else F.lit(False)
    marked = read_lines(spark, path).withColumns({
        "_heads": F.col("text").rlike(heading).cast("long"), "_starts": starts.cast("long")})
    upto = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = marked.groupBy("path", "block").agg(F.sum("_heads").alias("_h"), F.sum("_starts").alias("_s"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "path", "block", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("_h", "_s")))
    counted = marked.withColumns({"_h": F.sum("_heads").over(upto), "_s": F.sum("_starts").over(upto)})
    placed = counted.join(offsets, ["path", "block"]).select(
        "path", "block", "line", "text", "_starts", (F.col("_h") + F.col("_h_before")).alias("section_no"),
        (F.col("_s") + F.col("_s_before")).alias("_clause"))
    place = F.struct("block", "line")
    in_order = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    pieces = placed.groupBy("path", "section_no", "_clause").agg(
        F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("text"),
        F.min_by("_starts", place).alias("_opens"))
    # clauses are numbered through the file; a section's own begin where its first line stands
    of_section = Window.partitionBy("path", "section_no")
    base = F.min("_clause").over(of_section) - F.min_by("_opens", "_clause").over(of_section)
    return pieces.select("path", "section_no", (F.col("_clause") - base).alias("clause_no"), "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path and whole text."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_run_sheets(
    spark: SparkSession, folder: str, run_id: str | None = None, version: str | None = None
) -> DataFrame:
    """Run sheets of one version, all runs or one.

    Version and run are partition folders, so other runs and versions are not
    scanned, and versions may have different columns. Without ``version`` the
    greatest one is taken (as a number where it is one); finding it lists the
    folder and opens no file. Versions and run ids are texts: ``007`` and ``7``
    are two runs.
    """
    if version is None:
        version = max(_versions(spark, folder), key=lambda v: (v.isdecimal(), int(v) if v.isdecimal() else 0, v))
    path = f"{folder}/version={version}"
    found = spark.read.option("basePath", path).parquet(path).schema
    schema = StructType([StructField(f.name, StringType()) if f.name == "run_id" else f for f in found])
    sheets = spark.read.schema(schema).option("basePath", path).parquet(path)
    return sheets if run_id is None else sheets.where(F.col("run_id") == run_id)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the version folders of a sheet folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    entries = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(root)
    names = [e.getPath().getName() for e in entries if e.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(n.removeprefix("version=")) for n in names if n.startswith("version=")]
