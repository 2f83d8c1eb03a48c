"""Sinks and contracts.

Every sink is one distributed ``DataFrame.write``; nothing is gathered on the
driver. Appends go to the same folder as new part files; a header / schema
contract is checked before anything is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from testsieve.functions import classify as cl
from testsieve.session import checkpoint_dir


class ContractError(ValueError):
    """Data does not match the contract of the target."""


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/testsieve-out/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- format choice

def sink_format(path: str) -> str:
    """S7 on the driver for one output path: ``Txt``, ``CSV``, ``JSON`` or error."""
    from pathlib import PurePosixPath
    ext = PurePosixPath(path).suffix.lower()
    fmt = {".txt": "Txt", ".csv": "CSV", ".json": "JSON"}.get(ext, "Unknown")
    if fmt == "Unknown":
        raise ContractError(f"no writer for {path!r}: the name must end in .txt, .csv or .json")
    return fmt


# ---------------------------------------------------------------- text

def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    """One string column, one line per row (single newline, see README)."""
    if len(df.columns) != 1 or not isinstance(df.schema.fields[0].dataType, T.StringType):
        raise ContractError("text output takes exactly one string column")
    df.write.mode("append" if append else "overwrite").text(path)


# ---------------------------------------------------------------- CSV

def csv_frame(df: DataFrame, decimals: int = 1) -> DataFrame:
    """every column as text the way the reports print it: booleans
    ``true``/``false``, arrays joined with ``", "``, doubles with one decimal."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ", ")
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("true")).otherwise(F.lit("false"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string(f"%.{decimals}f", F.round(c, decimals))
        else:
            c = c.cast("string")
        cols.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*cols)


def existing_csv_header(spark: SparkSession, path: str) -> list[str] | None:
    """Header of CSV data already at ``path`` (None when there is none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # data files only: Spark hides names with a leading dot or underscore; any
    # other trouble with the target is an error of its own
    if not files.exists(target):
        return None
    listed = [target] if files.getFileStatus(target).isFile() else [s.getPath() for s in files.listStatus(target)]
    if not any(not p.getName().startswith((".", "_")) for p in listed):
        return None
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str, append: bool = False, expected: T.StructType | None = None) -> None:
    """CSV with header. With ``expected`` the data must match that
    schema. Appending requires the existing header to be identical, same order;
    otherwise nothing is written."""
    if expected is not None:
        check_schema(df, expected)
    out = csv_frame(df)
    if append:
        header = existing_csv_header(df.sparkSession, path)
        if header is not None and header != out.columns:
            raise ContractError(f"CSV header mismatch: existing {header}, new {out.columns}")
    out.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Fail fast when the data's columns or types differ from the contract."""
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    if got != want:
        raise ContractError(f"schema mismatch: expected {want}, got {got}")
    return df


# ---------------------------------------------------------------- JSON documents

def json_documents(analysed: DataFrame, nodes: DataFrame | None = None,
                   refactor: DataFrame | None = None) -> DataFrame:
    """one nested document per test with the reference's field names, and
    ``doc_key`` = ``<project>/<project>_<package>_<test>.json`` (S11). The file
    path is part of the row, so same-named packages do not collide. With ``nodes`` (an expansion)
    it holds the tree as ``ParsedStatements``, a VARIANT. The source texts are those
    of :func:`testsieve.plans.analyze.document_texts`; a document without them has the header."""
    a = analysed
    if refactor is not None:
        a = a.join(refactor, ["project", "path", "func_line"], "left")
    empty = F.array().cast("array<string>")

    def c(name, default):
        return F.coalesce(F.col(name), default) if name in a.columns else default
    test_case = F.struct(F.col("name").alias("name"), c("package", F.lit("")).alias("package"),
                         F.col("path").alias("filePath"), F.col("project").alias("project"),
                         c("func_text", c("header_text", F.lit(""))).alias("funcDecl"))
    refactorings = F.array().cast("array<struct<refactored:string,filePath:string>>")
    if "refactored" in a.columns:
        refactorings = F.when(F.col("refactored").isNotNull(), F.array(F.struct(
            F.col("refactored").alias("refactored"), F.col("path").alias("filePath")))).otherwise(refactorings)
    scenario_set = F.struct(
        c("scenario_type", F.lit("")).alias("scenarioType"),
        c("data_structure", F.lit("none")).alias("dataStructure"),
        c("scenarios", empty).alias("scenarios"),
        c("runner", F.lit("")).alias("runner"),
        c("name_field", F.lit("")).alias("nameField"),
        c("expected_fields", empty).alias("expectedFields"),
        c("has_function_fields", F.lit(False)).alias("hasFunctionFields"),
        c("uses_subtest", F.lit(False)).alias("usesSubtest"),
        c("is_table_driven", F.lit(False)).alias("isTableDriven"))
    refactor_result = F.struct(
        c("strategy", F.lit("none")).alias("strategy"),
        c("generation_status", F.lit("none")).alias("status"),
        refactorings.alias("refactorings"),
        c("original_result", F.lit("notRun")).alias("originalTestResult"),
        c("refactored_result", F.lit("notRun")).alias("refactoredTestResult"))
    key = F.concat(F.col("project"), F.lit("/"), F.col("project"), F.lit("_"),
                   c("package", F.lit("")), F.lit("_"), F.col("name"), F.lit(".json"))
    docs = a.select(
        "project", "path", "func_line", key.alias("doc_key"),
        test_case.alias("TestCase"), scenario_set.alias("ScenarioSet"),
        c("imports", empty).alias("ImportedPackages"), refactor_result.alias("RefactorResult"))
    if nodes is not None:
        from testsieve.operators.expand import expansion_json
        trees = expansion_json(nodes).select("project", "path", "func_line", F.parse_json("json").alias("ParsedStatements"))
        docs = docs.join(trees, ["project", "path", "func_line"], "left").withColumn(
            "ParsedStatements", F.coalesce("ParsedStatements", F.parse_json(F.lit("[]"))))
    return docs.drop("func_line")


def write_json_documents(docs: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, one document per line, folders per project."""
    docs.write.mode("append" if append else "overwrite").partitionBy("project").json(path)


DOCUMENT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("TestCase", T.StructType([
        T.StructField(n, T.StringType()) for n in ["name", "package", "filePath", "project", "funcDecl"]])),
    T.StructField("ScenarioSet", T.StructType([
        T.StructField("scenarioType", T.StringType()), T.StructField("dataStructure", T.StringType()),
        T.StructField("scenarios", T.ArrayType(T.StringType())), T.StructField("runner", T.StringType()),
        T.StructField("nameField", T.StringType()), T.StructField("expectedFields", T.ArrayType(T.StringType())),
        T.StructField("hasFunctionFields", T.BooleanType()), T.StructField("usesSubtest", T.BooleanType()),
        T.StructField("isTableDriven", T.BooleanType())])),
    T.StructField("ImportedPackages", T.ArrayType(T.StringType())),
    T.StructField("RefactorResult", T.StructType([
        T.StructField("strategy", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("refactorings", T.ArrayType(T.StructType([
            T.StructField("refactored", T.StringType()), T.StructField("filePath", T.StringType())]))),
        T.StructField("originalTestResult", T.StringType()),
        T.StructField("refactoredTestResult", T.StringType())])),
    T.StructField("ParsedStatements", T.VariantType()),
    T.StructField("project", T.StringType()),
])


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read documents back with the declared schema; enum texts are
    decoded case-insensitively, unknown text becomes the default."""
    d = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    rr = F.col("RefactorResult")
    return d.withColumn("RefactorResult", F.struct(
        cl.parse_strategy(rr["strategy"]).alias("strategy"),
        cl.decode_generation_status(rr["status"]).alias("status"),
        rr["refactorings"].alias("refactorings"),
        cl.decode_execution_result(rr["originalTestResult"]).alias("originalTestResult"),
        cl.decode_execution_result(rr["refactoredTestResult"]).alias("refactoredTestResult")))


def flatten_one_level(df: DataFrame, col: str, flatten: bool = True) -> DataFrame:
    """Appended slices become one element each when ``flatten``; otherwise
    the slice stays one (nested) element."""
    if not flatten:
        return df
    return df.withColumn(col, F.explode(col))
