"""A growing JSON array in shared storage.

The array is a list of *parts*, each a folder of JSON lines that Spark writes in parallel, and a
manifest for each version that names the parts in order. An append writes its part first and the
manifest of the next version last; readers take the newest manifest that was written to the end.
So an append that fails leaves the array as it was, two appends at once do not overwrite each
other (the second finds its version taken and raises), and old versions stay readable.

An append with ``flatten`` adds each row as an element; without, its rows together are one nested
element. An array of one element stands for the bare element, as a document that holds one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, part int, folder string, flatten boolean, elements bigint"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose manifest was written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in done if n.startswith("v"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> list:
    """Parts (version, part, folder, flatten, elements) of a version, the newest if not given; one
    row for each append."""
    known = _versions(spark, folder)
    if not known:
        return []
    return sorted(spark.read.schema(MANIFEST).json(f"{folder}/manifest/v{version or known[-1]}").collect(), key=lambda r: r.part)


def append_elements(elements: DataFrame, folder: str, order: list[str], column: str = "element", flatten: bool = True) -> int:
    """Append the JSON texts of ``column``, ordered by ``order``; the new version is returned."""
    spark = elements.sparkSession
    parts = manifest(spark, folder)
    version = (parts[0].version if parts else 0) + 1
    part = f"{folder}/parts/{uuid.uuid4().hex}"
    # rows of a range partition follow those of the one before, so ids ascend in the given order
    placed = elements.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(F.monotonically_increasing_id().alias("place"), F.col(column).alias("element")).write.json(part)
    written = spark.read.schema("place bigint, element string").json(part).count()
    rows = [(version, r.part, r.folder, r.flatten, r.elements) for r in parts] + [(version, len(parts), part, flatten, written if flatten else 1)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/manifest/v{version}")
    return version


def read_elements(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """``(part, nested, place, element)`` of a version: elements stand in the order of part and
    place; those of a ``nested`` part are together one element."""
    out = spark.createDataFrame([], "part int, nested boolean, place bigint, element string")
    for r in manifest(spark, folder, version):
        rows = spark.read.schema("place bigint, element string").json(r.folder)
        out = out.unionByName(rows.select(F.lit(r.part).alias("part"), F.lit(not r.flatten).alias("nested"), "place", "element"))
    return out


def is_bare(spark: SparkSession, folder: str, version: int | None = None) -> bool:
    """Does the document hold one element, which stands without an array around it?"""
    return sum(r.elements for r in manifest(spark, folder, version)) == 1
