"""Scans and sinks: typed CSV, chunk folders, JSON records, resumable and best-of writes."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}  # folders of local sessions without the setting, by application


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, named in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster without it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(x: DataFrame, label: str) -> DataFrame:
    """``x`` written to the shared folder and read again: later plans neither compute it again nor see it change."""
    path = scratch(x.sparkSession, label)
    x.write.option("compression", "zstd").parquet(path)
    return x.sparkSession.read.schema(x.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any filesystem that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str) -> None:
    """Raise if an artefact that a run builds on is missing."""
    gone = [p for p in paths if not exists(spark, p)]
    if gone:
        raise FileNotFoundError(f"missing: {', '.join(gone)}")


def read_csv(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None, tolerant: bool = False) -> DataFrame:
    """CSV with a header and a declared schema; NaN and empty fields are NULL.

    ``columns`` prunes the scan.  ``tolerant`` skips files that cannot be read and lines that do not parse.
    """
    reader = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    out = reader.csv(path)
    return out.select(*columns) if columns else out


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header that :func:`read_csv` reads back; NULL is an empty field, an empty text is quoted."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def read_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All chunk files of a folder with the name of each row's chunk."""
    return read_csv(spark, folder, schema, tolerant=True).withColumn("chunk_file", F.element_at(F.split("_metadata.file_path", "/"), -1))


def write_chunks(rows: DataFrame, folder: str, key: str) -> int:
    """Append rows whose key is not in ``folder`` yet; returns how many were pending.

    Running it again after an interruption adds what is missing only.
    """
    spark = rows.sparkSession
    if exists(spark, folder):
        done = spark.read.schema(rows.schema).parquet(folder).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").option("compression", "zstd").parquet(folder)
    return n


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """A JSON record (metrics, configuration) as one line."""
    import json

    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()["value"])


def keep_best(spark: SparkSession, record: dict, path: str, metric: str) -> bool:
    """Write ``record`` if nothing is there or its metric is lower; whether it was written."""
    if exists(spark, path) and read_record(spark, path)[metric] <= record[metric]:
        return False
    write_record(spark, record, path)
    return True


def cache_path(folder: str, split: str, model: str, tag: str = "") -> str:
    """Folder of cached replies, named after split, model and tag."""
    plain = lambda s: re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9]+", "_", s)).lower()
    return "/".join([folder, "_".join(filter(None, map(plain, (split, model, tag))))])


def read_images(spark: SparkSession, folder: str, side: int = 224) -> DataFrame:
    """(path, ok, pixels): RGB images resized to ``side``; black with ok = 0 if undecodable.

    Decoding needs Pillow on the executors; where it is missing the job fails.
    """
    @F.pandas_udf("struct<ok:int,pixels:binary>")
    def decode(data: pd.Series) -> pd.DataFrame:
        import io

        from PIL import Image

        out = []
        for raw in data:
            try:
                out.append((1, Image.open(io.BytesIO(raw)).convert("RGB").resize((side, side)).tobytes()))
            except (OSError, ValueError, SyntaxError, Image.DecompressionBombError):  # what Pillow raises for pictures it cannot read
                out.append((0, bytes(side * side * 3)))
        return pd.DataFrame(out, columns=["ok", "pixels"])

    return spark.read.format("binaryFile").load(folder).select("path", decode("content").alias("i")).select("path", "i.ok", "i.pixels")
