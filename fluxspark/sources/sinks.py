"""Writing tables, and stage tables that are computed once."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), months: Sequence[str] = ("month",)) -> dict[str, str]:
    """The same rows as Parquet and as CSV under one folder. CSV carries months as yyyy-MM text."""
    out = {"parquet": f"{path}/parquet", "csv": f"{path}/csv"}
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(out["parquet"])
    # The text is made from what was just written, so the frame is computed once.
    stored = df.sparkSession.read.schema(df.schema).parquet(out["parquet"])
    text = stored.select(
        *[
            F.date_format(f.name, "yyyy-MM").alias(f.name)
            if isinstance(f.dataType, DateType) and f.name in months
            else F.array_join(f.name, ", ").alias(f.name)
            if isinstance(f.dataType, ArrayType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    text.write.mode("overwrite").partitionBy(*partition_by).option("header", True).csv(out["csv"])
    return out


def fingerprint(inputs: Sequence[DataFrame], version: str = "") -> str:
    """A digest of what a stage is made from: each input's plan, and the length and time of every file it reads."""
    parts = [version]
    for df in inputs:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        # Names of columns carry a number of the session; the plan is the same without them.
        parts += [re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())]
        for name in sorted(df.inputFiles()):
            found = path(name)
            status = found.getFileSystem(conf).getFileStatus(found)
            parts += [name, str(status.getLen()), str(status.getModificationTime())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def stage_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True, inputs: Sequence[DataFrame] = (), version: str = "") -> DataFrame:
    """The stage table under ``path``, built and written unless it is there already, made from the same ``inputs`` and ``version``.

    Each build has a folder of its own, named by its fingerprint, so readers of an earlier one are not disturbed. The manifest beside
    them names the current one and is put in place by a rename once the data are complete; a build that fails leaves the old one current.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    manifest = hadoop.Path(f"{path}/manifest.json")
    files = manifest.getFileSystem(conf)
    mark = fingerprint(inputs, version)
    current = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())) if files.exists(manifest) else {}
    if reuse and current.get("fingerprint") == mark and files.exists(hadoop.Path(f"{path}/{current['data']}/_SUCCESS")):
        return spark.read.parquet(f"{path}/{current['data']}")
    data = f"{mark[:16]}-{uuid.uuid4().hex[:8]}"
    build().write.parquet(f"{path}/{data}")
    fresh = hadoop.Path(f"{path}/manifest-{data}.tmp")
    out = files.create(fresh)
    out.write(bytearray(json.dumps({"fingerprint": mark, "data": data, "files": [n for df in inputs for n in df.inputFiles()]}).encode()))
    out.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(manifest.toUri(), conf).rename(fresh, manifest, _overwrite(spark))
    return spark.read.parquet(f"{path}/{data}")


def _overwrite(spark: SparkSession):
    """Hadoop's rename option, as the array that its variable arguments take."""
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    return options
