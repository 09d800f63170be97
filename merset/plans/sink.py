"""The listing of a selection as text files in its order, whole or not there at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.session import partitions

HEADER, SIZE = "List of independent nodes:", "The graph has an independent set of size {}."


def write_listing(mis: DataFrame, path: str, files: int | None = None) -> dict:
    """Writes a selection (sel_idx, kmer) below ``path`` and returns the manifest.

    Ranges of the order go to a file each (``files`` of them at most; one a
    shuffle partition if None), one k-mer a line. Files whose names sort before
    and after these hold the header and the line with the size, so all of them
    joined by name are the listing. All is written to a folder beside it, with the
    manifest (``_manifest.json``: size, and each file's name, k-mers and first place)
    last, and moved to ``path`` at once; a run that dies leaves nothing there.
    An existing path is an error. An empty selection has the two lines only.
    Null k-mers are left out; other columns are not read.
    """
    spark = mis.sparkSession
    target = _path(spark, path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    draft = f"{path.rstrip('/')}._draft-{uuid.uuid4().hex}"
    rows = mis.where(F.col("kmer").isNotNull()).select("sel_idx", "kmer")
    try:
        rows.repartitionByRange(files or partitions(spark), "sel_idx").sortWithinPartitions("sel_idx").select("kmer").write.text(draft)
        held = spark.read.schema("value string").text(draft).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("kmers")).orderBy("file").collect()
        manifest: dict = {"size": sum(r["kmers"] for r in held), "files": []}
        for r in held:  # a file a range
            manifest["files"].append({"file": r["file"], "kmers": r["kmers"], "first": 1 + sum(f["kmers"] for f in manifest["files"])})
        said = {"a-header.txt": f"{HEADER}\n", "z-size.txt": f"{SIZE.format(manifest['size'])}\n", "_manifest.json": json.dumps(manifest)}
        for name, text in said.items():
            stream = fs.create(_path(spark, f"{draft}/{name}"), False)
            stream.write(bytearray(text.encode()))
            stream.close()
        if not fs.rename(_path(spark, draft), target):
            raise OSError(f"could not move the listing to {path}")
    except BaseException:
        fs.delete(_path(spark, draft), True)
        raise
    return manifest


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
