"""Images as rows: encoded files, decoded files, and a lazily called loader. Header work reads a prefix column only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import headers
from pixelmill.functions import orientation as O
from pixelmill.operators import exif
from pixelmill.operators.pixels import from_channels, packed
from pixelmill.session import ship


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, cache_key of every file below path. Columns that are not used are not read."""
    rows = ship(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content", "length", F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256).alias("cache_key"))


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, pixels (ARGB) of files that Spark's image source can decode: whole images, upright."""
    rows = ship(spark).read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            px = [packed(from_channels(bytes(d), w, h, n)) for d, w, h, n in zip(pdf["data"], pdf["width"], pdf["height"], pdf["nChannels"], strict=True)]
            yield pd.DataFrame({"path": pdf["origin"], "width": pdf["width"], "height": pdf["height"], "pixels": px})

    return rows.mapInPandas(run, "path string, width int, height int, pixels binary")


def loaded(df: DataFrame, key: str, load: Callable[[str], bytes | None]) -> DataFrame:
    """df with `content` from a caller's function, called once a row on the executors; a failure is no content."""
    ship(df.sparkSession)

    def run(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in keys:
            out = []
            for k in s:
                try:
                    out.append(load(k))
                except Exception:  # a source that cannot be read is a null, as a missing file is
                    out.append(None)
            yield pd.Series(out, dtype=object)

    call = F.pandas_udf(run, "binary", functionType=204)  # iterator of series
    return df.withColumn("content", call(F.col(key)))


def opened(df: DataFrame, content: str = "content") -> DataFrame:
    """df with format, size, orientation, oriented size, and status: Ready, or Failed with a reason. One stage, no shuffle."""
    c = F.col(content)
    out = df.withColumn("probe", headers.probe(headers.header(c)))
    out = out.withColumn("orientation", F.when(F.col("probe").isNotNull(), exif.orientation_of(headers.header(c))).otherwise(1))
    size = O.oriented_size(F.col("orientation"), F.col("probe.width"), F.col("probe.height"))
    ok = F.col("probe").isNotNull() & headers.supports_region_decoding(F.col("probe.format"))
    return out.withColumn("oriented", size).withColumn("status", F.when(ok, "Ready").otherwise("Failed")).withColumn("reason", F.when(~F.coalesce(ok, F.lit(False)), "SourceUnreadable"))
