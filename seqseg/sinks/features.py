"""Feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

META_TYPE = (
    "struct<fps:double,original_T:bigint,video_path:string,hash:string,window:int,stride:int,"
    "flow_method:string,modality:string,T_feat:bigint>"
)


def write_features(features: DataFrame, path: str, mode: str = "append") -> None:
    """Features by dataset as zstd Parquet: FLOAT arrays, metadata as a struct."""
    out = features
    for name in ("rgb", "flow"):
        if name in out.columns:
            out = out.withColumn(name, F.col(name).cast("array<float>"))
    if "meta" in out.columns and out.schema["meta"].dataType.simpleString() == "string":
        out = out.withColumn("meta", F.from_json("meta", META_TYPE))
    out.write.mode(mode).option("compression", "zstd").partitionBy("dataset").parquet(path)
