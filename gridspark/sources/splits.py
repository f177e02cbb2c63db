"""Split files and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.operators.sequences import check_starts, sequence_starts

SPLIT_INFO = (
    "data_file string, total_sequences int, input_seq_len int, target_seq_len int, total_seq_len int, "
    "train_ratio double, val_ratio double, test_ratio double, seed int, splits map<string,int>, train_end int, val_end int"
)


def parse_index_text(files: DataFrame, text: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """One integer per line to `(pos, seq_start)`; blank lines are ignored, order is kept."""
    lines = F.filter(F.transform(F.split(F.col(text), "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return files.select(*keys, F.posexplode(lines).alias("pos", "line")).select(
        *keys, "pos", F.col("line").cast("int").alias("seq_start"))


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """`<split>_indices.txt` of a folder (A9); a missing file is an error."""
    files = spark.read.text(f"{folder}/{split}_indices.txt", wholetext=True)
    return parse_index_text(files).select(F.lit(split).alias("split"), "pos", "seq_start")


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    out = read_split(spark, folder, splits[0])
    for s in splits[1:]:
        out = out.unionByName(read_split(spark, folder, s))
    return out


def write_splits(splits: DataFrame, path: str) -> None:
    """All splits as Parquet, one folder each (A10)."""
    splits.hint("rebalance", F.col("split")).sortWithinPartitions("split", "pos").write.mode("overwrite").partitionBy("split").parquet(path)


def read_written_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos int, seq_start int, split string").parquet(path).select("split", "pos", "seq_start")


def split_info(splits: DataFrame, data_file: str, n_in: int, n_out: int, n: int,
               ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """Metadata of a split (A10), one row."""
    counts = splits.groupBy("split").agg(F.count(F.lit(1)).cast("int").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("m"))
    return counts.select(
        F.lit(data_file).alias("data_file"), F.lit(n).alias("total_sequences"), F.lit(n_in).alias("input_seq_len"),
        F.lit(n_out).alias("target_seq_len"), F.lit(n_in + n_out).alias("total_seq_len"), F.lit(ratios[0]).alias("train_ratio"),
        F.lit(ratios[1]).alias("val_ratio"), F.lit(ratios[2]).alias("test_ratio"), F.lit(seed).alias("seed"),
        F.col("m").alias("splits"), F.lit(int(n * ratios[0])).alias("train_end"), F.lit(int(n * (ratios[0] + ratios[1]))).alias("val_end"))


def write_split_info(info: DataFrame, path: str) -> None:
    info.coalesce(1).write.mode("overwrite").json(path)


def read_split_info(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON, pretty-printed or not (A10)."""
    return spark.read.schema(SPLIT_INFO).json(path, multiLine=True)


def resolve_starts(spark: SparkSession, n_frames: int, n_in: int, n_out: int, starts: DataFrame | None = None,
                   index_file: str | None = None, folder: str | None = None, split: str | None = None) -> DataFrame:
    """Starts by priority: given table, index file, folder and split, all (C8); out of range is an error."""
    if starts is None and index_file is not None:
        starts = parse_index_text(spark.read.text(index_file, wholetext=True)).select("seq_start")
    elif starts is None and folder is not None and split is not None:
        starts = read_split(spark, folder, split).select("seq_start")
    elif starts is None:
        starts = sequence_starts(spark, n_frames, n_in, n_out)
    return check_starts(starts, n_frames, n_in, n_out)
