"""Named views: versioned Parquet folders, with CSV import and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpusloom.functions.vectors import stringify
from corpusloom.runtime import spread

_INDEX_NAME = "_c0"  # what the CSV reader calls a column with an empty header
_UNNAMED = "Unnamed"
MAX_BROADCAST_FILES = 100_000


class ViewStore:
    """Views under one root folder, each save a new version next to the old ones.

    A command may read a view and save under the same name: the new version is written beside the files
    being read and only counts once its write has been committed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        location = hadoop.Path(path)
        return location, location.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _children(self, path: str) -> list[str]:
        location, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(location)) if fs.exists(location) else []

    def versions(self, name: str) -> list[int]:
        """Committed versions, oldest first."""
        found = []
        for child in self._children(f"{self.root}/{name}"):
            if child.startswith("v"):
                done, fs = self._fs(f"{self.root}/{name}/{child}/_SUCCESS")
                if fs.exists(done):
                    found.append(int(child[1:]))
        return sorted(found)

    def names(self) -> list[str]:
        return [c for c in self._children(self.root) if self.versions(c)]

    def save(self, df: DataFrame, name: str) -> str:
        taken = [int(c[1:]) for c in self._children(f"{self.root}/{name}") if c.startswith("v")]
        path = f"{self.root}/{name}/v{max(taken, default=0) + 1:06d}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def exists(self, path: str) -> bool:
        location, fs = self._fs(path)
        return fs.exists(location)

    def scan(self, name: str) -> DataFrame:
        """The newest version as a plain file scan."""
        versions = self.versions(name)
        if not versions:
            raise ValueError(f"no view named {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]:06d}")

    def load(self, name: str, clip: int | None = None) -> DataFrame:
        """The newest version, spread over the cores when its files are few; or its first rows."""
        df = self.scan(name)
        return spread(df) if clip is None else clip_file_rows(df, clip)

    def drop_old_versions(self, name: str, keep: int = 1) -> None:
        """Free the space of versions no job reads any more."""
        for version in self.versions(name)[:-keep]:
            location, fs = self._fs(f"{self.root}/{name}/v{version:06d}")
            fs.delete(location, True)


def file_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Contiguous ids in file order for a plain Parquet scan; nothing is sorted or shuffled.

    The reader knows each row's position in its file; only the row counts per file are added up.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per file: a single window task is enough, and the list is broadcast unless it is very long.
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    if len(df.inputFiles()) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "__file").select(*df.columns, (F.col("__offset") + F.col("__at")).alias(name))


def clip_file_rows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in file order of a plain Parquet scan."""
    return file_row_id(df, "__row").where(F.col("__row") < n).drop("__row")


def read_csv_view(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    index_col: bool = True,
    clip: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV view with header: the first (index) column and ``Unnamed…`` columns are dropped.

    ``index_col=False`` keeps the first column. Give a ``schema`` for large files; without one the types
    are inferred in an extra pass. With ``multi_line`` cells may span lines, but a file is then read by one
    task: turn it off, or bring many files, when texts hold no line breaks.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    df = reader.csv(path, schema=schema) if schema is not None else reader.csv(path, inferSchema=True)
    columns = df.columns[1:] if index_col else df.columns
    kept = [c for c in columns if not c.startswith(_UNNAMED) and c != _INDEX_NAME]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    return df if clip is None else df.limit(clip)


def write_csv_view(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with header; arrays are written as JSON. ``index`` names the column that goes first."""

    def cell(f: T.StructField) -> Column:
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        return (stringify(F.col(f.name)) if nested else F.col(f.name)).alias(f.name)

    cells = {f.name: cell(f) for f in df.schema.fields}
    first = [cells.pop(index)] if index else []
    df.select(*first, *cells.values()).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
