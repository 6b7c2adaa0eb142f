"""A Spark data source of recordings: typed records of a split, one partition per manifest file, pruned by fold before it is read.

``publish`` writes a split as manifest files in one folder per fold; ``spark.read.format("recordings")`` then gives a record for each
clip: its normalised samples, its group as subject and its label. Filters on ``fold`` (equality, ``isin``) take whole manifest folders out of the plan,
if ``spark.sql.python.filterPushdown.enabled`` is set. Executors read manifests and sounds with Arrow's file systems, so paths may be URIs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from echoline.functions.config import SAMPLE_RATE, WINDOW_SAMPLES
from echoline.sources.uploads import Refused, parsed

RECORD = "record_id string, subject_id string, label string, fold string, path string, samples array<double>, problem string"
PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")
NULL_FOLD = "__HIVE_DEFAULT_PARTITION__"
#: Sounds in one batch that a task hands on.
BATCH = 64


def publish(split: DataFrame, path: str, per_file: int = 1000) -> None:
    """Write (clip_id, group_id, label, fold, path) as manifests under ``path``, at most ``per_file`` clips in each."""
    rows = split.select("clip_id", "group_id", "label", "path", "fold")
    rows.write.mode("errorifexists").partitionBy("fold").option("maxRecordsPerFile", per_file).parquet(path)


def normalised(x: np.ndarray, size: int = WINDOW_SAMPLES) -> np.ndarray:
    """Cut or filled to ``size``, then without its mean and with RMS 1; a constant sound stays zero."""
    whole = np.zeros(size)
    whole[: min(size, len(x))] = x[:size]
    whole -= whole.mean()
    rms = np.sqrt((whole * whole).mean())
    return whole / rms if rms > 0 else whole


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Manifest(InputPartition):
    path: str
    fold: str | None

    def __init__(self, path: str, fold: str | None):
        super().__init__((path, fold))
        self.path, self.fold = path, fold


class RecordingsReader(DataSourceReader):
    """Lists manifest files when planned; a task reads its own and the sounds that it names."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        for name in ("manifest", "root"):
            if name not in options:
                raise ValueError(f"option {name} is missing")
        self.manifest, self.root = options["manifest"].rstrip("/"), options["root"].rstrip("/")
        self.size, self.rate = int(options.get("samples", WINDOW_SAMPLES)), int(options.get("rate", SAMPLE_RATE))
        self.schema, self.folds = schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("fold",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("fold",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.folds = wanted if self.folds is None else self.folds & wanted

    def partitions(self) -> list[InputPartition]:
        system, base = _filesystem(self.manifest)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for info in sorted(found, key=lambda i: i.path):
            folder = info.path.rsplit("/", 2)[-2]
            if info.is_file and info.path.endswith(".parquet") and folder.startswith("fold="):
                fold = unquote(folder[5:])
                fold = None if fold == NULL_FOLD else fold
                if self.folds is None or fold in self.folds:
                    out.append(Manifest(info.path, fold))
        return out or [Manifest("", None)]

    def _sound(self, system: fs.FileSystem, base: str, path: str | None) -> tuple[np.ndarray | None, str | None]:
        if not path or path.startswith("/") or ".." in path.split("/"):
            return None, "path"
        try:
            with system.open_input_file(f"{base}/{path}") as f:
                rate, channels, x = parsed(f.read())
        except FileNotFoundError:
            return None, "missing"
        except Refused as reason:
            return None, str(reason)
        if channels != 1 or rate != self.rate:
            return None, "channels" if channels != 1 else "sample_rate"
        return normalised(x.astype(np.float64), self.size), None

    def read(self, partition: Manifest) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        import pyarrow.parquet as pq

        target = to_arrow_schema(self.schema)
        system, _ = _filesystem(self.manifest)
        sounds, base = _filesystem(self.root)
        with system.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(BATCH, columns=["clip_id", "group_id", "label", "path"]):
                ids, groups, labels, paths = (b.column(i).to_pylist() for i in range(4))
                read = [self._sound(sounds, base, p) for p in paths]
                columns = [ids, groups, labels, [partition.fold] * len(ids), paths, [x for x, _ in read], [p for _, p in read]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types, strict=True)], schema=target)


class Recordings(DataSource):
    """``spark.read.format("recordings").option("manifest", ...).option("root", ...)``; options ``samples`` and ``rate`` say what a clip is."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> RecordingsReader:
        return RecordingsReader(schema, self.options)


def recordings(spark: SparkSession, manifest: str, root: str, **options: int) -> DataFrame:
    """Records of the published split; registers the source with the session.

    Spark keeps the filters that were pushed last with a loaded table and only asks again if a query has some. The filter on ids, which all
    records have, makes it ask for every query; a table loaded without it must be loaded anew for each set of filters.
    """
    spark.dataSource.register(Recordings)
    spark.conf.set(*PUSHDOWN)
    reader = spark.read.format("recordings").option("manifest", manifest).option("root", root)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().filter("record_id is not null")


def counted(records: DataFrame) -> DataFrame:
    """(fold, label, records, subjects, problems) of a set of records."""
    return records.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("subject_id").alias("subjects"), F.count("problem").alias("problems"))
