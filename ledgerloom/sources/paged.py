"""A table kept as pages by id, read as a data source that opens only the pages it needs.

write_pages sorts a table by a whole-number id into files and lists their first and last id and row count. The source
makes a partition of each page that the filters on the id let through, and, with a limit, of as few first pages in the
order asked for as hold that many rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

MANIFEST = "_pages.json"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system for the path, also in workers that have no JVM."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_pages(df: DataFrame, path: str, key: str, rows: int) -> int:
    """Writes df (key: whole numbers, none null or twice) as pages of about `rows` rows; the number of pages.

    A task writes 200 pages or so, a range of the key cut by a sample of it, as each task reports to the driver at some
    length. The list of pages, some dozen bytes each, is made on the driver.
    """
    spark = df.sparkSession
    pages = max(1, -(-df.count() // rows))
    df.repartitionByRange(-(-pages // 200), key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    files = spark.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("k"))
    listed = [r.asDict() for r in files.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("rows")).collect()]
    text = json.dumps({"key": key, "schema": df.schema.jsonValue(), "pages": sorted(listed, key=lambda p: p["low"])})
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    return len(listed)


class Page(InputPartition):
    def __init__(self, file: str):
        self.file = file


class PageReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict, schema: StructType, limit: int | None, descending: bool):
        self.path, self.manifest, self.schema, self.limit, self.descending = path, manifest, schema, limit, descending
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the key with a number choose pages and rows; all other filters are Spark's."""
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            name = kinds.get(type(f))
            if isinstance(f, IsNotNull) and f.attribute == (self.manifest["key"],):
                continue  # keys are never null
            if name and f.attribute == (self.manifest["key"],):
                self.wanted.append((name, f.value))
            else:
                if self.limit is not None:
                    raise ValueError("with a limit, only the key can be filtered")
                yield f

    def _open(self, page: dict) -> bool:
        low, high = page["low"], page["high"]
        tests = {"=": lambda v: low <= v <= high, ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v, "in": lambda v: any(low <= x <= high for x in v)}
        return all(tests[name](v) for name, v in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        pages = [p for p in self.manifest["pages"] if self._open(p)]
        if self.limit is not None:
            sure = 0
            for n, p in enumerate(pages[::-1] if self.descending else pages):
                if sure >= self.limit:
                    pages = (pages[::-1] if self.descending else pages)[:n]
                    break
                whole = not self.wanted or all(name in (">", ">=", "<", "<=") for name, _ in self.wanted) and self._whole(p)
                sure += p["rows"] if whole else 0
        return [Page(p["file"]) for p in pages]

    def _whole(self, page: dict) -> bool:
        low, high = page["low"], page["high"]
        tests = {">": lambda v: low > v, ">=": lambda v: low >= v, "<": lambda v: high < v, "<=": lambda v: high <= v}
        return all(tests[name](v) for name, v in self.wanted)

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{page.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.schema.names):
                keep = None
                for name, v in self.wanted:
                    key = batch.column(self.manifest["key"])
                    one = pc.is_in(key, pa.array(list(v), key.type)) if name == "in" else {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[name](key, v)
                    keep = one if keep is None else pc.and_(keep, one)
                yield batch if keep is None else batch.filter(keep)


class PagedSource(DataSource):
    """Options: path, limit (rows), order (asc or desc, by the key)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        store, folder = _store(options["path"])
        with store.open_input_file(f"{folder}/{MANIFEST}") as f:
            self.manifest = json.loads(f.read())

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        limit = self.options.get("limit")
        return PageReader(self.options["path"], self.manifest, schema, None if limit is None else int(limit), self.options.get("order", "asc") == "desc")


def read_pages(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of low <= key < high, in order of the key and `limit` at most if one is given; only the pages needed are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    options = {"path": path, "order": "desc" if descending else "asc"} | ({} if limit is None else {"limit": str(limit)})
    df = spark.read.format("paged").options(**options).load()
    store, folder = _store(path)
    with store.open_input_file(f"{folder}/{MANIFEST}") as f:
        key = json.loads(f.read())["key"]
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            df = df.where(F.col(key) >= bound if above else F.col(key) < bound)
    return df if limit is None else df.orderBy(F.desc(key) if descending else F.asc(key)).limit(limit)
