"""A write-ahead log: operations in order, by the commit they came after, until a commit holds them.

The log is a Parquet table with a folder for each segment, the number of the last
commit when the operation was logged: a batch of operations is appended in one
job, a segment is listed and removed as a folder, and chunks are read by filters
that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..functions import names
from ..operators import control

LOG = StructType([StructField("file_id", LongType()), StructField("seq", LongType()), StructField("offset", LongType()), StructField("len", LongType()), StructField("is_zero", BooleanType()), StructField("data", BinaryType())])


class WriteAheadLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def append(self, ops: DataFrame, segid: int) -> None:
        """Logs writes and zero writes (file_id, seq, op, offset, len, data) behind what the log holds.

        seq orders the operations of one call; those of later calls get greater
        numbers, whatever the segment. A log has one writer at a time.
        """
        if not ops.where("op NOT IN ('write', 'write_zero')").isEmpty():
            raise ValueError("the log takes writes and zero writes")
        least, most = ops.agg(F.min("seq"), F.max("seq")).first()
        if least is None:
            return
        last = self.rows().agg(F.max("seq")).first()[0]
        shift = 0 if last is None else last + 1 - least
        zero = F.col("op") == "write_zero"
        rows = ops.select("file_id", (F.col("seq") + shift).alias("seq"), "offset", "len", zero.alias("is_zero"), F.when(~zero, F.col("data")).alias("data"))
        rows.write.mode("append").parquet(f"{self.root}/segid={segid}")

    def _one(self, file_id: int, segid: int, offset: int, length: int, data: bytes | None) -> None:
        kind = "write_zero" if data is None else "write"
        self.append(self.spark.createDataFrame([(file_id, 0, kind, offset, length, data)], "file_id long, seq long, op string, offset long, len long, data binary"), segid)

    def write(self, file_id: int, segid: int, offset: int, data: bytes) -> None:
        self._one(file_id, segid, offset, len(data), bytes(data))

    def write_zero(self, file_id: int, segid: int, offset: int, length: int) -> None:
        self._one(file_id, segid, offset, length, None)

    def segments(self) -> list[int]:
        """The numbers of the segments, in order."""
        fs, at = self._fs(self.root)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(x.removeprefix("segid=")) for x in found if x.startswith("segid="))

    def rows(self, where: Column | None = None) -> DataFrame:
        """segid and the columns of LOG; where, also on segid, reaches the scan."""
        schema = StructType([*LOG.fields, StructField("segid", LongType())])
        out = self.spark.read.schema(schema).option("basePath", self.root).parquet(self.root) if self.segments() else self.spark.createDataFrame([], schema)
        return out if where is None else out.where(where)

    def chunks(self, segid: int) -> DataFrame:
        """key, file_id, seq, offset, len, is_zero of a segment's operations, in order. No data is read."""
        rows = self.rows(F.col("segid") == segid)
        return rows.select(names.log_key("wal", F.col("segid"), F.col("seq"), F.col("offset"), F.col("len")).alias("key"), "file_id", "seq", "offset", "len", "is_zero").orderBy("seq")

    def read_chunk(self, file_id: int, segid: int, seq: int) -> bytes | None:
        """The data of one logged write; zeros for a zero write, None if there is no such chunk."""
        row = self.rows((F.col("segid") == segid) & (F.col("file_id") == file_id) & (F.col("seq") == seq)).first()
        return None if row is None else bytes(row["len"]) if row["is_zero"] else bytes(row["data"])

    def pending(self, heads: DataFrame) -> DataFrame:
        """The rows that a restart has to replay, for heads (file_id, head)."""
        return control.pending_segments(self.rows(), heads)

    def remove(self, segids: list[int]) -> None:
        for n in segids:
            fs, at = self._fs(f"{self.root}/segid={n}")
            fs.delete(at, True)
