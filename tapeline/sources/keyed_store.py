"""A mutable keyed table on Parquet: the newest row of every key, in hash buckets that a manifest lists."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

C = F.col
MANIFEST = "bucket int, folder string, batch_id long"
APPLIED = -1  # the manifest row that names the last batch applied


class KeyedStore:
    """Upserts by key; of equal keys the greatest `version` stays, whatever the order in which rows arrive.

    An upsert rewrites the buckets that its keys fall into and no others: it reads their files, merges, writes new ones
    under a fresh folder and then adds a manifest, a single small file that appears whole or not at all. Readers see the
    newest manifest; a writer that dies leaves files that no manifest names. A manifest that exists already is an error, so
    of two writers one has to try again. The number of buckets is fixed for a store: choose it so that a bucket fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], version: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.version, self.buckets = spark, path.rstrip("/"), schema, keys, version, buckets

    def manifest(self) -> tuple[int, dict[int, str], int]:
        """(number, folder of each bucket, last batch applied); -1, none and -1 before the first upsert. At most a row for each bucket."""
        try:
            rows = self.spark.read.schema(MANIFEST + ", v long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}, -1
        newest = rows.groupBy("v").agg(F.collect_list(F.struct("bucket", "folder", "batch_id")).alias("r")).orderBy(C("v").desc()).first()
        folders = {r["bucket"]: r["folder"] for r in newest["r"]}
        return newest["v"], {b: f for b, f in folders.items() if b != APPLIED}, max(r["batch_id"] for r in newest["r"])

    def _read(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(sorted(self.manifest()[1].values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: greatest version, then from the update, then the greatest text of the row."""
        rest = [c for c in rows.columns if c not in self.keys and c != "arrived"]
        order = F.struct(*self.version, "arrived", F.to_json(F.struct(*rest)))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*self.keys, "r.*")

    def upsert(self, updates: DataFrame, batch_id: int | None = None) -> bool:
        """Merge `updates`; a batch that was applied already changes nothing and gives False."""
        number, folders, applied = self.manifest()
        if batch_id is not None and batch_id <= applied:
            return False
        columns = self._read([]).columns
        new = cut(self._newest(updates.select(*columns).withColumn("arrived", F.lit(1))).select(*columns, self._bucket().alias("bucket_no")))
        touched = [r["bucket_no"] for r in new.select("bucket_no").distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = self._read([folders[b] for b in touched if b in folders]).withColumn("arrived", F.lit(0))
            merged = self._newest(old.unionByName(new.drop("bucket_no").withColumn("arrived", F.lit(1)))).select(*columns, self._bucket().alias("bucket_no"))
            data = f"{self.path}/data/{uuid.uuid4().hex}"
            merged.repartition(min(len(touched), self.buckets), "bucket_no").write.partitionBy("bucket_no").parquet(data)
            folders = folders | {b: f"{data}/bucket_no={b}" for b in touched}
        last = applied if batch_id is None else batch_id
        rows = [(b, f, -1) for b, f in sorted(folders.items())] + [(APPLIED, "", last)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v={number + 1}")
        return True
