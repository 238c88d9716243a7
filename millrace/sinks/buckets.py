"""A table of plain Parquet files that upserts, appends and deletions write to, batch by batch (SNK-01 to SNK-06, SNK-12, MUT-01).

Rows lie in buckets by a hash of their keys. A commit names for each bucket the folder that holds it, so a batch writes only the
buckets that it touches, and readers see a batch whole or not at all. A commit is a small file that is put in its place by a rename which fails
if another writer came first; the batch is then merged again with what the other wrote. A batch with a number that its source has
committed already changes nothing, as `foreachBatch` needs.

Rows with a null in a key conflict with nothing and are appended. Of a batch's rows with one key the last in order counts, of equals the last by position. Columns may
be of any kind that Parquet takes, maps and variants too; keys can't be maps or variants. Files that no commit names any more stay until vacuum().
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


class BucketTable:
    """The table under a folder that all executors share. A new one needs a schema; keys and buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), schema: StructType | None = None, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        if self._version() < 0:
            if schema is None:
                raise ValueError("a new table needs a schema")
            nullable = re.sub('(ullable|ontainsNull)":false', r'\1":true', schema.json())  # as files are read
            self._commit(-1, {"schema": json.loads(nullable), "keys": list(keys), "buckets": buckets, "held": {}, "added": [], "batches": {}})

    # The log: one small JSON file for each version.

    def _at(self, name: str) -> object:
        return self._files.Path(f"{self.path}/{name}")

    def _system(self) -> object:
        return self._at("log").getFileSystem(self._conf)

    def _version(self) -> int:
        if not self._system().exists(self._at("log")):
            return -1
        names = [f.getPath().getName() for f in self._system().listStatus(self._at("log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)

    def _read(self) -> tuple[int, dict]:
        version = self._version()
        file = self._system().open(self._at(f"log/{version:012d}.json"))
        try:
            return version, json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def _commit(self, version: int, state: dict) -> bool:
        """Makes state the version behind the given one, unless another writer did so first."""
        draft = self._at(f"log/.{uuid.uuid4().hex}")
        file = self._system().create(draft, False)
        file.write(bytearray(json.dumps(state).encode()))
        file.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._files, "Options$Rename"), 0)
        try:
            self._files.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._at(f"log/{version + 1:012d}.json"), none)
        except (Py4JJavaError, CapturedException) as e:
            self._system().delete(draft, False)
            if "FileAlreadyExistsException" not in str(e):
                raise
            return False
        return True

    # What is in the table.

    @property
    def version(self) -> int:
        return self._version()

    def _columns(self, state: dict) -> StructType:
        return StructType.fromJson(state["schema"])

    def _load(self, state: dict, buckets: Sequence[str], added: Sequence[str]) -> DataFrame:
        folders = [f"{self.path}/{state['held'][b]}/_bucket={b}" for b in buckets] + [f"{self.path}/{a}" for a in added]
        schema = self._columns(state)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The rows as of the newest commit."""
        _, state = self._read()
        return self._load(state, list(state["held"]), state["added"])

    # Writing.

    def _stage(self, df: DataFrame, state: dict, others: Sequence[str]) -> tuple[str, DataFrame]:
        """df written once, with the position of each row, so that merging reads the same rows however often it runs. Columns that df lacks are null."""
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._columns(state) if f.name not in df.columns]
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.dataType.simpleString() != df.schema[f.name].dataType.simpleString() else F.col(f"`{f.name}`") for f in self._columns(state) if f.name in df.columns), *missing, *(F.col(c) for c in others), F.monotonically_increasing_id().alias("_position"))
        folder = f"staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def _merged(self, state: dict, new: DataFrame, touched: Sequence[str], keep: Sequence[str], stamp: dict[str, Column], order: Sequence[str], newest: bool) -> DataFrame:
        """_bucket and the rows of the touched buckets after the batch, which comes as _bucket, the keys, _order and _new."""
        keys, names = state["keys"], self._columns(state).names
        new = new.groupBy("_bucket", *keys).agg(F.max_by("_new", "_order").alias("_new"))  # partial results first: a key may hold most rows
        old = self._load(state, [b for b in touched if b in state["held"]], ())
        old = old.select(self._bucket(state).alias("_bucket"), *keys, _row(old).alias("_old"))
        both = new.unionByName(old, allowMissingColumns=True).repartition(max(1, len(touched)), "_bucket")  # the groups below stay where their bucket is
        both = both.groupBy("_bucket", *keys).agg(F.first("_new", ignorenulls=True).alias("_new"), F.first("_old", ignorenulls=True).alias("_old"))
        there, here = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        if newest:
            later = F.struct(*(F.col("_new")[c] for c in order)) >= F.struct(*(F.col("_old")[c] for c in order))
            here &= ~there | F.coalesce(later, F.lit(True))
        taken = lambda c: F.when(here & (~there if c in keep else F.lit(True)), F.col("_new")[c]).otherwise(F.col("_old")[c])
        value = lambda c: F.when(here & there, stamp[c]).otherwise(taken(c)) if c in stamp else taken(c)
        return both.select("_bucket", here.alias("_here"), there.alias("_there"), *(value(c).alias(c) for c in names))

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def upsert(self, staged: DataFrame, keep: Sequence[str] = (), stamp: dict[str, Column] | None = None, order: Sequence[str] = (), newest: bool = False, source: str = "", batch: int | None = None) -> dict[str, int]:
        """Rows of staged replace those with their keys or are added; {affected, replaced, added} counts keys, and rows without one.

        keep: columns that stay as they were where a row is replaced. stamp: values that such a row gets. order: columns by which the last of a key's staged rows is told,
        needn't be columns of the table. newest: a row that is there stays if it comes later in order. source and batch: the batch's number within its source.
        """
        version, state = self._read()
        keys = state["keys"]
        if not keys:
            raise ValueError("a table without keys takes append() alone")
        if batch is not None and state["batches"].get(source, -1) >= batch:
            return {"affected": 0, "replaced": 0, "added": 0}
        names = self._columns(state).names
        folder, rows = self._stage(staged, state, [c for c in order if c not in names])
        named = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
        new = rows.where(named).select(self._bucket(state).alias("_bucket"), *keys, F.struct(*order, "_position").alias("_order"), F.struct(*names).alias("_new"))
        touched = sorted(str(r["_bucket"]) for r in new.select("_bucket").distinct().collect())  # no more than there are buckets
        unnamed = rows.where(~named).select(*names)
        counts = {"affected": 0, "replaced": 0, "added": unnamed.count()}
        extra = []
        if counts["added"]:
            extra = [f"data-{uuid.uuid4().hex}"]
            unnamed.write.parquet(f"{self.path}/{extra[0]}")
        while True:
            after = state | {"held": dict(state["held"]), "added": [*state["added"], *extra], "batches": dict(state["batches"])}
            if touched:
                seen, data = Observation(), f"data-{uuid.uuid4().hex}"
                merged = self._merged(state, new, touched, keep, stamp or {}, order, newest)
                merged = merged.observe(seen, F.count_if("_here").alias("affected"), F.count_if(F.col("_here") & F.col("_there")).alias("replaced"))
                merged.drop("_here", "_there").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
                counts |= seen.get
                after["held"] |= dict.fromkeys(touched, data)
            if batch is not None:
                after["batches"][source] = batch
            if self._commit(version, after):
                break
            version, state = self._read()
            if batch is not None and state["batches"].get(source, -1) >= batch:
                return {"affected": 0, "replaced": 0, "added": 0}
        self._system().delete(self._at(folder), True)
        counts["affected"] += counts["added"]
        return counts

    def append(self, rows: DataFrame, source: str = "", batch: int | None = None) -> bool:
        """SNK-06: adds rows as they are, whatever their keys; whether they were added (False: the batch had been)."""
        version, state = self._read()
        if batch is not None and state["batches"].get(source, -1) >= batch:
            return False
        folder, _ = self._stage(rows, state, ())
        while True:
            after = state | {"added": [*state["added"], folder], "batches": state["batches"] | ({source: batch} if batch is not None else {})}
            if self._commit(version, after):
                return True
            version, state = self._read()
            if batch is not None and state["batches"].get(source, -1) >= batch:
                return False

    def delete(self, which: Column) -> int:
        """MUT-01: takes the rows out for which the condition is true (unknown ones stay), and writes only folders that hold some. Returns how many."""
        gone = F.coalesce(which, F.lit(False))
        while True:
            version, state = self._read()
            n, after = 0, state | {"held": dict(state["held"]), "added": list(state["added"])}
            if state["held"]:
                held = self._load(state, list(state["held"]), ())
                by_bucket = held.where(gone).groupBy(self._bucket(state).alias("b")).agg(F.count("*").alias("n")).collect()
                touched = sorted(str(r["b"]) for r in by_bucket)
                n += sum(r["n"] for r in by_bucket)
                if touched:
                    data = f"data-{uuid.uuid4().hex}"
                    left = self._load(state, touched, ()).where(~gone).withColumn("_bucket", self._bucket(state)).repartition(len(touched), "_bucket")
                    left.write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
                    still = {str(r["b"]) for r in left.select(F.col("_bucket").alias("b")).distinct().collect()}
                    after["held"] = {b: f for b, f in after["held"].items() if b not in touched} | dict.fromkeys(sorted(still), data)
            for folder in state["added"]:
                part = self._load(state, (), [folder])
                if some := part.where(gone).count():
                    n += some
                    after["added"][after["added"].index(folder)] = data = f"data-{uuid.uuid4().hex}"
                    part.where(~gone).write.parquet(f"{self.path}/{data}")
            if not n or self._commit(version, after):
                return n

    def vacuum(self) -> int:
        """Deletes folders that the newest commit doesn't name (those of batches under way too: run it while nothing writes or reads older rows); how many."""
        _, state = self._read()
        whole, parts = {"log", *state["added"]}, {(f, f"_bucket={b}") for b, f in state["held"].items()}
        old = []
        for folder in self._system().listStatus(self._files.Path(self.path)):
            name = folder.getPath().getName()
            if name in {f for f, _ in parts}:
                old += [b.getPath() for b in self._system().listStatus(folder.getPath()) if b.isDirectory() and (name, b.getPath().getName()) not in parts]
            elif name not in whole:
                old.append(folder.getPath())
        for path in old:
            self._system().delete(path, True)
        return len(old)

    def writer(self, source: str, **options: object) -> Callable[[DataFrame, int], None]:
        """What `foreachBatch` calls: upserts each micro-batch once, however often it is repeated."""

        def write(df: DataFrame, n: int) -> None:
            self.upsert(df, source=source, batch=n, **options)

        return write
