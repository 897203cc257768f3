"""Tables that grow by publication: data is written to a folder of its own, and counts from the moment a manifest that names it is created.

Creating a manifest is one step of the file system that fails if the name is taken, so a run that ends early leaves only folders that nobody reads, and of two runs that publish one name the first wins. Manifests add and
remove folders; the table is what is added and not removed, in whatever order manifests are seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Create a manifest; False if there is one of that name. A manifest that was not written whole can't be read, and counts as none."""
    where, fs = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Exception as e:
        if fs.exists(where):
            return False
        raise e
    out.write(json.dumps(content).encode())
    out.close()
    return True


def manifests(spark: SparkSession, folder: str) -> dict[str, dict]:
    """By name: the manifests of a folder."""
    where, fs = _at(spark, folder)
    if not fs.exists(where):
        return {}
    out = {}
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(".json"):
            stream = fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                out[name[:-5]] = json.loads(text)
            except ValueError:
                continue
    return out


class Ledger:
    """A table in a folder that all executors share. partition_by: columns whose values have folders of their own inside each appended one, so that readers and compaction can take some."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.partition_by = spark, folder.rstrip("/"), tuple(partition_by)
        self.schema = StructType.fromDDL(schema)

    def live(self) -> list[str]:
        """The folders that make up the table."""
        added, removed = set(), set()
        for m in manifests(self.spark, f"{self.folder}/log").values():
            added.update(m["add"])
            removed.update(m.get("remove", []))
        return sorted(added - removed)

    def read(self) -> DataFrame:
        parts = None
        for name in self.live():  # a table each: folders of partitions inside have one root
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{name}")
            parts = part if parts is None else parts.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if parts is None else parts.select(*self.schema.names)

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows = df.select(*self.schema.names)
        if self.partition_by:
            rows = rows.repartition(*self.partition_by)
        rows.write.partitionBy(*self.partition_by).parquet(f"{self.folder}/data/{name}")
        return name

    def append(self, df: DataFrame) -> str:
        """Adds the rows of df, all or none; the name of their folder."""
        name = self._write(df)
        publish(self.spark, f"{self.folder}/log/{name}.json", {"add": [name]})
        return name

    def compact(self, least: int = 2) -> bool:
        """Rewrites the table as one folder, if it has at least so many. Rows appended meanwhile stay as they are; of compactions at one time one wins, and the others' data is deleted. Old folders stay for readers that
        began before; vacuum() deletes them."""
        old = self.live()
        if len(old) < least:
            return False
        number = sum(name.startswith("compaction-") for name in manifests(self.spark, f"{self.folder}/log"))
        new = self._write(self.read())
        if set(old) <= set(self.live()) and publish(self.spark, f"{self.folder}/log/compaction-{number:08}.json", {"add": [new], "remove": old}):
            return True
        delete(self.spark, f"{self.folder}/data/{new}")
        return False

    def vacuum(self) -> list[str]:
        """Deletes the data of folders that a manifest has removed; their names."""
        removed = sorted({x for m in manifests(self.spark, f"{self.folder}/log").values() for x in m.get("remove", [])})
        gone = [x for x in removed if exists(self.spark, f"{self.folder}/data/{x}")]
        for x in gone:
            delete(self.spark, f"{self.folder}/data/{x}")
        return gone


def published_once(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """The table of that name; make() gives it where nobody has published it yet. Of runs that make it at one time the first to publish wins, and all read its rows."""
    log = f"{folder.rstrip('/')}/{name}.json"

    def found() -> DataFrame | None:
        if exists(spark, log) and (m := manifests(spark, folder).get(name)):
            return spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{folder.rstrip('/')}/{m['add'][0]}")
        return None

    if (df := found()) is not None:
        return df
    made, data = make(), f"{name}-{uuid.uuid4().hex}"
    made.write.parquet(f"{folder.rstrip('/')}/{data}")
    if not publish(spark, log, {"add": [data], "schema": json.loads(made.schema.json())}):
        if (df := found()) is not None:
            delete(spark, f"{folder.rstrip('/')}/{data}")
            return df
        delete(spark, log)  # left by a run that ended while it wrote it
        publish(spark, log, {"add": [data], "schema": json.loads(made.schema.json())})
    return spark.read.schema(made.schema).parquet(f"{folder.rstrip('/')}/{data}")
