"""A keyed target in shared storage that a batch changes in part.

Rows lie in buckets of their key. A change reads and writes only the buckets that
its delta touches, in folders of its own, and then commits a manifest that names the
folders of every bucket; so nothing is overwritten, a change that breaks off leaves
the last manifest as it was, and one that is run again writes the same folders. The manifest also
carries what must be committed with the rows: how far logs have been read, rows
that wait, and counts of the tracked statements.

Columns have ids. A statement that adds, drops, renames or retypes a column changes
the manifest only: folders keep the layout that they were written in, and reading
casts, renames and fills them. The next change of a bucket writes the new layout.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import apply_keyed
from ..plans import ddl
from ..plans.history import spark_type

BUCKET = "_bucket"


def struct_of(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema  # noqa: SLF001


class MergedTable:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str | T.StructType | None = None, buckets: int = 64):
        """`schema` and `buckets` count only until the first commit; from then on the manifest has them."""
        self.spark, self.path, self.key, self.buckets = spark, path, tuple(key), buckets
        self.first = None if schema is None else struct_of(schema)
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(n) for s in found if (n := s.getPath().getName()).lstrip("-").isdigit())

    def committed(self) -> int:
        """The last committed batch, or -1."""
        return max(self.commits(), default=-1)

    def manifest(self, batch: int | None = None) -> dict:
        batch = self.committed() if batch is None else batch
        if batch < 0:
            if self.first is None:
                raise ValueError(f"{self.path} has no commit yet and no schema is given")
            fields = [{"id": i, "name": f.name, "type": f.dataType.simpleString(), "default": None} for i, f in enumerate(self.first)]
            ids = [next(f["id"] for f in fields if f["name"].lower() == k.lower()) for k in self.key]
            return {"batch": -1, "key": ids, "buckets": self.buckets, "fields": fields, "next_id": len(fields), "layouts": [], "files": {}, "side": {}, "members": {}, "statements": []}
        stream = self._fs.open(self._path(f"{self.path}/_commits/{batch}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return rows_of(self, self.manifest())

    def side(self, name: str) -> DataFrame | None:
        """A table that was committed with the rows."""
        path = self.manifest()["side"].get(name)
        return None if path is None else self.spark.read.parquet(f"{self.path}/{path}")

    def change(self, batch: int) -> Change:
        return Change(self, batch)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes folders that the last `keep` commits don't name, and older commits."""
        commits = self.commits()
        live = {"_commits"}
        for m in map(self.manifest, commits[-keep:]):
            live |= {x["path"].split("/")[0] for x in m["files"].values()} | {p.split("/")[0] for p in m["side"].values()}
        for s in self._fs.listStatus(self._path(self.path)):
            if s.getPath().getName() not in live:
                self._fs.delete(s.getPath(), True)
        for batch in commits[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_commits/{batch}"), False)


def rows_of(table: MergedTable, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of some buckets (all by default) in the present columns."""
    wanted = state["files"].items() if buckets is None else [(str(b), state["files"][str(b)]) for b in buckets if str(b) in state["files"]]
    by_layout: dict[int, list[str]] = {}
    for _, x in wanted:
        by_layout.setdefault(x["layout"], []).append(f"{table.path}/{x['path']}")
    schema = T.StructType([T.StructField(f["name"], struct_of(f"c {f['type']}")[0].dataType) for f in state["fields"]])
    out = None
    for k, paths in sorted(by_layout.items()):
        layout = {x["id"]: x for x in state["layouts"][k]}
        stored = T.StructType([T.StructField(f"c{i}", struct_of(f"c {x['type']}")[0].dataType) for i, x in layout.items()])
        own = [(F.col(f"c{f['id']}") if f["id"] in layout else F.lit(f["default"])).cast(f["type"]).alias(f["name"]) for f in state["fields"]]
        part = table.spark.read.schema(stored).parquet(*sorted(paths)).select(*own)
        out = part if out is None else out.unionByName(part)
    return table.spark.createDataFrame([], schema) if out is None else out


class Change:
    """One batch's change of a table; nothing is seen by others before commit()."""

    def __init__(self, table: MergedTable, batch: int):
        self.table, self.batch, self.step = table, batch, 0
        self.state = deepcopy(table.manifest())
        self.open = batch > self.state["batch"]
        self.staged: list[str] = []

    @property
    def key(self) -> list[str]:
        names = {f["id"]: f["name"] for f in self.state["fields"]}
        return [names[i] for i in self.state["key"]]

    def _folder(self, what: str) -> str:
        self.step += 1
        return f"{what}-{self.batch}-{self.step}"

    def _bucket(self, key: Sequence[str]):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(self.state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, touched: Sequence[int]) -> None:
        folder, fields = self._folder("rows"), self.state["fields"]
        layout = [{"id": f["id"], "type": f["type"]} for f in fields]
        if layout not in self.state["layouts"]:
            self.state["layouts"].append(layout)
        stored = rows.withColumn(BUCKET, self._bucket(self.key)).select(BUCKET, *[F.col(f["name"]).alias(f"c{f['id']}") for f in fields])
        stored.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.table.path}/{folder}")
        for b in touched:
            self.state["files"].pop(str(b), None)
        for s in self.table._fs.listStatus(self.table._path(f"{self.table.path}/{folder}")):
            if (name := s.getPath().getName()).startswith(f"{BUCKET}="):
                self.state["files"][name.split("=")[1]] = {"path": f"{folder}/{name}", "layout": self.state["layouts"].index(layout)}

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows, written once and read by all that follows in this change; the folder goes with the commit."""
        folder = self._folder("staged")
        rows.write.mode("overwrite").parquet(f"{self.table.path}/{folder}")
        self.staged.append(folder)
        return self.table.spark.read.schema(rows.schema).parquet(f"{self.table.path}/{folder}")

    def load(self, rows: DataFrame) -> None:
        """These rows, and no others."""
        self.state["files"] = {}
        names = [f["name"] for f in self.state["fields"]]
        self._write(rows.select(*names), range(self.state["buckets"]))

    def merge(self, delta: DataFrame) -> int:
        """Applies a compacted delta; returns how many buckets it touched."""
        rows = self.stage(delta.withColumn(BUCKET, self._bucket(self.key)))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most one row a bucket
        if touched:
            now = rows_of(self.table, self.state, touched)
            self._write(apply_keyed(now, rows.drop(BUCKET), self.key), touched)
        return len(touched)

    def alter(self, statement: str) -> bool:
        """Follows an ALTER or TRUNCATE of this table; what is there or gone already is no error. Other statements change nothing."""
        what = ddl.kind(statement)
        if what == "TRUNCATE TABLE":
            self.state["files"] = {}
            return True
        if what != "ALTER TABLE":
            return False
        changed = False
        for part in ddl.split(statement, "t"):
            fields = self.state["fields"]
            before = ddl.Schema(tuple(ddl.Column(f["name"], "?") for f in fields))
            moved = ddl.moved(before, part)
            if moved is None:
                continue
            by_name, new = {f["name"].lower(): f for f in fields}, []
            for column, origin in moved:
                old = by_name.get(origin.lower()) if origin else None
                if old is None:
                    new.append({"id": self.state["next_id"], "name": column.name, "type": spark_type(column), "default": ddl.default_of(column)})
                    self.state["next_id"] += 1
                else:
                    new.append({**old, "name": column.name, "type": old["type"] if column.type == "?" else spark_type(column)})
            names = {f["id"]: f["name"].lower() for f in new}
            if any(names.get(f["id"]) != f["name"].lower() for f in fields if f["id"] in self.state["key"]):
                raise ValueError(f"{part}: a key column can't go or get another name")
            changed |= new != fields
            self.state["fields"] = new
        return changed

    def side(self, name: str, rows: DataFrame | None) -> None:
        if rows is None:
            self.state["side"].pop(name, None)
            return
        folder = self._folder(name)
        rows.write.mode("overwrite").parquet(f"{self.table.path}/{folder}")
        self.state["side"][name] = folder

    def commit(self) -> None:
        self.state["batch"] = self.batch
        fs, path = self.table._fs, self.table._path
        fs.mkdirs(path(f"{self.table.path}/_commits"))
        waiting = path(f"{self.table.path}/_commits/.{self.batch}.tmp")
        stream = fs.create(waiting, True)
        stream.write(bytearray(json.dumps(self.state).encode()))
        stream.close()
        if not fs.rename(waiting, path(f"{self.table.path}/_commits/{self.batch}")):
            raise RuntimeError(f"{self.table.path}: batch {self.batch} is committed already")
        for folder in self.staged:
            fs.delete(path(f"{self.table.path}/{folder}"), True)


def load_files(target: MergedTable, files: DataFrame, rows: DataFrame) -> bool:
    """Adds rows (with _file) of the files (filename, end_pos) that the target doesn't have yet; rows and the list of files are one commit."""
    done = target.side("files") if target.committed() >= 0 else None
    new = files.select("filename", F.col("end_pos").cast("long").alias("end_pos"))
    new = new if done is None else new.join(done, "filename", "left_anti")
    if new.isEmpty():
        return False
    change = target.change(target.committed() + 1)
    came = rows.join(new.select(F.col("filename").alias("_file")), "_file", "left_semi").drop("_file")
    image = F.struct(*came.columns)
    delta = came.groupBy(*target.key).agg(F.max(image).alias("after")).withColumn("op", F.lit("I"))
    change.merge(delta.select(*target.key, "op", "after"))
    change.side("files", new if done is None else done.unionByName(new))
    change.commit()
    return True

