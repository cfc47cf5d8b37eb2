"""Where operators keep tables between their stages: the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..storage import scratch

#: Rows and bytes that go to a Python worker at once while tables are written.
BATCH_ROWS = 2000
BATCH_BYTES = 4_000_000
ROWS_CONF, BYTES_CONF, SHUFFLE_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes: list[list[DataFrame]] = []


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """For what is planned inside: Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, and shuffle files that go when their query ends. Then the session's own settings again."""
    before = {k: spark.conf.get(k) for k in (ROWS_CONF, BYTES_CONF, SHUFFLE_CONF)}
    for k, v in ((ROWS_CONF, BATCH_ROWS), (BYTES_CONF, BATCH_BYTES)):
        if not 0 < int(before[k].rstrip("bB")) <= v:
            spark.conf.set(k, str(v))
    spark.conf.set(SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with writing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written(); only once nothing that is still to run reads them. Deleting twice does nothing."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(make, label: str) -> DataFrame:
    """make() as a table, without the other tables that were written for it."""
    _scopes.append([])
    try:
        out = written(make(), label)
    finally:
        made = _scopes.pop()
    dropped(*[x for x in made if x is not out])
    if _scopes:
        _scopes[-1].append(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores added until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
