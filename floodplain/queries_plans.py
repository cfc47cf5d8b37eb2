"""Named queries over statements, schemas, locks, checks and decisions: small inputs with values known beforehand."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans import checks, ddl, history, lattice, shards
from .plans.history import History, SafeMode
from .queries import query
from .sources import dumpdir

Rows = Sequence[tuple]


def golden(columns: str, expected: Rows) -> Callable:
    """A query whose function gives rows of `columns` (name and type), held against `expected`."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": "INT", "string": "VARCHAR", "boolean": "BOOLEAN"}

    def text(v: object, kind: str) -> str:
        value = "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"
        return f"{value}::{kinds[kind]}"

    types = [c.split()[1] for c in columns.split(", ")]
    rows = ", ".join("(" + ", ".join(text(v, t) for v, t in zip(r, types, strict=True)) + ")" for r in expected)
    sql = f"SELECT * FROM (VALUES {rows}) AS t({', '.join(f'"{n}"' for n in names)})"

    def add(f: Callable[[SparkSession], Rows]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame(list(f(spark)), columns)

        query(sql, f.__name__)(run)
        return f

    return add


T = "CREATE TABLE `db`.`t` (id bigint unsigned NOT NULL AUTO_INCREMENT, a varchar(20) DEFAULT 'x', b decimal(10, 2), c int AS (id + 1), PRIMARY KEY (id), UNIQUE KEY u (a), KEY k (a, b))"


@golden("place int, name string, type string, nullable boolean, generated boolean", [(0, "id", "bigint", False, False), (1, "a", "varchar(20)", True, False), (2, "b", "decimal(10,2)", True, False), (3, "c", "int", True, True)])
def schema_columns(spark):
    """The columns of a CREATE TABLE."""
    return [(i, c.name, c.type, c.nullable, c.generated) for i, c in enumerate(ddl.create_schema(T).columns)]


@golden("name string, columns string, is_unique boolean", [("PRIMARY", "id", True), ("u", "a", True), ("k", "a,b", False)])
def schema_keys(spark):
    return [(n, ",".join(cs), u) for n, cs, u in ddl.create_schema(T).keys]


@golden("name string", [("id",), ("a",), ("b",)])
def insertable_columns(spark):
    """Columns that rows are written to: all but generated ones."""
    return [(c,) for c in dumpdir.insertable(ddl.create_schema(T))]


@golden("i int, j int, db string, tbl string", [(0, 0, "d", "a"), (0, 1, "d", "b"), (1, 0, "x", "t"), (1, 1, "d", "u"), (2, 0, "x", None), (3, 0, "d", "t")])
def ddl_references(spark):
    """The tables of statements, in order."""
    said = ["DROP TABLE a, `b`", "RENAME TABLE x.t TO u", "CREATE DATABASE IF NOT EXISTS x", "/* c */ ALTER TABLE t ADD COLUMN `x.y` int"]
    return [(i, j, r.schema, r.table or None) for i, s in enumerate(said) for j, r in enumerate(ddl.references(s, "d"))]


_SAID = ["CREATE TABLE db.t (id int PRIMARY KEY)", "ALTER TABLE db.t ADD COLUMN a int FIRST, ADD COLUMN b int AFTER id", "ALTER TABLE db.t DROP COLUMN a, CHANGE COLUMN b c bigint", "RENAME TABLE db.t TO db.u", "DROP TABLE db.u"]


@golden("at int, tbl string, columns string", [(1, "t", "id int"), (2, "t", "a int,id int,b int"), (3, "t", "id int,c bigint"), (4, "u", "id int,c bigint")])
def schema_history(spark):
    """Schemas as statements leave them, one version a statement."""
    held, out = History(), []
    for i, s in enumerate(_SAID, 1):
        held.track(s, (i,))
        out += [(i, t, ",".join(f"{c.name} {c.type}" for c in found.columns)) for t in ("t", "u") if (found := held.get(("db", t)))]
    return out


@golden("at int, columns string", [(1, "id"), (2, "a,id,b"), (3, "id,c")])
def schema_versions(spark):
    """The schema that a row of each location had."""
    held = History()
    for i, s in enumerate(_SAID[:3], 1):
        held.track(s, (i,))
    return [(i, ",".join(c.name for c in held.get(("db", "t"), (i,)).columns)) for i in (1, 2, 3)]


@golden("step string, columns string", [("first", "id,a"), ("again", "id,a"), ("saved", "id,a"), ("removed", None)])
def schema_points(spark):
    """A first schema is kept, saved schemas come back as they were, removed ones are gone."""
    held, table = History(), ("db", "t")
    cols = lambda s: s and ",".join(c.name for c in s.columns)
    one = held.put_first(table, ddl.create_schema("CREATE TABLE t (id int, a int)"))
    two = held.put_first(table, ddl.create_schema("CREATE TABLE t (id int)"))
    back = History.of(held.table(spark).collect()).get(table)
    held.remove(table)
    return [("first", cols(one)), ("again", cols(two)), ("saved", cols(back)), ("removed", cols(held.get(table)))]


@golden("col string, keys string", [("a", "u"), ("b", ""), ("id", "PRIMARY")])
def single_column_keys(spark):
    """Keys of one column, which go with it when it is dropped."""
    held = History()
    held.put(("db", "t"), (), ddl.create_schema(T))
    return [(c, ",".join(held.single_column_keys(("db", "t"), c))) for c in ("a", "b", "id")]


@golden("at int, place int, statement string", [(1, 1, "ALTER TABLE t ADD a int"), (1, 2, "ALTER TABLE t ADD b int"), (3, 0, "x"), (4, 0, "x")])
def statement_overrides(spark):
    """Statements replaced, skipped, and one whose override was taken back."""
    own = shards.Overrides()
    own.replace((1,), ["ALTER TABLE t ADD a int", "ALTER TABLE t ADD b int"])
    own.skip((2,))
    own.skip((3,))
    own.revert((3,))
    return [(loc[0], loc[1] if len(loc) > 1 else 0, s) for at in (1, 2, 3, 4) for loc, s in own.apply((at,), ["x"])]


@golden("statement string, pessimistic string, optimistic string", [("DROP TABLE t", "leave", "leave"), ("DROP DATABASE d", "leave", "leave"), ("TRUNCATE TABLE t", "ignore", "ignore"), ("RENAME TABLE a TO b", "merge", "refuse"), ("ALTER TABLE t ADD c int", "merge", "merge")])
def shard_statements(spark):
    """What shard merge does with statements that it can't merge."""
    return [(s, shards.shard_action(s, False), shards.shard_action(s, True)) for s in ("DROP TABLE t", "DROP DATABASE d", "TRUNCATE TABLE t", "RENAME TABLE a TO b", "ALTER TABLE t ADD c int")]


@golden("step int, synced boolean, remaining int, a string, b string", [(1, False, 1, "wait", "wait"), (2, True, 0, "execute", "wait"), (3, True, 0, "execute", "skip")])
def source_lock(spark):
    """A statement across two sources: the owner runs it once all have it, the other skips it then."""
    lock, out = shards.SourceLock({"a", "b"}), []
    for i, source in enumerate(("a", "b"), 1):
        synced, left = lock.try_sync(source, ["X"])
        out.append((i, synced, left, lock.action("a"), lock.action("b")))
    lock.finish("a")
    return [*out, (3, synced, left, lock.action("a"), lock.action("b"))]


@golden("a string, b string, same boolean, starts boolean", [("X,Y", "Y,X", True, False), ("X", "X,Y", False, True), ("", "X", False, True), ("X,Z", "X,Y", False, False)])
def statement_lists(spark):
    """Statement sets equal in any order, and sequences that start others."""
    lists = lambda s: s.split(",") if s else []
    return [(a, b, shards.same_ddls(lists(a), lists(b)), shards.is_prefix(lists(a), lists(b))) for a, b in (("X,Y", "Y,X"), ("X", "X,Y"), ("", "X"), ("X,Z", "X,Y"))]


@golden("bits int, modes string", [(0, ""), (4, "ANSI_QUOTES"), (1 << 21 | 1 << 3, "IGNORE_SPACE,STRICT_TRANS_TABLES")])
def sql_modes(spark):
    """The sql_mode in a statement's status variables."""
    return [(bits, ",".join(history.sql_modes(history.sql_mode_of(b"\x00\x01\x02\x03\x04\x01" + bits.to_bytes(8, "little"))))) for bits in (0, 4, 1 << 21 | 1 << 3)]


@golden("problem string", [("a source comes twice",), ("a task needs a name",), ("incremental mode needs a start",), ("s: no route rule r9",), ("unknown shard mode both",)])
def task_problems(spark):
    """What is wrong with a configuration."""
    return [(p,) for p in checks.TaskConfig("", "incremental", ["s", "s"], {"route": {"r1": 1}}, {"s": {"route": ["r1", "r9"]}}, shard_mode="both").problems()]


@golden("kind string, rule string", [("filter", "f2"), ("route", "r2"), ("route", "r3")])
def unused_rules(spark):
    """Rules that no source uses."""
    task = checks.TaskConfig("t", "all", ["a", "b"], {"route": {"r1": 1, "r2": 2, "r3": 3}, "filter": {"f1": 1, "f2": 2}}, {"a": {"route": ["r1"]}, "b": {"filter": ["f1"]}})
    return [(k, r) for k, rules in task.unused().items() for r in rules]


@golden("name string, state string", [("pessimistic", "fail"), ("optimistic", "success"), ("same", "success"), ("increment", "warn"), ("mapped", "success"), ("keyed", "success"), ("keyless", "warn")])
def pre_checks(spark):
    """Checks of the tables behind a target before a task starts."""
    a, b = (ddl.create_schema(f"CREATE TABLE t (id int AUTO_INCREMENT PRIMARY KEY, {c} int)") for c in "cd")
    found = {
        "pessimistic": checks.shard_schemas({"a": a, "b": b}), "optimistic": checks.shard_schemas({"a": a, "b": b}, True), "same": checks.shard_schemas({"a": a, "b": a}), "increment": checks.auto_increment({"a": a, "b": a}),
        "mapped": checks.auto_increment({"a": a, "b": a}, ["id"]), "keyed": checks.table_schema("t", a), "keyless": checks.table_schema("t", ddl.create_schema("CREATE TABLE t (a int)")),
    }
    return [(n, r.state) for n, r in found.items()]


@golden("at int, now int, safe boolean", [(3, 1000, True), (5, 1000, True), (6, 1000, False), (6, 1159, False), (7, 100, True), (7, 161, False)])
def safe_mode_window(spark):
    """Safe mode up to the exit point, and for a while after a start."""
    exit_, start = SafeMode(exit_point=(5,), started=0.0), SafeMode(started=100.0, flush_seconds=30.0)
    return [(at, now, exit_.on((at,), now)) for at, now in ((3, 1000), (5, 1000), (6, 1000), (6, 1159))] + [(7, now, start.on((7,), now)) for now in (100, 161)]


_META = "SHOW MASTER STATUS:\n\tLog: b.000003\n\tPos: 154\n\tGTID:a:1-5\n\nSHOW MASTER STATUS: /* AFTER CONNECTION POOL ESTABLISHED */\n\tLog: b.000004\n\tPos: 99\n\tGTID:a:1-9\n"


@golden("what string, file string, pos int, gtid string", [("start", "b.000003", 154, "a:1-5"), ("exit", "b.000004", 99, "a:1-9")])
def dump_locations(spark):
    """Where a dump started, and where safe mode may end."""
    return [(what, at["file"], at["pos"], at["gtid"]) for what, at in (("start", dumpdir.start_location(_META)), ("exit", dumpdir.exit_location(_META)))]


@golden("statement string", [("INSERT INTO `u` VALUES ('`t`')",), ("INSERT INTO `u` (`t`) VALUES (1)",)])
def replaced_names(spark):
    """The first quoted name of a dump's statement under another one."""
    return [(dumpdir.replace_name(s, "t", "u"),) for s in ("INSERT INTO `t` VALUES ('`t`')", "INSERT INTO `t` (`t`) VALUES (1)")]


@golden("i int, changed boolean", [(0, True), (1, False), (2, True), (3, False), (4, True), (5, False), (6, True), (7, False), (8, True), (9, True), (10, False)])
def catalog_statements(spark):
    """Statements at the catalog; what is there already, or gone already, is no error."""
    d = f"floodplain_{uuid.uuid4().hex[:12]}"
    run = history.Statements(spark).run
    said = [
        f"CREATE DATABASE {d}", f"CREATE DATABASE {d}", f"CREATE TABLE {d}.t (id bigint, a int)", f"CREATE TABLE {d}.t (id bigint)", f"ALTER TABLE {d}.t ADD COLUMN b int", f"ALTER TABLE {d}.t ADD COLUMN b int", f"ALTER TABLE {d}.t DROP COLUMN a",
        f"ALTER TABLE {d}.t DROP COLUMN a", f"ALTER TABLE {d}.t MODIFY COLUMN b bigint", f"DROP TABLE {d}.t", f"DROP TABLE {d}.t",
    ]
    try:
        return [(i, run(s)) for i, s in enumerate(said)]
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {d} CASCADE")


@golden("i int, name string, origin string", [(0, "id", "id"), (0, "b", "a"), (0, "n", None), (1, "a", "a"), (2, "id", "id"), (2, "a", None)])
def column_origins(spark):
    """Where the columns after an ALTER come from: kept, renamed, new, or dropped and new again."""
    before = ddl.create_schema("CREATE TABLE t (id int, a int)")
    said = ["ALTER TABLE t CHANGE COLUMN a b bigint, ADD COLUMN n int", "ALTER TABLE t DROP COLUMN id", "ALTER TABLE t DROP COLUMN a, ADD COLUMN a varchar(3)"]
    return [(i, c.name, old) for i, s in enumerate(said) for c, old in ddl.moved(before, s)]


def _locked(said: Sequence[tuple[int, str]], tables: int = 2, base: str = "id bigint PRIMARY KEY, c1 int") -> list[tuple]:
    lock, out = lattice.Lock({("s", "db", f"t{i}"): ddl.create_schema(f"CREATE TABLE t ({base})") for i in range(tables)}), []
    for n, (i, change) in enumerate(said):
        try:
            found = "; ".join(lock.submit(("s", "db", f"t{i}"), [f"ALTER TABLE db.t{i} {change}"]))
        except lattice.Conflict:
            found = "conflict"
        out.append((n, found, all(lock.synced().values())))
    return out


LOCKED = "n int, run string, synced boolean"


@golden(LOCKED, [(0, "ALTER TABLE `db`.`t0` ADD COLUMN c2 int", False), (1, "ALTER TABLE `db`.`t1` ADD COLUMN c2 int", True)])
def optimistic_add(spark):
    """A column comes to the target with its first shard."""
    return _locked([(0, "ADD COLUMN c2 int"), (1, "ADD COLUMN c2 int")])


@golden(LOCKED, [(0, "", False), (1, "conflict", False), (2, "ALTER TABLE `db`.`t1` DROP COLUMN c1", True), (3, "ALTER TABLE `db`.`t0` ADD COLUMN c1 int", False)])
def optimistic_drop(spark):
    """A column goes from the target with its last shard, and can't come back before that."""
    return _locked([(0, "DROP COLUMN c1"), (0, "ADD COLUMN c1 int"), (1, "DROP COLUMN c1"), (0, "ADD COLUMN c1 int")])


@golden(LOCKED, [(0, "ALTER TABLE `db`.`t0` MODIFY COLUMN c1 bigint", False), (1, "ALTER TABLE `db`.`t1` MODIFY COLUMN c1 bigint", True), (2, "", False), (3, "ALTER TABLE `db`.`t0` MODIFY COLUMN c1 int", True)])
def optimistic_types(spark):
    """The widest type of all shards."""
    return _locked([(0, "MODIFY COLUMN c1 bigint"), (1, "MODIFY COLUMN c1 bigint"), (1, "MODIFY COLUMN c1 int"), (0, "MODIFY COLUMN c1 int")])


@golden(LOCKED, [(0, "ALTER TABLE `db`.`t0` ADD COLUMN c2 varchar(10)", False), (1, "conflict", False), (2, "conflict", False), (3, "conflict", False), (4, "ALTER TABLE `db`.`t1` ADD COLUMN c2 varchar(10)", True)])
def optimistic_conflicts(spark):
    """Another length, another type, and a column that rows of other shards couldn't fill."""
    return _locked([(0, "ADD COLUMN c2 varchar(10)"), (1, "ADD COLUMN c2 varchar(20)"), (1, "ADD COLUMN c2 int"), (1, "ADD COLUMN c3 int NOT NULL"), (1, "ADD COLUMN c2 varchar(10)")])


@golden("i int, j int, place int", [(0, 0, 0), (0, 1, -1), (0, 2, -1), (1, 0, 1), (1, 1, 0), (1, 2, None), (2, 0, 1), (2, 1, None), (2, 2, 0)])
def schema_order(spark):
    """Which of two schemas is wider: -1, 0 or 1, and null where neither is."""
    three = [ddl.create_schema(f"CREATE TABLE t (id bigint PRIMARY KEY{x})") for x in ("", ", a int", ", b int")]
    return [(i, j, lattice.compare(a, b)) for i, a in enumerate(three) for j, b in enumerate(three)]
