"""Order over several sources, epochs and files, against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from floodplain.operators import log


def rows(seed=3):
    rng, out = random.Random(seed), []
    for src in ("a", "b"):
        txn = 0
        for epoch in (1, 2):
            for seq in (9, 10, 11):
                for pos in sorted(rng.sample(range(4, 900), 12)):
                    txn += rng.randrange(3)
                    out.append((src, epoch, seq, pos, 0, str(txn), rng.random() < 0.4, rng.choice("xy") if rng.random() < 0.1 else "x"))
    rng.shuffle(out)
    return out


KIND = "src_id string, epoch int, file_seq long, pos long, row_idx int, txn_id string, is_commit boolean, server_uuid string"


def in_order(data, src):
    return sorted(r for r in data if r[0] == src)


def test_running_order(spark):
    data = rows()
    df = spark.createDataFrame(data, KIND).repartition(5)
    top, epochs, kept, whole = {}, {}, set(), set()
    for src, skip in (("a", 17), ("b", 0)):
        best, server, n = 0, None, 0
        own = in_order(data, src)
        last = max(i for i, r in enumerate(own) if r[6])
        for i, r in enumerate(own):
            best = max(best, int(r[5]))
            n += server != r[7]
            server = r[7]
            top[r[:5]], epochs[r[:5]] = best, n
            if i >= skip:
                kept.add(r[:5])
            if i <= last:
                whole.add(r[:5])
    at = lambda r: (r.src_id, r.epoch, r.file_seq, r.pos, r.row_idx)
    assert {at(r): r.last_gtid for r in log.running_gtid(df).collect()} == top
    assert {at(r): r.new_epoch for r in log.new_epochs(df).collect()} == epochs
    assert {at(r) for r in log.skip_rows(df, spark.createDataFrame([("a", 17)], "src_id string, n long")).collect()} == kept
    assert {at(r) for r in log.committed(df).collect()} == whole
    assert log.without_replays(df.union(df)).count() == len(data)


def test_valid_events_and_readers(spark):
    df = spark.createDataFrame([("rows", False, 4), ("heartbeat", False, 9), ("rotate", True, 9), ("rotate", False, 0)], "event_type string, artificial boolean, pos int")
    assert log.valid_events(df).count() == 1
    files = spark.createDataFrame([(1, i) for i in range(5)], "epoch int, seq int")
    none = spark.createDataFrame([], "epoch int, seq int")
    assert log.purgeable(files, none, F.lit(True)).count() == 5 and log.purgeable(files, files.where("seq = 2"), F.lit(True)).count() == 2
