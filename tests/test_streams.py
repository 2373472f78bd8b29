import csv
import glob

import pytest

from gridloom.operators import streams as T


def test_buffered_shuffle_is_a_permutation(spark):
    rows = spark.range(0, 5000, 1, 3)
    one = [r.id for r in T.buffered_shuffle(rows, 100, 1).collect()]
    assert sorted(one) == list(range(5000))
    assert one != list(range(5000))
    assert one == [r.id for r in T.buffered_shuffle(rows, 100, 1).collect()]
    assert one != [r.id for r in T.buffered_shuffle(rows, 100, 2).collect()]
    assert T.buffered_shuffle(rows.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        T.buffered_shuffle(rows, 0)


def test_lines_and_tables(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.5, 0.12345), ("b", 1.0, 2.0)], "name string, j double, f double")
    T.write_lines(T.score_lines(scores, ["name"]), str(tmp_path / "lines"))
    lines = sorted(x.strip() for p in glob.glob(f"{tmp_path}/lines/part-*") for x in open(p))
    assert lines == ["f: 0.123450", "f: 2.000000", "j: 0.500000", "j: 1.000000"]
    T.write_result_table(scores.coalesce(1), str(tmp_path / "table"))
    (part,) = glob.glob(f"{tmp_path}/table/part-*")
    assert sorted(csv.reader(open(part))) == [["a", "0.5", "0.123"], ["b", "1.0", "2.0"], ["name", "j", "f"]]


def plain_reservoir(keys, group, size, seed):
    """A buffer as a list, row by row."""
    import hashlib

    slot = lambda i: int(hashlib.md5(f"{seed}:{group}:{i}".encode()).hexdigest()[:8], 16) % size
    held, out = [], []
    for i, k in enumerate(keys):
        if i < size:
            held.append(k)
        else:
            out.append(held[slot(i)])
            held[slot(i)] = k
    return out + [k for _, _, k in sorted((hashlib.md5(f"{seed}:{group}:rest:{j}".encode()).hexdigest(), j, k) for j, k in enumerate(held))]


def test_reservoir_shuffle(spark):
    rows = spark.range(0, 2000, 1, 5).selectExpr("id", "CASE WHEN id % 4 > 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('g', id % 3) END AS g", "'x' AS position0")
    for size in (1, 7, 5000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        try:
            got = T.reservoir_shuffle(rows, "g", ["id"], size, 3).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by = {}
        for r in rows.orderBy("id").collect():
            by.setdefault(r["g"], []).append(r["id"])
        for g, keys in by.items():
            own = sorted((r["position"], r["id"]) for r in got if r["g"] == g)
            assert [p for p, _ in own] == list(range(len(keys))) and [k for _, k in own] == plain_reservoir(keys, g, size, 3)
    assert T.reservoir_shuffle(rows.limit(0), "g", ["id"], 5).count() == 0
    with pytest.raises(ValueError):
        T.reservoir_shuffle(rows, "g", ["id"], 0)
