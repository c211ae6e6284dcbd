import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyforge.operators import orphans

CHILD = "src_table string, record_id int, parent_table string, scope string, key string, at timestamp, deleted_at string"
PARENT = "parent_table string, scope string, key string, received_at timestamp, deleted_at timestamp, record_id int"


def brute(children, parents):
    out = []
    for c in children:
        if c[4] is None:
            continue
        mine = [p for p in parents if p[:3] == (c[2], c[3], c[4]) and p[3] is not None]
        if c[5] is None:
            gone = not any(p[4] is None or (p[4].year, p[4].month) > (p[3].year, p[3].month) for p in mine)
        else:
            end = datetime(c[5].year + c[5].month // 12, c[5].month % 12 + 1, 1)
            gone = not any(p[3] < end and (p[4] is None or p[4] >= end) for p in mine)
        if gone:
            out.append((c[0], c[1], c[5].strftime("%Y-%m") if c[5] else None))
    return sorted(out, key=str)


def run(spark, children, parents):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    got = orphans.orphans(c, p).select("src_table", "record_id", orphans.month_text(F.col("month")).alias("m"))
    return sorted(map(tuple, got.collect()), key=str), orphans.orphans_by_period(c, p).agg(F.sum("n_orphans")).first()[0]


def test_against_brute_force(spark):
    rng = random.Random(3)
    when = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 420))
    scopes, keys = ["a", "b", None], ["k1", "k2", "k3", None]
    children = [("t", i, "boards", rng.choice(scopes), rng.choice(keys), rng.choice([when(), when(), None]), "x") for i in range(300)]
    children += children[:5]
    parents = []
    for _ in range(14):
        a = when()
        parents.append(("boards", rng.choice(scopes), rng.choice(keys), rng.choice([a, a, a, None]), rng.choice([None, a + timedelta(days=rng.randint(0, 200))]), 1))
    parents.append(("boards", "a", "k1", datetime(2024, 3, 31, 23), datetime(2024, 5, 1), 1))
    got, n = run(spark, children, parents)
    assert got == brute(children, parents)
    assert n == len(got)


def test_empty(spark):
    assert run(spark, [], [])[0] == []
    assert len(run(spark, [("t", 1, "b", "s", "k", datetime(2024, 1, 1), "")], [])[0]) == 1
    assert run(spark, [], [("b", "s", "k", datetime(2024, 1, 1), None, 1)])[0] == []
