import random

from tallyforge.operators import sequences


def fill(rows):
    """Ways by the rows in order: waiting rows take the next explicit way, or one more than the last at the end."""
    out, waiting, last, prev = [], [], None, None
    for i, (way, rank) in enumerate(rows):
        out.append(way)
        if way is not None:
            for j in waiting:
                out[j] = way
            waiting, last = [], way
        elif prev is not None and rank <= prev or last is None:
            waiting.append(i)
        else:
            out[i] = last
        prev = rank
    for j in waiting:
        out[j] = None if last is None else last + 1
    return out


def groups(rows):
    """(group number, way) of each row."""
    out, n, has_way, last_way, prev = [], 0, False, None, None
    for way, rank in rows:
        if n == 0 or rank == 1 or prev == 3 or (way is not None and has_way):
            n, has_way = n + 1, False
        has_way = has_way or way is not None
        out.append((n, way))
        prev = rank
    ways = {}
    for g in sorted({g for g, _ in out}):
        own = next((w for k, w in out if k == g and w is not None), None)
        last_way = own if own is not None else None if last_way is None else last_way + 1
        ways[g] = last_way
    return [(g, ways[g]) for g, _ in out]


def test_fills_against_state_machines(spark):
    rng = random.Random(11)
    pages = {p: [(rng.choice([None, None, rng.randint(1, 9)]), rng.randint(1, 3)) for _ in range(rng.randint(1, 9))] for p in range(300)}
    rows = [(p, i, w, f"L{r}", r) for p, page in pages.items() for i, (w, r) in enumerate(page)]
    df = spark.createDataFrame(rows, "page int, line int, way int, phase string, phase_rank int")
    got = {(r.page, r.line): r.filled_way for r in sequences.fill_ways(df, ["page"], ["line"]).collect()}
    grouped = sequences.infer_sequence(sequences.boundary_groups(df, ["page"], ["line"]), ["page"], ["line"])
    seen = {(r.page, r.line): (r.group_no, r.group_way) for r in grouped.collect()}
    for p, page in pages.items():
        assert [got[p, i] for i in range(len(page))] == fill(page)
        assert [seen[p, i] for i in range(len(page))] == groups(page)


def test_carry_and_stitch(spark):
    df = spark.createDataFrame([(1, 1, "DB-01", "Way Description"), (1, 2, None, "1 L1 16"), (2, 1, None, "Way Description"), (2, 2, None, "2 L1 16"), (3, 1, None, " ")], "page int, line int, board string, text string")
    got = sequences.stitch(df.withColumnRenamed("board", "b"), [], ["page", "line"], "text", "b").orderBy("page").collect()
    assert [(r.page, r.board) for r in got] == [(1, "DB-01"), (2, "DB-01")]
