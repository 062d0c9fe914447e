"""Window operators against brute force, with one group that fills most parts."""

import pytest

from veldspaat.operators.profiles import runs, stretches, steepest, trailing_and_following

ROWS = [(1, n, (n * 7919) % 23 // 9, float((n * 31) % 17)) for n in range(300)] + [(g, n, n % 2, float(n)) for g in (2, 3, None) for n in range(5)] + [(4, 0, None, None), (4, 1, None, 2.0), (4, 2, 1, None)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "g int, n int, s int, v double")


def grouped():
    out = {}
    for row in ROWS:
        out.setdefault(row[0], []).append(row[1:])
    return out


@pytest.mark.parametrize("parts", [2, 9, 40])
def test_runs(events, parts):
    from pyspark.sql import functions as F

    want = []
    for g, rows in grouped().items():
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][1] != rows[start][1]:
                want.append((g, rows[start][1], rows[start][0], i - start))
                start = i
    got = [tuple(r) for r in runs(events, group=["g"], order=["n"], state=F.col("s"), parts=parts).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("parts", [2, 9, 40])
@pytest.mark.parametrize("back", [1, 12])
def test_trailing_and_following(events, parts, back):
    def mean(values):
        values = [v for v in values if v is not None]
        return round(sum(values) / len(values), 9) if values else None

    want = {(g, rows[i][0]): (mean([r[2] for r in rows[max(0, i - back) : i]]), mean([r[2] for r in rows[i:]])) for g, rows in grouped().items() for i in range(len(rows))}
    found = trailing_and_following(events, group=["g"], order=["n"], value="v", back=back, parts=parts)
    assert found.columns == ["g", "n", "s", "v", "before", "after"]
    got = {(r.g, r.n): tuple(None if x is None else round(x, 9) for x in (r.before, r.after)) for r in found.collect()}
    assert got == want


@pytest.mark.parametrize("parts", [2, 9, 40])
def test_steepest(events, parts):
    want = set()
    for g, rows in grouped().items():
        steps = [(abs(b[2] - a[2]), -b[0]) for a, b in zip(rows, rows[1:]) if a[2] is not None and b[2] is not None]
        if steps:
            want.add((g, max(steps)[0], -max(steps)[1]))
    assert {(r.g, r.step, r.at) for r in steepest(events, group=["g"], order=["n"], value="v", parts=parts).collect()} == want


def test_a_busy_group_is_cut_and_an_empty_table_is_empty(events):
    sizes = {r._part: r["count"] for r in stretches(events, group=["g"], order=["n"], parts=8).groupBy("_part").count().collect()}
    assert len(sizes) >= 6 and max(sizes.values()) < 100
    none = events.where("n < 0")
    from pyspark.sql import functions as F

    assert runs(none, group=["g"], order=["n"], state=F.col("s")).count() == steepest(none, group=["g"], order=["n"], value="v").count() == 0
    assert trailing_and_following(none, group=["g"], order=["n"], value="v", back=3).count() == 0
