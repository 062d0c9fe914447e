import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspaat.operators.snapshots import snapshot_changes

SCHEMA = "product string, id string, tekst string, sha string, day date, read timestamp, kind string, _at int"
DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3)]


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, keys={"product": F.col("product"), "id": F.trim("id")}, snapshot="day", version="read", content=[F.trim("tekst")], imprint=[F.lower("sha")])
    return {(r.product, r.id, r.day, r.kind) for r in out.collect()}


def row(product, key, text, sha, day, at=0):
    return (product, key, text, sha, DAYS[day] if day is not None else None, dt.datetime(2024, 1, 5, 0, 0, at), "clash", 1)


def test_kinds_nulls_and_versions(spark):
    rows = [
        row("p", "a", "x", "S1", 0), row("p", "a", "x ", "s1", 1),  # only spaces and letter case
        row("p", "b", "x", "s", 0), row("p", "b", "y", "s", 1),  # changed
        row("p", "c", "x", "s", 0), row("p", "c", "x", "t", 1),  # reprinted
        row("p", "d", None, "s", 0), row("p", "d", None, "s", 1),  # two nulls
        row("p", "e", None, "s", 0), row("p", "e", "", "s", 1),  # null and a value
        row("p", "f", "x", "s", 0),  # removed
        row("p", "g", "x", "s", 1), row("p", " g", "late", "s", 1, at=5),  # added, later row counts
        row(None, None, "x", "s", 0), row(None, None, "z", "s", 1),  # a null key
        row("p", "b", "y", "s", 1),  # repeated row
        row("p", "nodate", "x", "s", None),
        row("p", "g", "late", "s", 2), row("p", "a", "x", "s1", 2),
    ]
    got = changes(spark, rows)
    d1, d2 = DAYS[1], DAYS[2]
    assert {x for x in got if x[2] == d1} == {("p", "b", d1, "changed"), ("p", "c", d1, "reprinted"), ("p", "e", d1, "changed"), ("p", "f", d1, "removed"), ("p", "g", d1, "added"), (None, None, d1, "changed")}
    assert {x[1:] for x in got if x[2] == d2} == {(k, d2, "removed") for k in ("b", "c", "d", "e", None)}


def test_empty_and_single(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [row("p", "a", "x", "s", 0)]) == set()


def test_tie_does_not_depend_on_order(spark):
    rows = [row("p", "a", "x", "s", 0), row("p", "a", "y", "s", 0), row("p", "a", "x", "s", 1), row("p", "a", "y", "s", 1)]
    assert changes(spark, rows) == changes(spark, rows[::-1]) == set()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("abc"), st.sampled_from(["x", "y", None]), st.sampled_from(["s", "t", None]), st.integers(0, 2), st.integers(0, 3)), max_size=25))
def test_against_brute_force(spark, raw):
    rows, seen = [], set()
    for r in raw:
        if (r[0], r[1], r[4], r[5]) not in seen:
            seen.add((r[0], r[1], r[4], r[5]))
            rows.append(r)
    state = {}
    for p, k, t, s, d, v in sorted(rows, key=lambda r: r[5]):
        state.setdefault(d, {})[p, k] = (t, s)
    want = set()
    for a, b in zip(sorted(state), sorted(state)[1:], strict=False):
        for key in state[a].keys() | state[b].keys():
            old, new = state[a].get(key), state[b].get(key)
            kind = "added" if old is None else "removed" if new is None else "changed" if old[0] != new[0] else "reprinted" if old[1] != new[1] else None
            if kind:
                want.add((*key, DAYS[b], kind))
    assert changes(spark, [row(p, k, t, s, d, v) for p, k, t, s, d, v in rows]) == want


def test_missing_snapshot_column_is_an_error(spark):
    with pytest.raises(Exception):
        snapshot_changes(spark.range(1), keys={"id": F.col("id")}, snapshot="no", version="id", content=[], imprint=[]).collect()
