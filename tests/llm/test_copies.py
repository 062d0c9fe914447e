import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldspaat.llm.nearcopies import band_plan, groups, item_pairs, minmax_bands, near_copies
from veldspaat.llm.words import shingles, word_codes, words

SCHEMA = "id long, kop string, tekst string, _class string, similarity int"


def sets(rows, width):
    out = {}
    for i, kop, text in rows:
        if text is not None and i is not None:
            w = re.findall(r"[^\W_]+", f"{kop or ''} {text}".lower())
            s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
            if s:
                out[i] = s
    return out


def brute(rows, width, least):
    s = sets(rows, width)
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= least * len(s[a] | s[b]) - 1e-9}


def run(spark, rows, width, least):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    text = F.concat(F.coalesce("kop", F.lit("")), F.lit(" "), F.col("tekst"))
    return near_copies(df, item="id", text=text, width=width, similarity=least)


def versions(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rows[rng.randrange(len(rows))][2].split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(rng.choices(vocabulary, k=40))
        rows.append((i, rng.choice([None, "kop", "Kop!"]), text))
    return rows


@pytest.mark.parametrize("width,least", [(3, 0.6), (5, 0.8)])
def test_against_brute_force(spark, width, least):
    rows = versions(width, 120) + [(900, None, None), (901, None, ""), (902, None, "een twee"), (None, "kop", "a b c d e f")]
    rows += [rows[3]]
    members, links = run(spark, rows, width, least)
    assert {tuple(r) for r in item_pairs(members, links, item="id").collect()} == brute(rows, width, least)
    assert {r.id for r in members.collect()} == set(sets(rows, width))


def test_copies_are_one_class_and_groups_follow_links(spark):
    rows = [(i, None, "alle kopieën zijn van dezelfde tekst met zes woorden meer") for i in range(200)]
    rows += [(1000, None, "alle kopieën zijn van dezelfde tekst met zes woorden meer slot"), (2000, "x", "iets heel anders staat in deze regel hier")]
    members, links = run(spark, rows, 3, 0.6)
    assert links.count() == 1
    found = {r.id: r for r in groups(members, links, item="id").collect()}
    assert len(found) == 202 and found[0].copies == 200 and found[0].n_links == 1 and found[2000].n_links == 0
    assert found[0].group == found[1000].group != found[2000].group


def test_a_class_with_a_third_of_all_records_is_spelt_out_in_parts(spark, monkeypatch):
    from veldspaat.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    stem = "alle kopieën zijn van dezelfde tekst met zes woorden meer en nog wat"
    rows = [(i, None, stem) for i in range(60)] + [(100 + i, None, f"{stem} slot{i}") for i in range(40)] + [(200 + i, None, f"een andere tekst {i} met heel eigen {i * 7} woorden erin {i * 13}") for i in range(80)]
    members, links = run(spark, rows, 3, 0.6)
    pairs = [tuple(r) for r in item_pairs(members, links, item="id").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, 3, 0.6)


def test_chain_is_one_group(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(k, None, " ".join(w[k * 2 : k * 2 + 30])) for k in range(12)]
    members, links = run(spark, rows, 3, 0.8)
    assert {r.group for r in groups(members, links, item="id").collect()} == {min(r["class"] for r in members.collect())}


def test_empty(spark):
    members, links = run(spark, [], 3, 0.6)
    assert members.count() == links.count() == item_pairs(members, links, item="id").count() == groups(members, links, item="id").count() == 0


def test_bands_catch_what_they_promise():
    rows, bands = band_plan(0.6)
    assert (1 - 0.6**rows) ** bands <= 2e-4 and band_plan(0.8)[0] > rows
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        common, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (60, 20, 20))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        h = minmax_bands(np.concatenate([x, y]), np.array([0, 80, 160]), rows, bands)
        hits += bool((h[0] == h[1]).any())
    assert hits >= 198


def test_words_and_shingles():
    flat, offsets = words(pa.array([None, "", "Één-twee  DRIE_vier 5", "...", "a b"]))
    assert flat.to_pylist() == ["één", "twee", "drie", "vier", "5", "a", "b"] and offsets.tolist() == [0, 0, 0, 5, 5, 7]
    values, at = shingles(word_codes(flat), offsets, 2)
    assert np.diff(at).tolist() == [0, 0, 4, 0, 1]
