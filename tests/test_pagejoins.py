"""Joins inside pages against a comparison of everything with everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import pagejoins as J
from gridmill.plans import synth


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_words_in_regions(spark, seed):
    rnd = random.Random(seed)
    spread = [lambda: rnd.randint(0, 1000) / 4, lambda: rnd.choice([0.0, 5.0, 250.0]), lambda: 7.0][seed]
    words = [(p, 0, f"{p}-{k}", spread(), spread(), float(rnd.randint(0, 9)), 2.0) for p in (1, 2) for k in range(300)]
    regions = [(p, 0, k, *((a, a + rnd.choice([0.0, 3.0, 300.0, -5.0])) for a in (spread() + 3, spread())), ) for p in (1, 2, 3) for k in range(40)]
    regions = [(p, i, k, *x, *y) for p, i, k, x, y in regions] + [(1, 0, 99, -1e9, 1e9, -1e9, 1e9), (1, 0, 98, 5000.0, 6000.0, 0.0, 9.0)]
    claimed = [(p, i, w) for p, i, w, *_ in words if rnd.random() < 0.2]
    free = {x[:3] for x in words} - set(claimed)
    want = sorted((p, i, k, w) for p, i, k, x0, x1, y0, y1 in regions for q, j, w, left, top, width, height in words if (p, i) == (q, j) and (q, j, w) in free and x0 <= left + width / 2 <= x1 and y0 <= top + height / 2 <= y1)
    got = J.words_in_regions(
        spark.createDataFrame(words, "doc_id long, page_index int, word_id string, left double, top double, width double, height double"),
        spark.createDataFrame(regions, "doc_id long, page_index int, region_id int, x0 double, x1 double, y0 double, y1 double"),
        spark.createDataFrame(claimed, "doc_id long, page_index int, word_id string"),
    )
    assert rows_of(got) == want and len(want) > 40


def test_regions_meet_few_words(spark):
    """Ten thousand words, regions of a hundredth of the page: a region meets the words of its bins."""
    words = spark.createDataFrame([(1, 0, str(k), float(k % 100), float(k // 100), 0.0, 0.0) for k in range(10_000)], "doc_id long, page_index int, word_id string, left double, top double, width double, height double")
    regions = spark.createDataFrame([(1, 0, k, k * 1.5, k * 1.5 + 9, 20.0, 29.0) for k in range(50)], "doc_id long, page_index int, region_id int, x0 double, x1 double, y0 double, y1 double")
    found = J.words_in_regions(words, regions, words.limit(0))
    count = found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("bx") > 0
    assert count == sum(10 * len([x for x in range(100) if k * 1.5 <= x <= k * 1.5 + 9]) for k in range(50))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé日"])
def test_nearest_like(spark, letters):
    rnd = random.Random(len(letters))
    text = lambda most: "".join(rnd.choices(letters, k=rnd.randint(0, most)))
    base = [text(14) for _ in range(25)]
    bent = lambda s: "".join(rnd.choice([c, c, c, c, rnd.choice(letters), ""]) for c in s)
    cells = [(p, 0, k, rnd.choice([text(5), rnd.choice(base), rnd.choice(base).upper()])) for p in (1, 2) for k in range(40)] + [(3, 0, 0, "lonely"), (4, 0, 0, "ab"), (1, 0, 40, None)]
    words = [(p, 0, k, f"{p}-{k}", rnd.choice([text(6), bent(rnd.choice(base))])) for p in (1, 2) for k in range(60)] + [(4, 0, 0, "4-0", "xy"), (1, 0, 60, "1-60", None), (2, 0, 60, "2-60", "")]
    want = []
    for p, i, k, v in cells:
        if not v:
            continue
        n_cells, own = sum(c[0] == p for c in cells), [w for w in words if w[0] == p]
        at = k / (n_cells - 1) if n_cells > 1 else 0.0
        best = None
        for _, _, o, word, t in own:
            if t is None:
                continue
            d = distance(v.lower(), t.lower())
            if d <= max(2, len(v) * 0.4):
                score = (d + 5 * abs(at - (o / (len(own) - 1) if len(own) > 1 else 0.0)), o)
                best = min(best or (score, word), (score, word))
        if best:
            want.append((p, i, k, best[1]))
    got = J.nearest_like(spark.createDataFrame(cells, "doc_id long, page_index int, ord int, value string"), spark.createDataFrame(words, "doc_id long, page_index int, ord int, word_id string, text string"))
    assert rows_of(got) == sorted(want) and len(want) > 30


def test_few_candidates(spark, sf):
    cells = synth.model_cells(spark, sf).withColumn("ord", F.col("row_index") * 5 + F.col("col_index")).filter("value != ''")
    words = synth.words(spark, sf).withColumn("ord", F.col("word_ord"))
    key = ["doc_id", "page_index"]
    pairs = cells.groupBy(*key).agg(F.count("*").alias("n")).join(words.groupBy(*key).agg(F.count("*").alias("m")), key).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    candidates = J.near_candidates(cells, words).dropDuplicates([*key, "cell_ord", "word_ord"]).withColumn("near", F.expr("levenshtein(v, t) <= tau"))
    near, far = (candidates.filter(x).count() for x in ("near", "not near"))
    assert far < 0.005 * pairs and 0.05 * pairs < near < 0.15 * pairs  # nearly all that is compared is near; of these numbers and brands each is


@pytest.mark.parametrize("seed", range(4))
def test_valleys(spark, seed):
    rnd = random.Random(seed)
    pages = {p: [rnd.randint(0, 4) for _ in range(rnd.choice([1, 2, 7, 40]))] for p in range(8)}
    want = set()
    for p, cover in pages.items():
        seen = {}
        for k in range(6):
            i = 0
            while i < len(cover):
                if cover[i] <= k:
                    j = i
                    while j < len(cover) and cover[j] <= k:
                        j += 1
                    if i > 0 and j < len(cover):
                        seen.setdefault((float(i), float(j)), []).append(k)
                    i = j
                else:
                    i += 1
        want |= {(p, 0, a, b, min(ks), max(ks)) for (a, b), ks in seen.items()}
    rows = [(p, 0, i, c) for p, cover in pages.items() for i, c in enumerate(cover)]
    found = J.valleys(spark.createDataFrame(rows, "doc_id long, page_index int, x int, cover int"))
    assert set(rows_of(found)) == want and found.count() == len(want) <= len(rows)
