import random

import numpy as np
import pytest

from chronoloom.llm import jaccard
from chronoloom.llm.shingles import shingle_sets

from ..conftest import SMALL
from ..twins import check


def words(text):
    lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]


def brute(texts, size, percent):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {k: k for k in texts}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {k: (len(sets[k]), top(k)) for k in keys}


def near_texts(seed, groups=12, most=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts, k = {}, 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 150])) + (passage if rng.random() < 0.7 else [])
        for _ in range(rng.randint(1, most)):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.08]) else w for w in base]
            texts[k] = " ".join(copy)
            k += 1
    return texts


@pytest.mark.parametrize(("seed", "size", "percent", "points", "few"), [(1, 3, 90, 256, 16), (2, 5, 80, 256, 16), (3, 5, 80, 3, 16), (4, 3, 90, 256, 2), (5, 5, 80, 4, 3), (6, 5, 60, 4, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, size, percent, points, few):
    """Small clusters in one task, large ones by rounds over tasks, and pairs of blocks, are all exact."""
    monkeypatch.setattr(jaccard, "FEW", few)
    texts = near_texts(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_copies(docs, size=size, percent=percent, points=points, pivots=3, rounds=2).collect()}
    assert found == brute(texts, size, percent)


def chained_sets(rng, n):
    """Sets that drift: neighbours are linked, far ones are not."""
    now, out = rng.integers(0, 1 << 62, 60).astype(np.uint64), []
    for _ in range(n):
        now = now.copy()
        now[rng.integers(0, 60, int(rng.integers(1, 9)))] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        out.append(np.unique(now))
    return out


def classes_of(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    return label


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_regions_in_a_task(percent):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sets = chained_sets(rng, int(rng.integers(2, 90)))
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), percent)]
        found = jaccard.join_points(list(range(len(sets))), sets, percent, pivots=4)
        assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, pairs)))
        assert classes_of(len(sets), found) == classes_of(len(sets), pairs)


def test_regions_over_tasks(spark):
    """One region of 150 points with at most 10 in a task: regions, boundaries and recursion give the links' classes, from few comparisons."""
    sets = chained_sets(np.random.default_rng(4), 150)
    members = spark.createDataFrame([(1, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "region long, point long, set binary")
    pairs = [(a, b) for a in range(150) for b in range(a) if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)]
    measured = jaccard._measured(members, jaccard._large(members, 10), 80, 4, 0)
    assert measured.where("size(links) > 0 AND pivot < 0").count() > 0
    links = [(r.a, r.b) for r in jaccard.region_links(members, percent=80, points=10, pivots=4, rounds=3).collect()]
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, pairs)))
    assert classes_of(150, links) == classes_of(150, pairs)
    boundary = jaccard._boundaries(measured, jaccard._pivot_classes(measured), 80, 10)
    assert boundary.count() > 0  # a region's own points and those copied to it


def test_isolated_points_are_proved(spark):
    """Those that are left out have no link, and few others are left in."""
    rng = random.Random(9)
    texts = near_texts(9) | {1000 + k: " ".join(f"u{rng.random()}" for _ in range(120)) for k in range(200)}
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    points = jaccard._points(rows, 5).cache()
    kept = {r.key for r in jaccard._not_isolated(rows, points, 5, 80).collect()}
    heads = [top for _, top in brute(texts, 5, 80).values()]
    least = {(r.a, r.b): min(k.key for k in points.collect() if (k.a, k.b) == (r.a, r.b)) for r in points.collect()}
    linked_keys = {k for k, (_, top) in brute(texts, 5, 80).items() if heads.count(top) > 1}
    distinct = {least[r.a, r.b] for r in points.collect() if r.key in linked_keys}
    heads_of = brute({k: texts[k] for k in distinct}, 5, 80)
    need = {k for k, (_, top) in heads_of.items() if [t for _, t in heads_of.values()].count(top) > 1}
    assert need <= kept and sum(k >= 1000 for k in kept) <= 10


def test_null_and_shared_keys(spark):
    """Rows under null keys, and other texts under the same key, are joined by their texts."""
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(None, a), (7, a + " more"), (7, b), (9, b), (None, "quite alone")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=90).collect()), key=str)
    assert found == sorted([(None, 48, 7), (7, 49, 7), (7, 48, 7), (9, 48, 7), (None, 1, None)], key=str)


def test_sql_twin(spark, duck):
    check(jaccard.op3_jaccard_metric_join, jaccard.SQL_OP3, spark, duck, SMALL)


def test_odd_rows(odd, none):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(odd, size=3, percent=90).collect()]
    assert found.count((1, 8, 1)) == 2 and (2, 0, 2) in found and (3, 0, 3) in found and (8, 1, 8) in found
    assert (9, 1, 9) in found and (10, 1, 9) in found and len(found) == odd.count()
    assert jaccard.near_copies(none, size=3, percent=90).count() == 0


def test_parts_of_linked_sets():
    rng = np.random.default_rng(7)
    classes = jaccard.size_classes(80)
    for _ in range(300):
        n = int(rng.integers(2, 200))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 15)))).astype(np.uint64)]))
        shared = len(np.intersect1d(base, other))
        if not len(other) or not jaccard.linked(shared, len(base), len(other), 80) or np.array_equal(base, other):
            continue
        a, b = (dict(zip(*(x.tolist() for x in jaccard.part_values(s, classes, 80)), strict=True)) for s in (base, other))
        both = set(a) & set(b)
        of = lambda d, k: max((t % jaccard.TAG for t in d.values() if t // jaccard.TAG == k), default=0)
        assert any(sum(a[v] // jaccard.TAG == k for v in both) >= max(of(a, k), of(b, k)) for k in {a[v] // jaccard.TAG for v in both})


def test_short_texts_are_one_shingle():
    text = "ab cd".encode()
    (s,) = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
    assert len(s) == 1


def test_only_shared_shingles_are_told(spark, monkeypatch):
    """Points that may have links are those that a count over all texts gives; nothing is told of a shingle that stands in one text alone."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lone = [[word() for _ in range(rng.randint(1, 60))] for _ in range(80)]
    near = [[*w[:-1], word()] for w in lone[:12]]
    texts = [" ".join(w) for w in lone + near] + [" ".join(lone[3])] * 5 + ["", None]
    table = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "PACKED", 50)
    sampled = jaccard._sampled(table, 3, 80, 7)
    told = {r.a: r.shared for r in jaccard._shared(sampled).collect()}
    sets = {}
    for t in texts:
        if t:
            b = t.encode()
            s = shingle_sets(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 3)[0]
            sets[s.tobytes()] = s[s < np.uint64(jaccard._range_of(80))].tolist(), len(s), int(jaccard._digests([s])[0][0])
    holds = {}
    for own, _, a in sets.values():
        for x in own:
            holds.setdefault(x, set()).add(a)
    want = {a: sum(len(holds[x]) > 1 for x in own) for own, _, a in sets.values()}
    assert told == {a: n for a, n in want.items() if n} and len(told) < 40
    some = {r.a for r in jaccard._not_isolated(table, jaccard._points(table, 3, 80), 3, 80).collect()}
    assert some == {a for own, n, a in sets.values() if 100 * (len(own) - want[a]) <= 20 * n}
