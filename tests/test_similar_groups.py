import re

import numpy as np

from chronoloom.operators import lexical as C


def test_three_rules_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = {w: rng.standard_normal(5) for w in ("graph", "neural net", "node", "ion", "x")}
    terms = ["graph", "graphs", "graphing tool", "neural net", "neural network", "net", "node", "nodes", "ion", "region", "x", "xy", "a", "lone"]
    rows = []
    for g in (1, 2, None):
        for t in terms:
            near = next((v for w, v in base.items() if w in t), rng.standard_normal(5))
            v = near + rng.standard_normal(5) * (0.35 if g == 1 else 0.6) * np.linalg.norm(near) / 2
            rows.append((g, t, None if t == "lone" else [0.0] * 5 if t == "a" else v.tolist()))
    rows += [(1, None, [1.0] * 5), (2, "a", [0.0] * 5)]
    table = spark.createDataFrame(rows, "grp int, term string, vector array<double>").repartition(3)
    stem = lambda t: re.sub(r"(ies|es|s|ing|ed)\b", "", t)
    cos = lambda a, b: 0.0 if a is None or b is None or not np.any(a) or not np.any(b) else np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want, linked = {}, set()
    for g in (1, 2):
        own = {t: v for k, t, v in rows if k == g and t}
        head = {t: t for t in own}
        for a in own:
            for b in own:
                c = cos(own[a], own[b])
                if a < b and (stem(a) == stem(b) or c >= 0.82 or ((a in b or b in a) and c > 0.72)):
                    linked.add("stem" if stem(a) == stem(b) else "near" if c >= 0.82 else "within")
                    x, y = sorted((head[a], head[b]))
                    head = {t: x if h == y else h for t, h in head.items()}
        want |= {(g, t): h for t, h in head.items()}
    assert linked == {"stem", "near", "within"}
    got = C.similar_groups(table).collect()
    assert len(got) == len(want) and {(r.grp, r.term): r.head for r in got} == want
    assert C.similar_groups(table.where("grp > 5")).count() == 0


def test_contained(spark):
    terms = ["a", "ab", "abc", "xabcx", "bc", "cab", "zz", "ö", "töne"]
    rows = spark.createDataFrame([(g, t) for g in "pq" for t in terms if g == "p" or len(t) > 2], "grp string, term string")
    got = {(r.grp, r.part, r.whole) for r in C.contained(rows).collect()}
    assert got == {(g, a, b) for g in "pq" for a in terms for b in terms if a != b and a in b and (g == "p" or min(len(a), len(b)) > 2)}
