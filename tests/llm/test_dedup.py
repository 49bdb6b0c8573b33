import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.helpers import ASCII, ODD, components, empty, frame, near_copies
from vellumine.llm import blocks, exact_dedup, ngram_join
from vellumine.llm.common import Scratch
from vellumine.llm.components import connected_components
from vellumine.llm.near_vectors import near_vectors, tables_for
from vellumine.llm.shingles import shingle_sets


@given(st.sets(st.integers(0, 2**50 - 1), max_size=60), st.randoms())
def test_golomb_round_trip(values, rng):
    given_values = np.array(sorted(values), np.uint64)
    flags = np.array([rng.random() < 0.5 for _ in values], bool)
    back, seen = exact_dedup.golomb_decode(exact_dedup.golomb_encode(given_values, 50, flags))
    assert (back == given_values).all() and (seen == flags).all()


def test_exact_duplicates(spark):
    found = exact_dedup.exact_duplicates(frame(spark)).collect()
    groups = defaultdict(list)
    for i, text in ODD:
        groups[(text or "").translate(ASCII)].append(i)
    want = sorted((str(i), str(max([x for x in groups[t] if x is not None], default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, (t or "").translate(ASCII)) for i, t in ODD))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(frame(spark))
    assert kept.count() == len(groups) and kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} >= {2, 6, 9}
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("partitions", "hashes", "broadcast"), [(7, 16, 10**6), (40, 16, 10**6), (7, 10**6, 0)])
def test_many_copies(spark, monkeypatch, partitions, hashes, broadcast):
    from vellumine.llm import common

    monkeypatch.setattr(exact_dedup, "LIST_HASHES", hashes)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(600)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions))
    hot = found.where("group_size > 1")
    assert found.count() == 600 and found.where("kept").count() == 201
    assert hot.count() == 400 and hot.select("group_size", "keep_id").distinct().collect() == [(400, 599)]


@pytest.mark.parametrize("hot", [10**5, 20])
def test_components(spark, monkeypatch, hot):
    from vellumine.llm import common
    from vellumine.llm import components as module

    monkeypatch.setattr(module, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    if hot == 20:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    want = components({x for pair in links for x in pair}, links)
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert found == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=15))
def test_forest(pairs):
    a, b = np.array([x for x, _ in pairs], int), np.array([y for _, y in pairs], int)
    at, to = blocks.forest(10, a, b)
    want = components(range(10), pairs)
    assert {int(x): int(y) for x, y in zip(at, to, strict=True)} == {k: v for k, v in want.items() if k != v}


def test_scratch_is_deleted(spark):
    import glob

    from vellumine.llm.common import shared_dir, temporary

    rows = spark.createDataFrame([(1,)], "a int")
    kept = Scratch(spark, "test")
    kept.write(rows, "x")
    with temporary():
        own = Scratch(spark, "test")
        own.write(rows, "y")
        own.write(rows, "z")
        own.keep("z")
        assert own.labels == {"z"} and own.read("z", rows.schema).count() == 1
    folder = shared_dir(spark).removeprefix("file:")
    left = glob.glob(f"{folder.replace('//', '/', 1)}/vellumine/*/*")
    assert any(kept.root.endswith(x.split("/")[-2]) for x in left) and not any(own.root.endswith(x.split("/")[-2]) for x in left)


def test_cells_cover_every_pair_once(spark):
    entries = spark.createDataFrame([(i % 3, i) for i in range(60)], "k int, m long")
    rows = blocks.cells(entries, ["k"], "m", 6, Scratch(spark, "test"), "large").collect()
    met = defaultdict(int)
    for x in rows:
        for y in rows:
            if x.cell == y.cell and x.m < y.m and (x.own == x.other or x.own != y.own):
                met[x.m, y.m] += 1
    assert met == {(a, b): 1 for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}


def test_shingles():
    texts = [b"a b c d e", b"", b"  ", b"a b", b"a b a b a b a b", b"x" * 3000 + b" y z w", b"a\tb\nc  d"]
    sets = shingle_sets(texts, 4)
    assert [len(x) for x in sets] == [2, 0, 0, 1, 2, 1, 1]
    assert sets[6][0] in sets[0] and all((x == shingle_sets([t], 4)[0]).all() for x, t in zip(sets, texts, strict=True))
    assert shingle_sets([b"a b"], 4)[0][0] != shingle_sets([b"b a"], 4)[0][0]


def brute(rows, n, least):
    sets = {}
    for i, (_, text) in enumerate(rows):
        words = (text or "").translate(ASCII).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        words = [x for x in words if x]
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    roots = components(sets, linked)
    least_id = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least_id[r] = min(rows[i][0], least_id.get(r, rows[i][0]))
    return [(len(sets[i]), rows[i][0] if not sets[i] else least_id.get(roots[i])) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "least", "paired", "common", "hot"), [(4, Fraction(85, 100), 32, 16, 12), (5, Fraction(4, 5), 1, 3, 2), (4, Fraction(85, 100), 3, 10**9, 12)])
def test_jaccard_components(spark, monkeypatch, n, least, paired, common, hot):
    from vellumine.llm import common as shared

    for name, value in (("PAIRED", paired), ("COMMON_FROM", common), ("HOT_LEVEL", hot), ("DENSE_BLOCK", 1500), ("FINE", 1000), ("FOLLOWERS", 3), ("BLOCK", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    if hot == 2:
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = near_copies() + [(1000 + (i or 0) if i is not None else None, t) for i, t in ODD]
    found = ngram_join.jaccard_components(frame(spark, rows), n, least)
    want = sorted((str(i), *x) for (i, _), x in zip(rows, map(lambda p: (p[0], str(p[1])), brute(rows, n, least)), strict=True))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == want


def test_drop_near_duplicates(spark):
    rows = near_copies(seed=3) + [(5000, None), (5001, ""), (6, "one"), (6, "one")]
    kept = ngram_join.drop_near_duplicates(frame(spark, rows))
    want = brute(rows, 5, Fraction(4, 5))
    groups = {(c, n > 0) if n else ("empty", i) for i, (n, c) in enumerate(want)}
    assert kept.count() == len(groups) and {5000, 5001} <= {r.doc_id for r in kept.collect()} and kept.columns == frame(spark, rows).columns
    assert ngram_join.jaccard_components(empty(spark)).count() == 0 and ngram_join.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize(("whole", "broadcast"), [(10**6, 10**6), (4, 0)])
def test_near_vectors(spark, monkeypatch, whole, broadcast):
    from vellumine.llm import common
    from vellumine.llm import near_vectors as module

    for owner, name, value in ((module, "BLOCK", 16), (module, "WHOLE", whole), (common, "BROADCAST_ROWS", broadcast), (common, "HOT_ROWS", 10)):
        monkeypatch.setattr(owner, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    vectors = [base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.3]) for _ in range(300)] + [base[0]] * 60
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (5, rows[5][1]), (1008, [float("inf")] * 16), (1009, [-x for x in rows[0][1]])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "'x' label", "1 cid", "2 w").repartition(3)
    found = near_vectors(table).collect()
    flat = rows + odd
    good = {i: np.array(v, float) for i, (_, v) in enumerate(flat) if v and None not in v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a] * (good[b] @ good[b])) >= 0.95]
    roots = components(range(len(flat)), linked)
    count = defaultdict(int)
    for a, b in linked:
        count[a] += 1
        count[b] += 1
    least = {}
    for i, r in roots.items():
        least[r] = min(flat[i][0], least.get(r, flat[i][0]))
    want = sorted((flat[i][0], count[i], least[roots[i]], flat[i][0] == least[roots[i]]) for i in range(len(flat)))
    have = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found)
    links = sum(x[1] for x in want)
    assert sum(x[1] for x in have) >= 0.99 * links and all(h[1] <= w[1] for h, w in zip(have, want, strict=True))
    assert [x[0] for x in have] == [x[0] for x in want] and sum(h[2] != w[2] for h, w in zip(have, want, strict=True)) <= 3
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_whose_squares_overflow(spark):
    big, small = [1e200, 1e200, 0.0], [1e-200, 1e-200, 0.0]
    table = spark.createDataFrame([(1, big), (2, small), (3, [0.0, 0.0, 1e-300]), (4, [float("-inf"), 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(table).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_hot_join(spark, monkeypatch):
    from vellumine.llm import common

    for name, value in (("BROADCAST_ROWS", 0), ("HOT_ROWS", 7)):
        monkeypatch.setattr(common, name, value)
    rows = [(None if i % 9 == 0 else "hot" if i % 2 else f"k{i % 5}", i) for i in range(100)]
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    frame_ = spark.createDataFrame(rows, "k string, m int")
    for how in ("inner", "left"):
        want = sorted((m, str({"hot": 1, "k1": 2, "k2": 3}.get(k))) for k, m in rows if how == "left" or k in ("hot", "k1", "k2"))
        assert sorted((r.m, str(r.v)) for r in common.hot_join(frame_, side, "k", "m", Scratch(spark, "test"), "hot", how).collect()) == want


def test_recall_is_planned_for():
    for count in (2, 500, 10**5, 10**9):
        bits, tables = tables_for(count, 0.95)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.998
