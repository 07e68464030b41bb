"""Hard negatives, periodic runs and learned partitions against plain Python versions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.llm import hard_negatives, learned_partitions, periodic_runs, queries

VECTORS = "vec_id long, embedding array<double>, label int, id long, score double, part int, vector string, `group` int, shard int, rank int"
CLASH = (7, 0.5, 3, "clash", 1, 2, 9)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, l, *CLASH) for i, v, l in rows], VECTORS)


def odd_vectors(n=400, dims=12, seed=3):
    """Vectors in a few directions, with exact ties, one vector held by a third of the rows, and rows that take no part."""
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, dims))
    rows = [(i, (middle[draw.integers(6)] + 0.7 * draw.normal(size=dims)).round(2).tolist(), int(draw.integers(4))) for i in range(n)]
    same = rows[0][1]
    rows = [(i, same if i % 3 == 1 else v, l) for i, v, l in rows]
    odd = [(1000, None, 1), (1001, [0.5] * dims, None), (1002, [0.5] * (dims - 1) + [None], 1), (1003, [math.nan] + [0.5] * (dims - 1), 1),
           (1004, [math.inf] + [0.5] * (dims - 1), 1), (1005, [], 1), (1006, [1.0] * (dims + 3), 1), (None, [0.5] * dims, 1), (1007, [0.0] * dims, 2),
           (1100, [0.0] * dims, 2), (1200, [-3e4] * dims, 0), (1201, [3e4] * dims, 1), (1300, rows[5][1], 3)]
    return rows + odd


def good(rows, dims, label=True):
    return [(i, v, l) for i, v, l in rows if i is not None and v is not None and (l is not None or not label) and len(v) == dims
            and all(x is not None and math.isfinite(x) for x in v)]


def plain_negatives(rows, dims):
    rows = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in good(rows, dims)]
    out = []
    for a, v, l in (r for r in rows if r[0] % 100 == 0):
        score = {r[0]: sum(x * y for x, y in zip(v, r[1])) for r in rows}
        ranked = sorted((r for r in rows if r[0] != a), key=lambda r: (-score[r[0]], r[0]))
        for p in [r[0] for r in ranked if r[2] == l][:5]:
            fits = [r[0] for r in ranked if r[2] != l and 80 * score[p] <= 100 * score[r[0]] <= 100 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fits[:5])]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "GROUP", 2)  # several groups and blocks
    rows = odd_vectors(seed=seed)
    found = hard_negatives.mine(vector_table(spark, rows).repartition(3), F.col("vec_id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, 12)
    assert dict(found.dtypes)["rank"] == "int"


def test_hard_negatives_of_few_rows(spark):
    some = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (100, [0.0, 0.0], 3), (200, [-1.0, 0.0], 1), (300, [1.0, 0.1], 1)]
    found = sorted(tuple(r) for r in hard_negatives.mine(vector_table(spark, some), F.col("vec_id") % 100 == 0).collect())
    assert found == plain_negatives(some, 2) and found
    for rows in ([], [(0, None, 1)], [(0, [], 1), (100, [], 1)], [(0, [1.0], 1)]):
        assert hard_negatives.mine(vector_table(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_scores_beyond_exact_doubles(spark):
    big = 2.0 ** 30
    some = [(0, [big, big, 1.0], 1), (1, [big, big, 2.0], 1), (2, [big, big, 1.0], 2), (3, [big, big - 1, 0.5], 2)]
    found = sorted(tuple(r)[:4] for r in hard_negatives.mine(vector_table(spark, some), F.col("vec_id") == 0, scale=1).collect())
    assert found == [(0, 1, 1, 2), (0, 1, 2, 3)]


def test_repeated_ids_stay_rows(spark):
    some = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (5, [1.0, 1.0], 1), (5, [1.0, 1.0], 1), (6, [1.0, 1.0], 2)]
    found = hard_negatives.mine(vector_table(spark, some), F.col("vec_id") == 0).collect()
    assert sorted((r.positive_id, r.negative_id) for r in found) == [(5, 6)] * 4


def test_bounds_never_lose_an_answer():
    draw = np.random.default_rng(8)
    columns = draw.integers(-9, 10, (16, 300)).astype(float)
    block = hard_negatives.Block(np.arange(300), ["a"] * 300, columns)
    for _ in range(40):
        anchor = draw.integers(-9, 10, 16).astype(float)
        exact = anchor @ columns
        alive, score = hard_negatives.scan(anchor, block, np.arange(300), hard_negatives.best_of(4))
        assert (score == exact[alive]).all()
        assert hard_negatives.first(alive, score, block.ids, 4) == hard_negatives.first(np.arange(300), exact, block.ids, 4)
        spans = [(20, 60), (100, 140), (-5, -5)]
        alive, score = hard_negatives.scan(anchor, block, np.arange(300), hard_negatives.inside(spans, 4))
        for low, high in spans:
            own, all_rows = (score >= low) & (score <= high), np.flatnonzero((exact >= low) & (exact <= high))
            assert hard_negatives.first(alive[own], score[own], block.ids, 4) == hard_negatives.first(all_rows, exact[all_rows], block.ids, 4)


# ---- periodic runs -------------------------------------------------------------------------------------------------

def plain_runs(words, least=12):
    n, found, claimed = len(words), [], {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                seg = tuple(words[i:j + q])
                if not any(seg[p:] == seg[:-p] for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found)


def plain_digest(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = ["x"], ["x", "Y"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def run_texts():
    draw = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a A " * 6, "a b c " * 4, "x " + "ab cd ef gh ij kl " * 2 + "y", " ".join(fibonacci(233)),
             "é ü " * 9 + "\n" + "é ü " * 9, "z".join(["q w e r t "] * 5), "ab cd ef gh ij kl " * 2 + "mn " + "ab cd ef gh ij kl " * 2]
    for _ in range(120):
        k = draw.choice([1, 2, 3, 8, 60])
        words = [f"w{draw.randrange(k)}" for _ in range(draw.randrange(0, 160))]
        if words and draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randrange(1, 30)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        texts.append(draw.choice([" ", "\n", " \t "]).join(words))
    return texts


def test_periodic_runs_equal_brute_force(spark, tmp_path):
    rows = [(i, t, "s", i) for i, t in enumerate(run_texts())] + [(None, "a b " * 9, "s", 1), (3, "a b " * 9, "s", 1), (3, "a b " * 9, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_digest(r[0], r[1]) for r in rows), key=repr)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [
        ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert periodic_runs.collapse_runs(docs.limit(0)).collect() == []


def test_runs_of_any_least_length():
    draw = random.Random(6)
    for _ in range(400):
        words = [draw.randrange(draw.choice([1, 2, 4])) for _ in range(draw.randrange(0, 45))]
        for least in (2, 3, 12):
            assert periodic_runs.runs_of(words, least) == plain_runs(words, least)
            (n, runs, _), = periodic_runs.find([" ".join(map(str, words)).encode()], least)
            assert (n, runs) == (len(words), plain_runs(words, least))


def test_long_periodic_texts_take_time_in_proportion():
    import time
    words = [x % 40_000 for x in range(200_000)]
    start = time.time()
    assert periodic_runs.runs_of(words) == [(0, 200_000, 40_000)]
    assert periodic_runs.runs_of([0] * 200_000) == [(0, 200_000, 1)]
    assert time.time() - start < 60


# ---- nearest neighbours --------------------------------------------------------------------------------------------

def plain_neighbours(rows, dims, k=10, step=100):
    rows = [(i, np.array(v)) for i, v, _ in good(rows, dims, label=False) if any(v)]
    out = {}
    for a, v in (r for r in rows if r[0] % step == 0):
        near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows if i != a)
        out[a] = near[:k]
    return out


def recall_of(found, truth):
    """Share of the true nearest that are found; a tie with the farthest counts, as either answer is right."""
    hits = total = 0
    for a, near in truth.items():
        total += len(near)
        far = near[-1][0] if near else 0
        hits += sum(r.score <= far + 1e-9 for r in found if r.query_id == a)
    return hits / max(1, total)


def test_neighbours_of_a_small_table_are_exact(spark):
    rows = odd_vectors()
    found = learned_partitions.search(vector_table(spark, rows), F.col("vec_id") % 100 == 0).collect()
    truth = plain_neighbours(rows, 12)
    assert {r.query_id for r in found} == set(truth) and 1007 not in truth
    for a, near in truth.items():
        own = sorted((r for r in found if r.query_id == a), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(near) + 1))
        assert [r.neighbour_id for r in own] == [i for _, i in near]
        assert np.allclose([r.score for r in own], [s for s, _ in near], rtol=1e-12)
    for few in ([], [(0, [1.0, 2.0], 1)], [(0, [0.0, 0.0], 1), (100, None, 1)]):
        assert learned_partitions.search(vector_table(spark, few), F.col("vec_id") % 100 == 0).collect() == []
    three = [(0, [1e200, 0.0], 1), (1, [-1e200, 1.0], 1), (100, [1e200, 0.0], None)]
    found = learned_partitions.search(vector_table(spark, three), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in found) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_routed_search_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "CELL_ROWS", 200)  # large partitions in several cells
    monkeypatch.setattr(learned_partitions, "CELL_QUERIES", 8)
    draw = np.random.default_rng(12)
    middle = draw.normal(size=(40, 16))
    vectors = middle[draw.integers(0, 40, 6000)] + 0.4 * draw.normal(size=(6000, 16))
    vectors[1500:3500] = vectors[0]  # a third of the rows are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    table = vector_table(spark, rows)
    router = learned_partitions.fit(spark, learned_partitions._sample(table.withColumn("vector", F.col("embedding")), 6000, 16, 1))
    assert 1 <= router.probes < len(router.bias)
    found = learned_partitions.search(table, F.col("vec_id") % 100 == 0).collect()
    truth = plain_neighbours(rows, 16)
    assert len(found) == 10 * len(truth) and recall_of(found, truth) >= 0.9


def test_partitions_are_balanced():
    draw = np.random.default_rng(2)
    rows = learned_partitions.directions(draw.normal(size=(2000, 8)) + np.repeat(np.eye(8) * 4, 250, axis=0))
    edges = learned_partitions.nearest(rows, rows, 10, np.arange(2000))
    where = learned_partitions.cut_graph(rows, edges, 8, 1)
    assert np.bincount(where, minlength=8).max() <= math.ceil(1.1 * 250)
    assert (where[edges] != where[:, None]).mean() < 0.5  # a random cut has 0.875
