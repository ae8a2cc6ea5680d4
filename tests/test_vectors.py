"""The approximate index of vectors: recall, folders read, filters, and the exact answer beside it."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.library import Library
from quillstone.operators import retrieval as R
from quillstone.operators.vectors import Codes, VectorIndex, means
from tests.test_library import rows_of


def grouped(n=1200, dim=10, groups=12):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((groups, dim))
    return middle[np.arange(n) % groups] + 0.2 * rng.standard_normal((n, dim))


def test_recall_and_folders_read(spark, tmp_path):
    v = grouped()
    rows = [(i, x, i % 3) for i, x in enumerate(v.tolist())]
    odd = [(9001, None, 0), (9002, [0.0] * 10, 0), (9003, [float("nan")] * 10, 0), (9004, [1.0, 2.0], 0), (9005, [None] * 10, 0), (9006, [], 0)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, label int")
    index = VectorIndex.build(df, f"file://{tmp_path}/i")
    again = VectorIndex.read(spark, f"file://{tmp_path}/i")
    assert sorted(r["id"] for r in index.rows().select("id").collect()) == list(range(len(rows)))  # every vector with a direction
    assert 1 <= again.codes.probes < len(again.codes.lists)
    questions = [(i, v[i].tolist()) for i in range(0, len(rows), 100)]  # ids divisible by 100
    found = again.recall(questions[:6], 20).agg(F.sum("n"), F.sum("found")).first()
    assert found[0] == 120 and found[1] >= 0.9 * found[0]
    q = spark.createDataFrame([(questions[1][1],)], "q array<double>")
    good = df.where("id < 9000")
    for where in (None, F.col("label") == 1):
        want = R.dense(good, q, 20, where).orderBy("dense_rank").collect()
        assert again.search(questions[1][1], 20, None, where).orderBy("dense_rank").collect() == want
        assert again.search(questions[1][1], 20, len(again.codes.lists), where).orderBy("dense_rank").collect() == want  # by codes, all lists
    own = again.rows(again.codes.probed(np.array(questions[1][1]) / np.linalg.norm(questions[1][1]), 2))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and own.select("list").distinct().count() == 2
    assert again.search([0.0] * 10, 5).count() == 0 and again.search([1.0], 5).count() == 0
    empty = VectorIndex.build(df.limit(0), f"file://{tmp_path}/e")
    assert empty.codes.probes == 1


def test_codes_keep_what_is_near():
    x = grouped()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = Codes.fit(x, 20)
    own, code = codes.encode(x)
    q = x[7]
    said = codes.lists[own] @ q + sum(t[code[:, k]] for k, t in enumerate(codes.tables(q)))
    assert code.dtype == np.uint8 and np.abs(said - x @ q).max() < 0.1
    assert len(means(x[:3], 8)) == 3 and means(x[:0], 4).shape == (0, 10)


def test_library_near(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/h")
    lib.ingest(rows_of(spark, "1", ["zinc", "gold", "iron"]))
    ids = sorted(r["id"] for r in lib.rows().collect())
    lib.tables.write("vectors", spark.createDataFrame([(i, [1.0, float(k), 0.5]) for k, i in enumerate(ids)], "id string, v array<float>"))
    lib.index_vectors()
    for where in (None, {"type": "text"}):
        assert lib.near([1.0, 1.0, 0.5], 2, where, None).collect() == lib.dense([1.0, 1.0, 0.5], 2, where).collect()
        assert lib.near([1.0, 1.0, 0.5], 2, where).collect() == lib.dense([1.0, 1.0, 0.5], 2, where).collect()
