"""Vector search against a brute-force table, and the ways of searching against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsearch.functions.vectors import cosine_distance, rounded
from finsearch.operators import vector_search as vs
from finsearch.registry.search import LSH
from finsearch.session import work_dir

SCHEMA = "id long, embedding array<float>"


def make(spark, n, dim=8, seed=3, schema=SCHEMA, first=0):
    values = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return values, spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(values)], schema)


def far(queries, corpus):
    q = queries.astype(np.float64)
    c = corpus.astype(np.float64)
    q /= np.linalg.norm(q, axis=1)[:, None]
    c /= np.linalg.norm(c, axis=1)[:, None]
    return np.round(1 - q @ c.T, 9) + 0.0


def brute(dist, ids, k, cutoff=None):
    rows = sorted((d, i) for d, i in zip(dist, ids) if cutoff is None or d < cutoff)[:k]
    return [(i, d) for d, i in rows]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rn").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    corpus, corpus_df = make(spark, 200)
    asked, asked_df = make(spark, 7, seed=4, schema="query_id long, vector array<float>")
    return corpus, corpus_df.repartition(4).cache(), asked, asked_df


@pytest.mark.parametrize("cutoff", [None, 0.6])
@pytest.mark.parametrize("pack_rows", [1024, 3])
def test_exact_search(tables, cutoff, pack_rows):
    corpus, corpus_df, asked, asked_df = tables
    got = found(vs.vector_search(corpus_df, asked_df, 9, cutoff, pack_rows))
    dist = far(asked, corpus)
    for q in range(len(asked)):
        assert got.get(q, []) == brute(dist[q], range(200), 9, cutoff)


def test_cells_equal_exact_when_all_are_probed(spark, tables):
    _, corpus_df, _, asked_df = tables
    index = vs.build_ivf(corpus_df, 6, work_dir(spark, "t-cells"))
    exact = found(vs.vector_search(corpus_df, asked_df, 9, None))
    assert found(vs.ivf_search(spark, index, asked_df, 6, 9, None)) == exact
    shares = []
    for nprobe in (1, 3, 6):
        near = found(vs.ivf_search(spark, index, asked_df, nprobe, 9, None))
        shares.append(sum(len(set(near[q]) & set(exact[q])) for q in exact))
    assert shares == sorted(shares) and shares[-1] == 63


@pytest.mark.parametrize("nprobe", [1, 6])
def test_cells_take_textual_keys(spark, tables, nprobe):
    _, corpus_df, _, asked_df = tables
    index = vs.build_ivf(corpus_df, 6, work_dir(spark, "t-cells"))
    named = asked_df.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "vector")
    want = found(vs.ivf_search(spark, index, asked_df, nprobe, 9, 0.6))
    assert found(vs.ivf_search(spark, index, named, nprobe, 9, 0.6)) == {f"q{q}": rows for q, rows in want.items()}


@pytest.mark.parametrize("ids, vectors", [("string", "array<float>"), ("int", "array<double>"), ("long", "array<double>")])
def test_key_and_vector_types(spark, ids, vectors):
    values, _ = make(spark, 60, seed=5)
    corpus = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(values)], "id string, embedding array<double>")
    corpus = corpus.withColumn("id", F.col("id").cast(ids)).withColumn("embedding", F.col("embedding").cast(vectors)).repartition(3)
    asked = corpus.where("cast(id as int) < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    dist = far(values[:5], values)
    key = (lambda i: str(i)) if ids == "string" else (lambda i: i)
    expected = {key(q): brute(dist[q], [key(i) for i in range(60)], 4) for q in range(5)}
    exact = vs.vector_search(corpus, asked, 4, None)
    assert dict(exact.dtypes)["id"] == dict(corpus.dtypes)["id"] and found(exact) == expected
    cells = vs.build_ivf(corpus, 3, work_dir(spark, "t-types"))
    assert found(vs.ivf_search(spark, cells, asked, 3, 4, None)) == expected
    bands = vs.build_lsh(corpus, work_dir(spark, "t-types"), 8, bands=8, bits=1)
    assert {q: [i for i, _ in rows] for q, rows in found(vs.lsh_search(spark, bands, asked, 4, None)).items()} == {q: [i for i, _ in rows] for q, rows in expected.items()}
    near = vs.knn_within(corpus.withColumn("g", F.lit(1)), corpus.withColumn("g", F.lit(1)), "g", 2)
    assert {(r.scored_id, r.id) for r in near.where("rn = 1").collect()} == {
        (key(i), min((d, key(j)) for j, d in enumerate(far(values, values)[i]) if j != i)[1]) for i in range(60)
    }


def test_many_queries_take_one_scan(spark, tables):
    corpus, _, _, _ = tables
    path = work_dir(spark, "t-scan")
    tables[1].write.parquet(path)
    many, many_df = make(spark, 5000, seed=6, schema="query_id long, vector array<float>")
    result = vs.vector_search(spark.read.parquet(path), many_df, 3, None)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = found(result)
    dist = far(many, corpus)
    assert len(rows) == 5000 and all(rows[q] == brute(dist[q], range(200), 3) for q in range(0, 5000, 97))


def recall(got, exact, k=10):
    want = [(q, i) for q, rows in exact.items() for i, _ in rows[:k]]
    return sum(i in {j for j, _ in got.get(q, [])} for q, i in want) / len(want)


def test_recall_of_the_approximate_searches(spark):
    folder = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = corpus.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = found(vs.vector_search(corpus, asked, 10, 0.9))
    cells = vs.build_ivf(corpus, 16, work_dir(spark, "t-recall"))
    assert recall(found(vs.ivf_search(spark, cells, asked, 12, 10, 0.9)), exact) >= 0.9
    for bits in (None, 11, 13):  # 11 bits belong to 131,000 rows, 13 to half a million
        # these vectors have no clusters: the tenth neighbours lie at 0.7 to 0.8
        bands = vs.build_lsh(corpus, work_dir(spark, "t-recall"), 64, bits=bits, reach=0.8)
        assert bands.bands == 4 and bands.bits == (bits or 3)
        assert recall(found(vs.lsh_search(spark, bands, asked, 10, 0.9)), exact) >= 0.9
    pinned = vs.build_lsh(corpus, work_dir(spark, "t-recall"), 64, LSH.bands, LSH.bits, LSH.seed, LSH.probes)
    assert recall(found(vs.lsh_search(spark, pinned, asked, 10, 0.9)), exact) >= 0.9


def test_probed_cells_prune_folders(spark, tables):
    _, corpus_df, _, asked_df = tables
    index = vs.build_ivf(corpus_df, 6, work_dir(spark, "t-cells"))
    plan = vs.ivf_search(spark, index, asked_df.limit(1), 1, 3, None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert "CartesianProduct" not in plan


def test_bands_return_exact_distances(spark, tables):
    corpus, corpus_df, asked, asked_df = tables
    index = vs.build_lsh(corpus_df, work_dir(spark, "t-bands"), 8, bands=12, bits=3)
    result = vs.lsh_search(spark, index, asked_df, 9, None)
    assert "WindowGroupLimit" in result._jdf.queryExecution().toString()
    got = found(result)
    assert all(len({i for i, _ in rows}) == len(rows) for rows in got.values())  # a row met in several bands counts once
    dist = far(asked, corpus)
    assert got
    for q, rows in got.items():
        assert all(abs(dist[q][i] - d) < 2e-9 for i, d in rows)
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))


def test_equal_distances_keep_the_smaller_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [i for i, _ in found(vs.vector_search(corpus, asked, 4, None))[0]] == [0, 1, 2, 3]


def test_zero_and_missing_vectors_are_never_near(spark):
    corpus = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [1.0, 1.0])], SCHEMA)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [i for i, _ in found(vs.vector_search(corpus, asked, 4, None))[0]] == [2]
    row = corpus.where("id = 0").select(cosine_distance(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("d")).first()
    assert row.d is None


def test_dimension_mismatch_fails(spark):
    corpus = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], SCHEMA)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<float>")
    with pytest.raises(Exception, match="dimension"):
        vs.vector_search(corpus, asked, 4, None).collect()


def test_no_queries(spark, tables):
    _, corpus_df, _, asked_df = tables
    assert vs.vector_search(corpus_df, asked_df.where("query_id < 0"), 4, None).count() == 0


def test_column_distance_matches_kernel(spark, tables):
    corpus, corpus_df, _, _ = tables
    other = F.array(*[F.lit(float(x)) for x in corpus[0]])
    rows = corpus_df.select("id", rounded(cosine_distance(F.col("embedding"), other), 9).alias("d")).collect()
    dist = far(corpus[:1], corpus)[0]
    assert all(abs(r.d - dist[r.id]) < 2e-9 for r in rows)


@pytest.mark.parametrize("block_rows", [4096, 16])
@pytest.mark.parametrize("as_of", [None, "date"])
def test_neighbours_within_a_crowded_key(spark, block_rows, as_of):
    """One client holds most rows; small blocks force the split of both sides."""
    values, _ = make(spark, 120, seed=9)
    client = [7 if i % 5 else i % 3 for i in range(120)]
    rows = [(i, client[i], values[i].tolist(), f"2024-01-{1 + i % 28:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, client long, embedding array<float>, day string").withColumn(
        "date", F.col("day").cast("timestamp_ntz")
    )
    near = vs.knn_within(df, df, "client", 5, as_of, block_rows)
    got = {}
    for r in near.orderBy("scored_id", "rn").collect():
        got.setdefault(r.scored_id, []).append((r.id, r.distance))
    dist = far(values, values)
    for i in range(120):
        others = [j for j in range(120) if j != i and client[j] == client[i] and (as_of is None or rows[j][3] < rows[i][3])]
        assert got.get(i, []) == brute([dist[i][j] for j in others], others, 5)


def test_only_scored_keys_are_compared(spark):
    values, df = make(spark, 30)
    history = df.withColumn("client", F.col("id") % 3)
    near = vs.knn_within(history.where("id = 4"), history, "client", 50)
    rows = near.collect()
    assert {r.scored_id for r in rows} == {4}
    assert {r.id for r in rows} == {i for i in range(30) if i % 3 == 1 and i != 4}


def test_probes_find_neighbours_at_the_stated_distance(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((200, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((200, 16))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.5 * base + 0.75**0.5 * other  # at cosine distance 0.5
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "query_id long, vector array<float>")
    for bits in (8, 12):
        index = vs.build_lsh(corpus, work_dir(spark, "t-grow"), 16, bits=bits)
        assert index.probes < 1 << bits
        got = found(vs.lsh_search(spark, index, asked, 200, None))
        assert sum(i in {j for j, _ in got.get(i, [])} for i in range(200)) >= 0.85 * 200


def test_probes_follow_the_cost():
    costs = np.random.default_rng(2).random(9)
    every = sorted(range(1 << 9), key=lambda m: sum(costs[j] for j in range(9) if m >> j & 1))
    assert vs.probe_order(costs, 512) == every and vs.probe_order(costs, 20) == every[:20]
    sums = vs._subsets(costs)
    assert all(abs(sums[m] - sum(costs[j] for j in range(9) if m >> j & 1)) < 1e-12 for m in range(512))


def test_storage_stays_below_twice_the_vectors(spark, tmp_path):
    _, corpus = make(spark, 5000, dim=64)
    corpus.write.parquet(f"{tmp_path}/plain")
    for bits in (4, 14):
        vs.build_lsh(corpus, f"{tmp_path}/bands{bits}", 64, bits=bits, probes=1)
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet"))
    assert max(size("bands4"), size("bands14")) < 2 * size("plain")


def test_candidates_in_a_grid(spark, tables):
    """Many queries meet their candidates in packs; the result is that of one pack."""
    _, corpus_df, _, _ = tables
    _, many = make(spark, 60, seed=6, schema="query_id long, vector array<float>")
    index = vs.build_lsh(corpus_df, work_dir(spark, "t-grid"), 8, bits=4, probes=3)
    assert found(vs.lsh_search(spark, index, many, 5, 0.8, pack_rows=7)) == found(vs.lsh_search(spark, index, many, 5, 0.8))


def test_grid_has_more_tasks_than_packs(spark, tables):
    many = spark.range(20_000).select(F.col("id").alias("query_id"), F.array(*[F.rand(i).cast("float") for i in range(8)]).alias("vector"))
    result = vs.vector_search(tables[1], many, 3, None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and "BroadcastExchange" not in plan
    assert "REPARTITION_BY_ID" in plan.upper() or "40" in plan  # 20 packs by two slabs
    assert result.where("rn = 1").count() == 20_000


def test_later_blocks_are_not_sent(spark):
    rows = spark.range(3000).select("id", F.lit(7).alias("client"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("date"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    blocks = vs._time_blocks(rows, "client", "date", 100)
    pairs = vs.block_pairs(blocks, blocks)
    n = blocks.count()
    assert n >= 30 and pairs.count() <= n * (n + 1) / 2
    first, last = {}, {}
    for r in blocks.select("no", "first", "last").collect():
        first[r["no"]], last[r["no"]] = r["first"], r["last"]
    assert all(first[r["history_no"]] < last[r["scored_no"]] for r in pairs.collect())


def test_codes(spark):
    folder = "/root/testdata/sf0.01"
    corpus = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = corpus.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = found(vs.vector_search(corpus, asked, 10, 0.9))
    index = vs.build_codes(corpus, 16, work_dir(spark, "t-codes"))
    assert index.row_bytes == (16, 256)
    near = found(vs.codes_search(spark, index, asked, 12, 10, 0.9))
    assert recall(near, exact) >= 0.9 and recall(found(vs.codes_search(spark, index, asked, 2, 10, 0.9)), exact) < recall(near, exact)
    assert found(vs.codes_search(spark, index, asked, 12, 10, 0.9, pack_rows=9)) == near  # in the grid
    assert found(vs.codes_search(spark, index, asked, 16, 10, 0.9, short_list=100)) == exact  # all rows are looked at
    dist = {(q, i): d for q, rows in exact.items() for i, d in rows}
    assert all(dist.get((q, i), d) == d for q, rows in near.items() for i, d in rows)
    with pytest.raises(ValueError, match="no vectors"):
        vs.build_codes(corpus.limit(0), 4, work_dir(spark, "t-codes"))


@pytest.mark.parametrize("pack_rows", [1024, 3])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_that_come_in_several_batches(spark, tables, kind, pack_rows):
    """A task's later batches meet what its earlier ones found."""
    _, corpus_df, _, asked_df = tables
    rows = corpus_df.select(F.col("id").cast(kind).alias("id"), "embedding")
    whole = found(vs.vector_search(rows, asked_df, 9, None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        assert found(vs.vector_search(rows.coalesce(1), asked_df, 9, None, pack_rows)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_keys_that_are_not_busy_are_not_written(spark, monkeypatch):
    """Two keys of 30 and 200 rows: only the busy one is cut into blocks of time."""
    kept, plain = [], vs.written
    monkeypatch.setattr(vs, "written", lambda df, label: kept.append((label, plain(df, label))) or kept[-1][1])
    rows = [(i, "a" if i % 23 < 3 else "b", i // 2, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, client string, date int, embedding array<float>")
    found = {}
    for r in vs.knn_within(df, df, "client", 4, "date", 100).collect():
        found.setdefault(r["scored_id"], []).append((r["rn"], r["id"], r["distance"]))
    blocks = [table.select("key").distinct().collect() for label, table in kept if label == "time-blocks"]
    assert blocks and all([r["key"] for r in keys] == ["b"] for keys in blocks)
    assert {label: table.count() for label, table in kept}["key-sizes"] == 4
    for i, client, date, vector in rows:
        other = [(j, np.round(1 - np.dot(vector, v) / (np.linalg.norm(vector) * np.linalg.norm(v)), 9) + 0.0) for j, c, d, v in rows if c == client and d < date]
        best = sorted((far, j) for j, far in other)[:4]
        assert [(j, far) for _, j, far in sorted(found.get(i, []))] == [(j, pytest.approx(far, abs=1e-9)) for far, j in best]
