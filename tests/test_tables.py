"""Loading, writing, refreshing, auditing and preparing tables."""

from datetime import datetime
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from finsearch import schemas
from finsearch.functions.text import html_to_text, preview, route_query
from finsearch.operators import prepare
from finsearch.operators.embedding import embed, fit_embedder, load_embedder
from finsearch.operators.summarize import summarize
from finsearch.session import work_dir
from finsearch.sources import audit, sinks, snapshots
from finsearch.sources import tables as sources

NOW = datetime(2024, 2, 1)


def lines(spark, rows, label):
    path = work_dir(spark, label)
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return path


def test_csv_types(spark):
    head = ",".join(schemas.USERS.names)
    path = lines(spark, [head, '1,30,65,1990,5,F,"1 ""Main"" St, X",1.5,-2.25,"$59,696","$1,000.50",-$7,700,3'], "csv")
    row = sources.load_table(spark, "users", path, "csv").first()
    assert row.yearly_income == Decimal("1000.50") and row.per_capita_income == Decimal("59696.00")
    assert row.total_debt == Decimal("-7.00") and row.address == '1 "Main" St, X'
    assert row.latitude == Decimal("1.5")


def test_csv_vectors(spark):
    head = ",".join(schemas.TRANSACTIONS.names)
    path = lines(spark, [head, '5,2024-01-01 10:00:00,1,2,9.99,chip,3,City,ST,1,5411,,text,"[0.5,1.0]",m'], "csv")
    row = sources.load_table(spark, "transactions_25_26", path, "csv").first()
    assert row.embedding == [0.5, 1.0] and row.date == datetime(2024, 1, 1, 10) and row.errors is None


def test_malformed_csv_fails(spark):
    path = lines(spark, ["transaction_id,is_fraud", "x,true"], "csv")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.load_table(spark, "fraud_labels", path, "csv").collect()
    with pytest.raises(ValueError):
        sources.load_table(spark, "fraud_labels", path, "xml")


def test_views_join_across_sources(spark):
    base = work_dir(spark, "views")
    spark.createDataFrame([(1, "AAA", "A Corp")], schemas.COMPANY_TICKERS).write.parquet(f"{base}/tickers")
    csv = lines(spark, ["ticker,security_name,iceberg_company", "AAA,A Corp,a"], "csv")
    sources.register_sources(spark, {"company_tickers": (f"{base}/tickers", "parquet"), "sec_to_iceberg_mapping": (csv, "csv")})
    row = spark.sql("SELECT cik, iceberg_company FROM company_tickers JOIN sec_to_iceberg_mapping USING (ticker)").first()
    assert tuple(row) == (1, "a")


def test_added_columns_read_as_null(spark):
    base = work_dir(spark, "evolve")
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{base}/one")
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(f"{base}/two")
    rows = sources.load_evolving(spark, [f"{base}/one", f"{base}/two"]).collect()
    assert {(r.a, r.b) for r in rows} == {(1, None), (2, "x")}


def test_period_of_report(spark):
    row = spark.sql("SELECT 20240331 AS p").select(sources.period_of_report("p").alias("d")).first()
    assert str(row.d) == "2024-03-31"


def test_clustered_table_prunes_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("cik"), F.when(F.col("id") < 900, 2024).otherwise(2025).alias("fy"))
    table = sinks.build_clustered(df, work_dir(spark, "clustered"), ["cik"], ["fy"])
    hit = table.where("fy = 2025")
    plan = hit._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fy" in plan
    assert hit.count() == 100 and table.count() == 1000
    crowded = table.where("fy = 2024").inputFiles()
    assert len(crowded) > 1  # the crowded year is spread over files


def test_hot_subset(spark):
    df = spark.createDataFrame([(1, 2025, "FY"), (2, 2024, "FY"), (3, 2025, "Q1")], "cik long, fy int, fp string")
    hot = sinks.hot_subset(df, (F.col("fy") == 2025) & (F.col("fp") == "FY"), "cik", work_dir(spark, "hot"))
    assert [r.cik for r in hot.collect()] == [1]


def trade(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, shares int, price double")


def test_trades_get_growing_ids(spark):
    path = work_dir(spark, "trades")
    sinks.append_trades(trade(spark, ("AAPL", 1, 10.004), ("MSFT", 2, 20.0)).repartition(2), path, NOW)
    stored = sinks.append_trades(trade(spark, ("AMZN", 3, 30.0)), path, NOW)
    rows = {r.ticker: r for r in stored.collect()}
    assert len({r.trade_id for r in rows.values()}) == 3
    assert rows["AMZN"].trade_id > max(rows["AAPL"].trade_id, rows["MSFT"].trade_id)
    assert rows["AAPL"].price == Decimal("10.00") and rows["AAPL"].executed_at == NOW


@pytest.mark.parametrize("bad", [("ELEVENCHARS", 1, 1.0), ("A", 1, 1e9)])
def test_trades_that_do_not_fit_fail(spark, bad):
    with pytest.raises(Exception, match="longer than 10|out of range|NUMERIC_VALUE_OUT_OF_RANGE"):
        sinks.append_trades(trade(spark, bad), work_dir(spark, "trades"), NOW)


def test_delete_keys(spark):
    left = sinks.delete_keys(spark.range(5), spark.createDataFrame([(1,), (3,)], "id long"), "id")
    assert sorted(r.id for r in left.collect()) == [0, 2, 4]


def test_snapshots(spark):
    base = work_dir(spark, "snap")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, base)
    first = snapshots.refresh_snapshot(spark.range(3), base, view="snap_t")
    snapshots.refresh_snapshot(spark.range(4), base, view="snap_t")
    assert spark.table("snap_t").count() == 4
    assert first.count() == 3  # readers of the old version go on
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v=3")
    assert snapshots.read_snapshot(spark, base).count() == 4  # an unfinished copy is not seen
    snapshots.refresh_snapshot(spark.range(5), base)
    assert snapshots.snapshot_versions(spark, base) == [2, 3]
    assert snapshots.read_snapshot(spark, base).count() == 5


def test_audits(spark):
    rows = {r.table_name: r for r in audit.audit_counts({"a": spark.range(3), "b": spark.range(2)}, {"a": 3, "b": 9}).collect()}
    assert rows["a"].ok and not rows["b"].ok and rows["b"].n_rows == 2
    df = spark.createDataFrame([(1, 2025), (1, 2024), (2, 2025), (None, 2025)], "k int, fy int")
    assert {(r.k, r.n_rows) for r in audit.audit_unique(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    assert {r.k for r in audit.audit_unique(df, ["k"], F.col("fy") == 2025).collect()} == {None}


def test_html(spark):
    html = (
        "<html><head><style>p{}</style><script>var a='<p>';</script></head><!-- x --><body><h1>A&amp;B</h1>"
        "<p>5&nbsp;&lt;&#32;6 &amp;lt; &#8217;&#x2019; &middot; &copy;</p>\n\n</body></html>"
    )
    row = spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h")).alias("t")).first()
    assert row.t == "A&B 5 < 6 &lt; ’’ · ©"


@pytest.mark.parametrize("length, n", [(0, 1), (1499, 1), (1500, 1), (1501, 2), (2700, 2), (2701, 3), (1500 + 1200 * 200 - 7, 201)])
def test_chunks(spark, length, n):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(length))
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    chunks = [r.chunk_text for r in prepare.chunk_text(docs).orderBy("chunk_index").collect()]
    assert len(chunks) == n
    assert chunks[0] + "".join(c[300:] for c in chunks[1:]) == text
    assert all(len(c) <= 1500 for c in chunks)


def test_dedup_keeps_the_smallest_id(spark):
    df = spark.createDataFrame([("a", 0, 5, "x"), ("a", 0, 2, "y"), ("b", 0, 1, "z")], "acc string, n int, id long, t string")
    rows = {(r.acc, r.id, r.t) for r in prepare.dedup_min_id(df, ["acc", "n"]).collect()}
    assert rows == {("a", 2, "y"), ("b", 1, "z")}


def test_ticker_coverage(spark):
    held = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "cusip string")
    known = spark.createDataFrame([("2", "T")], "cusip string, ticker string")
    filled = prepare.backfill_ticker(held, known)
    row = prepare.ticker_coverage(filled).first()
    assert (row.n_rows, row.n_with_ticker, row.coverage) == (4, 2, 0.5)


def test_facts(spark):
    text = '{"us-gaap":{"Assets":{"label":"A","units":{"USD":[{"val":1.5,"fy":2024,"fp":"FY"},{"val":2,"fy":2025,"fp":"Q1"}]}}},"dei":{}}'
    rows = prepare.flatten_facts(spark.createDataFrame([(7, text)], "cik long, facts string")).collect()
    assert [(r.cik, r.taxonomy, r.tag, r.unit, r.val, r.fy, r.fp) for r in rows] == [
        (7, "us-gaap", "Assets", "USD", 1.5, 2024, "FY"),
        (7, "us-gaap", "Assets", "USD", 2.0, 2025, "Q1"),
    ]


def test_core_concepts(spark):
    concepts = spark.createDataFrame([(1, "Assets"), (1, "Other"), (2, "Assets")], "cik long, tag string")
    tickers = spark.createDataFrame([(1, "A"), (2, "B")], "cik long, ticker string")
    stocks = spark.createDataFrame([("A",)], "Symbol string")
    assert [(r.cik, r.tag) for r in prepare.core_concepts(concepts, tickers, stocks).collect()] == [(1, "Assets")]


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "bank credit"), (2, "bank risk"), (3, "")], "id long, text string")
    rows = {r.id: r for r in embed(docs, dim=32).collect()}
    assert len(rows[1].embedding) == 32 and sum(x * x for x in rows[1].embedding) == pytest.approx(1, abs=1e-6)
    assert rows[1].embedding_model == "tfidf-hash-32" and sum(rows[3].embedding) == 0
    custom = embed(docs, model="len", encode=lambda texts: [[len(t), 1] for t in texts]).orderBy("id").collect()
    assert [r.embedding for r in custom] == [[11.0, 1.0], [9.0, 1.0], [0.0, 1.0]]


def test_text_expressions(spark):
    df = spark.createDataFrame([("AAPL", "x" * 61), ("what is", "short"), ("aapl", ""), ("ÀB", None)], "q string, t string")
    rows = df.select(route_query(F.col("q")).alias("r"), preview(F.col("t")).alias("p")).collect()
    assert [r.r for r in rows] == ["ticker", "semantic", "semantic", "ticker"]
    assert rows[0].p == "x" * 60 + "..." and rows[1].p == "short..." and rows[3].p is None


def test_work_dir_follows_the_session(spark):
    unset = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(cluster, "x")
    alone = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]"))
    assert work_dir(alone, "x") != work_dir(alone, "x")
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "/shared/"), sparkContext=cluster.sparkContext)
    assert work_dir(shared, "x").startswith("/shared/finsearch/x-")
    old = spark.conf.get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert path != work_dir(spark, "x")
    if old:
        assert path.startswith(old)


def test_crowded_cluster_key_is_spread(spark):
    df = spark.range(3000).select(F.lit(7).alias("cik"), F.col("id").alias("val"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the sample is tiny
    try:
        table = sinks.build_clustered(df, work_dir(spark, "crowded"), ["cik"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in table.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) > 1 and max(sizes) < 1500


@pytest.mark.parametrize(
    "html, text",
    [
        ("&eacute;&auml;&Uuml;&amp;eacute;&unknown; &apos;", "éäÜ&eacute;&unknown; '"),
        ("&#9999999;|&#x110000;|&#xD800;|&#0;|&#999999999999999999999999;|&#xFFFFFFFFFF;", "�|�|�|�|�|�"),
        ("&#0000000000233;&#x000000000e9;&#x1F600;&#X41;", "éé😀A"),
        ("&amp;lt; &amp;#65; & &; &#; &#x; a&b", "&lt; &#65; & &; &#; &#x; a&b"),
    ],
)
def test_character_references(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h")).alias("t")).first().t == text


def trade_rows(spark, n, ticker="AAPL"):
    return spark.range(n).select(F.lit(ticker).alias("ticker"), F.lit(1).alias("shares"), F.lit(2.5).alias("price")).repartition(3)


def test_appends_that_start_together_keep_all_rows(spark):
    path = work_dir(spark, "together")
    first, second = snapshots.claim_part(spark, path, "append"), snapshots.claim_part(spark, path, "append")
    assert first != second
    for part, n in ((second, 4), (first, 3)):
        sinks.numbered_trades(trade_rows(spark, n), part, NOW).write.parquet(f"{path}/append={part}")
    stored = sinks.append_trades(trade_rows(spark, 5), path, NOW)
    assert stored.count() == 12 == stored.select("trade_id").distinct().count()


def test_trade_ids_are_dense_in_an_append(spark):
    path = work_dir(spark, "dense")
    for n in (7, 0, 5):
        stored = sinks.append_trades(trade_rows(spark, n), path, NOW)
    ids = sorted(r.trade_id for r in stored.collect())
    assert ids == [*range(7), *range(2 << 32, (2 << 32) + 5)]


def test_unfinished_parts_are_not_read(spark):
    path = work_dir(spark, "unfinished")
    sinks.append_trades(trade_rows(spark, 2), path, NOW)
    trade_rows(spark, 9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/append=7")
    assert sinks.read_trades(spark, path).count() == 2
    assert sinks.append_trades(trade_rows(spark, 3), path, NOW).count() == 5
    assert sinks.read_trades(spark, f"{path}/none").count() == 0


def test_refreshes_that_start_together_do_not_share_a_folder(spark):
    base = work_dir(spark, "refreshes")
    first, second = snapshots.claim_part(spark, base, "v"), snapshots.claim_part(spark, base, "v")
    spark.range(2).write.parquet(f"{base}/v={second}")
    spark.range(3).write.parquet(f"{base}/v={first}")
    assert snapshots.read_snapshot(spark, base).count() == 2
    assert snapshots.refresh_snapshot(spark.range(4), base).count() == 4


def test_smallest_id_of_equal_rows(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")]
    df = spark.createDataFrame(rows, "k string, id long, v string")
    kept = prepare.dedup_min_id(df, ["k"])
    assert sorted((r.k or "", r.id, r.v) for r in kept.collect()) == [("", 4, "w"), ("a", 1, "y")]


def test_every_text_has_a_summary(spark):
    docs = spark.createDataFrame([(1, "That it. The of."), (2, "Banks lend money. It is. Money is lent by banks today."), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r.summary for r in summarize(docs, n_sentences=2).collect()}
    assert got == {1: "That it. The of.", 2: "Banks lend money. Money is lent by banks today."}


def test_a_text_has_one_vector_alone_and_in_the_corpus(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, ""), (4, None), (5, "unseen words")], "id long, text string")
    model = fit_embedder(docs.where("id < 5"), dim=64)
    path = work_dir(spark, "model")
    model.save(spark, path)
    again = load_embedder(spark, path)
    assert again == model
    together = {r.id: r.embedding for r in again.transform(docs).collect()}
    for r in docs.collect():
        alone = again.transform(docs.where(F.col("id") == r.id)).first().embedding
        assert alone == together[r.id] and len(alone) == 64
        norm = sum(x * x for x in alone)
        assert abs(norm - 1) < 1e-9 if r.text else norm == 0


def test_types_are_joined_in_the_lattice():
    from pyspark.sql import types as T

    w = lambda a, b: sources.wider(T.DataType.fromDDL(a), T.DataType.fromDDL(b)).simpleString()
    want = {
        ("int", "bigint"): "bigint", ("bigint", "date"): "date", ("date", "timestamp_ntz"): "timestamp_ntz", ("int", "double"): "double", ("decimal(10,2)", "int"): "decimal(38,2)",
        ("decimal(10,2)", "decimal(12,4)"): "decimal(38,4)", ("float", "int"): "double", ("string", "int"): "string", ("boolean", "int"): "string", ("date", "date"): "date", ("void", "int"): "int",
    }
    for (a, b), kind in want.items():
        assert w(a, b) == w(b, a) == kind, (a, b)


def test_conflicting_files_load(spark, tmp_path):
    a = spark.createDataFrame([(1, 20240229, "1.5"), (2, 20240231, "x"), (3, None, None)], "id int, period int, amount string")
    b = spark.createDataFrame([(2**40, "2024-03-01", "2.25", "more")], "ID long, day string, amount string, extra string").selectExpr("ID", "cast(day as date) period", "cast(amount as decimal(10,2)) amount", "extra")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    rows, rejected = sources.load_reconciled(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], {"amount": "decimal(18,2)"})
    assert rows.dtypes == [("id", "bigint"), ("period", "date"), ("amount", "decimal(18,2)"), ("extra", "string")]
    found = {r["id"]: (str(r["period"]), str(r["amount"]), r["extra"]) for r in rows.collect()}
    assert found == {1: ("2024-02-29", "1.50", None), 2: ("None", "None", None), 3: ("None", "None", None), 2**40: ("2024-03-01", "2.25", "more")}
    assert sorted((r["source"].rsplit("/", 1)[1], r["column"], r["value"]) for r in rejected.collect()) == [("a", "amount", "x"), ("a", "period", "20240231")]
    alone, none = sources.load_reconciled(spark, [f"{tmp_path}/b"])
    assert none.count() == 0 and alone.count() == 1


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_below(spark, path):
    return {r.path: r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()}


def test_refresh_by_difference_copies_changed_parts_only(spark):
    base, part = work_dir(spark, "delta"), F.floor(F.col("k") / 10)
    kinds = "k int, t string, a array<int>"
    first = [(k, f"t{k}", [k, None]) for k in range(35)] + [(None, "x", None), (7, "t7", [7, None])]
    with pytest.raises(FileNotFoundError):
        snapshots.read_delta(spark, base)
    assert rows_of(snapshots.refresh_delta(spark.createDataFrame(first, kinds), base, part, view="delta_t")) == sorted(first, key=repr)
    folders = lambda v: {r.part: r.folder for r in snapshots.read_manifest(spark, base, v).collect()}
    one = folders(1)
    assert set(one) == {"0", "1", "2", "3", None}
    files = files_below(spark, f"{base}/data/v=1")
    # a null moves inside an array, a repeated row goes, a part goes, a part comes
    second = [(k, t, [None, 15] if k == 15 else a) for k, t, a in first[:30]] + [(None, "x", None), (99, None, [])]
    current = snapshots.refresh_delta(spark.createDataFrame(second, kinds).repartition(3), base, part, view="delta_t")
    assert rows_of(current) == rows_of(spark.table("delta_t")) == sorted(second, key=repr)
    two = folders(2)
    assert set(two) == {"0", "1", "2", "9", None}
    assert {p for p in two if two[p] == one.get(p)} == {"2", None}
    assert files_below(spark, f"{base}/data/v=1") == files
    assert rows_of(snapshots.read_delta(spark, base, 1)) == sorted(first, key=repr)  # the old version stays whole
    # nothing changed: a new version without a new file
    assert rows_of(snapshots.refresh_delta(spark.createDataFrame(second, kinds), base, part)) == sorted(second, key=repr)
    assert folders(3) == two
    snapshots.expire_versions(spark, base, keep=1)
    assert snapshots.snapshot_versions(spark, base) == [3]
    assert rows_of(snapshots.read_delta(spark, base)) == sorted(second, key=repr)
    assert set(files_below(spark, f"{base}/data/v=1")) < set(files)
    # nulls in different columns, equal otherwise
    swapped = [(1, None, "a"), (2, "a", None)], [(1, "a", None), (2, None, "a")]
    sums = [rows_of(snapshots.part_hashes(spark.createDataFrame(rows, "k int, a string, b string"), F.lit(0))) for rows in swapped]
    assert sums[0] != sums[1]


def test_refresh_by_difference_with_other_columns_and_without_rows(spark):
    base, part = work_dir(spark, "delta"), F.col("id") % 2
    snapshots.refresh_delta(spark.range(4), base, part)
    wider = snapshots.refresh_delta(spark.range(4).withColumn("x", F.lit(None).cast("string")), base, part)
    assert rows_of(wider) == [(i, None) for i in range(4)]
    empty = snapshots.refresh_delta(spark.range(0), base, part)
    assert empty.columns == ["id"] and empty.count() == 0
    assert snapshots.refresh_delta(spark.range(3), base, part).count() == 3
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/v=9")
    assert snapshots.read_delta(spark, base).count() == 3  # a version without its marker is not seen
