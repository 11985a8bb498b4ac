"""Text index, keyword scores, fusion and reranking on hand-made texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from finsearch.functions.stemming import stem
from finsearch.functions.text import STOPWORDS
from finsearch.operators import hybrid, text_search
from finsearch.operators.segments import SegmentedIndex
from finsearch.operators.summarize import summarize
from finsearch.operators.text_index import build_text_index, load_text_index, save_text_index
from finsearch.plans.search import SearchTables, analyze_hits, lakehouse_search, search
from finsearch.session import work_dir

TEXTS = [
    (1, "Bank risk and bank credit."),
    (2, "Credit of the bank: risk!"),
    (3, "Weather report"),
    (4, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


@pytest.fixture(scope="module")
def index(docs):
    return build_text_index(docs, buckets=4)


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_postings(index):
    rows = {(r.term, r.id): r for r in index.postings.collect()}
    assert ("and", 1) not in rows and ("", 4) not in rows
    assert rows[("bank", 1)].tf == 2 and rows[("bank", 1)].first_pos == 0
    assert rows[("credit", 1)].first_pos == 4 and rows[("credit", 1)].doc_len == 4
    stats = index.stats.first()
    assert stats.n_docs == 4 and stats.avg_len == (4 + 3 + 2 + 0) / 4


def test_positions_on_demand(docs):
    rows = {(r.term, r.id): r.positions for r in build_text_index(docs, positions=True).postings.collect()}
    assert rows[("bank", 1)] == [0, 3]


def test_all_terms_must_occur(spark, index):
    found = text_search.matches(index, asked(spark, "bank credit", "bank weather", "the of", "nowhere"))
    assert {(r.query_id, r.id) for r in found.collect()} == {("q0", 1), ("q0", 2)}


def test_bm25_by_hand(spark, index):
    row = text_search.matches(index, asked(spark, "weather")).first()
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert row.score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.25)), abs=1e-8)


def test_distance_score(spark, index):
    rows = {(r.query_id, r.id): r.score for r in text_search.matches(index, asked(spark, "bank credit", "bank"), "distance").collect()}
    assert rows[("q0", 1)] == pytest.approx(1 / 5)
    assert rows[("q0", 2)] == pytest.approx(1 / 4)
    assert rows[("q1", 1)] == 1.0


def test_saved_index_answers_alike(spark, index):
    path = work_dir(spark, "t-index")
    stored = save_text_index(index, path)
    reopened = load_text_index(spark, path, index.stopwords, index.stem, index.buckets)
    queries = asked(spark, "bank credit", "risk")
    want = sorted(map(tuple, text_search.matches(index, queries).collect()))
    assert sorted(map(tuple, text_search.matches(stored, queries).collect())) == want
    assert sorted(map(tuple, text_search.matches(reopened, queries).collect())) == want
    plan = text_search.matches(stored, queries)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_postings_stay_in_their_shards(spark, index):
    stored = save_text_index(index, work_dir(spark, "t-index"), 4)
    found = text_search.text_pool(stored, asked(spark, "bank credit", "risk"), 2)
    assert {(r.query_id, r.id) for r in found.collect()} == {("q0", 1), ("q0", 2), ("q1", 1), ("q1", 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    above, below = final.split("WindowGroupLimit", 1)
    postings = final[final.index("WindowGroupLimit") :]
    assert "Bucketed: true" in postings and "SelectedBucketsCount: 4 out of 4" in postings
    assert postings.count("Exchange hashpartitioning(query_id") <= 1  # the cut rows; postings are not exchanged
    assert "hashpartitioning(id" not in final


def test_stemmed_search_equals_plain_code(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    index = save_text_index(build_text_index(docs, stem=True, buckets=4), work_dir(spark, "t-stem"))
    queries = ["thing ation", "heating"]
    got = {(r.query_id, r.id) for r in text_search.matches(index, asked(spark, *queries)).collect()}
    terms = {i: {stem(w) for w in re.split(r"[^\w]+|_", t.lower()) if w and w not in STOPWORDS} for i, t in texts.items()}
    wanted = {f"q{n}": {stem(w) for w in q.split()} for n, q in enumerate(queries)}
    assert got == {(q, i) for q, need in wanted.items() for i, own in terms.items() if need <= own}


def test_many_terms_go_without_literals(spark, index, monkeypatch):
    queries = asked(spark, "bank credit", "risk")
    want = sorted(map(tuple, text_search.matches(index, queries).collect()))
    monkeypatch.setattr(text_search, "LITERAL_TERMS", 1)
    assert sorted(map(tuple, text_search.matches(index, queries).collect())) == want


@pytest.mark.parametrize(
    "word, base",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
        ("triplicate", "triplic"), ("hopeful", "hope"), ("allowance", "allow"), ("adoption", "adopt"),
        ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("sky", "sky"),
    ],
)
def test_stems(word, base):
    assert stem(word) == base


def test_stemmed_index(spark):
    docs = spark.createDataFrame([(1, "Falling prices"), (2, "No falls")], "id long, text string")
    index = build_text_index(docs, stem=True)
    found = text_search.matches(index, asked(spark, "fall price", "fallings"))
    assert {(r.query_id, r.id) for r in found.collect()} == {("q0", 1), ("q1", 1), ("q1", 2)}


def pools(spark):
    text = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0), ("q", 3, 1.0)], "query_id string, id long, score double")
    vector = spark.createDataFrame([("q", 3, 0.1), ("q", 4, 0.2)], "query_id string, id long, distance double")
    return text, vector


def test_ranks_share_ties(spark):
    text, _ = pools(spark)
    assert {r.id: r["rank"] for r in hybrid.ranked(text, F.desc("score")).collect()} == {1: 1, 2: 1, 3: 3}


def test_fusions(spark):
    rrf = {r.id: r for r in hybrid.fuse(*pools(spark)).collect()}
    assert rrf[3].score == pytest.approx(1 / 61 + 1 / 63, abs=1e-9) and rrf[3].retrieval_method == "VECTOR+FTS"
    assert rrf[1].score == rrf[2].score == pytest.approx(1 / 61, abs=1e-9) and rrf[1].retrieval_method == "FTS"
    assert rrf[4].retrieval_method == "VECTOR"
    added = {r.id: r.score for r in hybrid.fuse(*pools(spark), "sum").collect()}
    assert added[3] == pytest.approx(1.9) and added[4] == pytest.approx(0.8) and added[1] == 2.0


@pytest.fixture(scope="module")
def tables(spark, index):
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, None)], "id long, embedding array<float>"
    )
    payload = spark.createDataFrame(
        [(i, f"T{i}", "a-13F-1" if i == 1 else "a-10K-2", 0, t) for i, t in TEXTS],
        "id long, ticker string, accession_number string, chunk_index int, chunk_text string",
    )
    return SearchTables(index, corpus, payload)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q", "bank", [1.0, 0.0])], "query_id string, text string, vector array<float>")


def test_modes(tables, queries):
    def ids(**options):
        return {r.id: r for r in search(tables, queries, cutoff=0.5, **options).collect()}

    assert set(ids(mode="fulltext")) == {"1", "2"}
    vector = ids(mode="vector")
    assert set(vector) == {"1", "2"} and vector["1"].score == 1.0 and vector["1"].type == "Form 13F"
    both = ids(mode="hybrid", reranker="rrf")
    assert both["1"].retrieval_method == "VECTOR+FTS"
    assert set(ids(mode="hybrid")) == set(ids(mode="hybrid", reranker="rerank")) == {"1", "2"}
    by_length = ids(mode="hybrid", reranker=lambda text, texts: [float(len(t)) for t in texts])
    assert by_length["1"].score == float(len(TEXTS[0][1]))
    with pytest.raises(ValueError):
        search(tables, queries, mode="other")
    with pytest.raises(ValueError):
        search(tables, queries, mode="vector", vector_index="cells")


def test_analysis(tables, queries):
    rows = {r.id: r for r in analyze_hits(tables.index, tables.payload, queries).collect()}
    assert rows[1].explanation == "bank" and rows[1].summary == TEXTS[0][1]


def test_routing(spark, tables):
    asked = spark.createDataFrame([("a", "AAA", [1.0, 0.0]), ("b", "what now", [1.0, 0.0])], "query_id string, text string, vector array<float>")
    view = spark.createDataFrame(
        [("AAA", "Aaa Corp", "aaa", "2020-01-01", 1.1, 1.2, 1.3, "1"), ("BBB", "Bbb Corp", "bbb", "2020-01-01", 1.1, 1.2, 1.3, "2")],
        "Symbol string, Security_Name string, iceberg_company_name string, date string, f_1_day_return double, "
        "f_40_day_return double, f_100_day_return double, cik string",
    )
    concepts = spark.createDataFrame([(9, "Revenues", 5.0, 2024, "FY"), (9, "Revenues", 7.0, 2025, "FY")], "cik long, tag string, val double, fy long, fp string")
    tickers = spark.createDataFrame([(9, "T2")], "cik long, ticker string")
    filings, financials = lakehouse_search(asked, tables.corpus, tables.payload, view, concepts, tickers)
    assert [r.ticker for r in filings.collect()] == ["AAA"]
    rows = [(r.id, r.revenue) for r in financials.collect()]
    assert rows == [(2, 7.0), (2, 5.0), (1, None), (3, None)]  # fan-out, nulls last


def test_summary_keeps_order(spark):
    text = "Plain words here. Rare zebra appears! Plain words here? Unique quagga sleeps. Plain words here."
    docs = spark.createDataFrame([(1, text), (2, "Plain words here.")], "id long, text string")
    rows = {r.id: r.summary for r in summarize(docs, n_sentences=2).collect()}
    assert rows[1] == "Rare zebra appears! Unique quagga sleeps."
    assert rows[2] == "Plain words here."



def test_phrases_and_windows_by_hand(spark):
    rng = __import__("random").Random(4)
    letters = ["ab", "cd", "ef", "the", "gh"]
    texts = {i: " ".join(rng.choice(letters) for _ in range(rng.choice((1, 4, 30, 80)))) for i in range(80)}
    texts[100], texts[101] = "", "cd the ab, the the ef"
    docs = spark.createDataFrame(list(texts.items()) + [(102, None)], "id long, text string").repartition(3)
    index = save_text_index(build_text_index(docs, buckets=3, positions=True), work_dir(spark, "t-phrase"), shards=3)
    queries = {"q0": "ab cd", "q1": "ab the ef", "q2": "cd", "q3": "ab ab", "q4": "the", "q5": "nowhere ab", "q6": "ef ab cd ab"}
    frame = spark.createDataFrame(list(queries.items()), "query_id string, text string")
    kept = {i: [(p, w) for p, w in enumerate(t.split()) if w not in STOPWORDS] for i, t in ((i, t.replace(",", "")) for i, t in texts.items())}
    phrases, windows = {}, {}
    for q, text in queries.items():
        own = [(p, w) for p, w in enumerate(text.split()) if w not in STOPWORDS]
        terms = {w for _, w in own}
        for i, at in kept.items():
            places = set(at)
            starts = [s for s in range(-10, 100) if own and all((s + p, w) in places for p, w in own)]
            if starts:
                phrases[q, i] = (len(starts), min(starts))
            ends = [p - min(max((a for a, x in at if x == w and a <= p), default=-1000) for w in terms) for p, _ in at] if terms else []
            ends = [e for e in ends if e < 1000]
            if terms and ends and terms <= {w for _, w in at}:
                gap = (min(ends) + 1 - len(terms)) / max(len(terms) - 1, 1)
                windows[q, i] = (min(ends) + 1, round(1 / (1 + gap), 9))
    assert {(r.query_id, r.id): (r.occurrences, r.first_at) for r in text_search.phrase_matches(index, frame).collect()} == phrases
    assert {(r.query_id, r.id): (r.window, r.score) for r in text_search.window_matches(index, frame).collect()} == windows
    assert ("q1", 101) not in phrases and len(windows) > len(phrases) > 20


def test_phrases_need_positions(spark, index):
    with pytest.raises(ValueError, match="positions"):
        text_search.phrase_matches(index, asked(spark, "bank"))


def found_in(spark, index):
    queries = asked(spark, "bank", "bank credit", "risk", "weather", "new", "the of")
    hits = sorted(tuple(r) for r in text_search.matches(index, queries).collect())
    stats = index.stats.select("n_docs", F.round("avg_len", 9)).first()
    return hits, sorted(tuple(r) for r in index.vocabulary.select("term", "df", "occurrences").collect()), tuple(stats)


def test_segments_equal_a_fresh_build(spark):
    segments = SegmentedIndex.create(spark, work_dir(spark, "t-segments"), buckets=2)
    assert text_search.matches(segments.open(), asked(spark, "bank")).count() == 0
    with pytest.raises(FileExistsError):
        SegmentedIndex.create(spark, segments.path)
    state = {}

    def agrees():
        living = spark.createDataFrame(list(state.items()), "id long, text string")
        fresh = build_text_index(living, buckets=2)
        assert found_in(spark, segments.open()) == found_in(spark, fresh)
        assert sorted(r.id for r in segments.ids().collect()) == sorted(state)

    def append(rows):
        segments.append(spark.createDataFrame(rows, "id long, text string"))
        state.update(rows)

    append(TEXTS)
    append([(2, "New bank weather"), (5, "Risk, risk, bank")])  # one is replaced
    segments.delete(spark.createDataFrame([(1,), (1,), (4,), (77,)], "id long"))
    state.pop(1), state.pop(4)
    agrees()
    append([(1, "credit again"), (6, None)])  # one that was deleted comes back
    version = segments._version()
    segments.delete(spark.createDataFrame([(77,)], "id long"))
    assert segments._version() == version  # nothing to delete, nothing written
    with pytest.raises(RuntimeError):
        segments._commit(version - 1, segments._rows(version))  # another writer was faster
    plan = text_search.matches(segments.open(), asked(spark, "bank"))._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") >= 2 and "CartesianProduct" not in plan
    assert segments.merge(most=2) and not segments.merge(most=2)
    agrees()
    assert segments.merge(most=1)
    agrees()
    _, _, left, tombstones = segments._state()
    assert len(left) == 1 and not tombstones


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("stem", [False, True])
def test_postings_lie_by_id(docs, stem):
    """Texts are dealt by id, and postings once more if they are stemmed; nothing is dealt by term."""
    built = build_text_index(docs, stem=stem, positions=True)
    plan = plan_of(built.postings).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 + stem and "Exchange hashpartitioning(term" not in plan


def test_stems_are_remembered_over_batches(spark, monkeypatch):
    """Each word is stemmed once per task, however many batches hold it, and again once the memory is full."""
    from finsearch.functions import stemming

    again = spark.sparkContext.accumulator(0)
    plain = stemming.stem

    def counted(word):
        again.add(1)
        return plain(word)

    monkeypatch.setattr(stemming, "stem", counted)
    rows = spark.range(0, 500, 1, 1).select(F.element_at(F.array(*map(F.lit, ["cats", "relational", None])), (F.col("id") % 3 + 1).cast("int")).alias("term"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        for memo, calls in ((10, 2), (1, 60)):
            monkeypatch.setattr(stemming, "MEMO_WORDS", memo)
            before = again.value
            got = [r.stem for r in rows.select(stemming.stem_words(F.col("term")).alias("stem")).collect()]
            assert got == [["cat", "relat", None][i % 3] for i in range(500)]
            assert (again.value - before == calls) if memo == 10 else (again.value - before >= calls)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frequent_terms_meet_candidates_only(spark):
    """Documents without the rarest term of a query never meet the query."""
    docs = spark.createDataFrame([(i, "common often" + (" seldom" if i < 2 else "")) for i in range(50)], "id long, text string")
    index = build_text_index(docs, buckets=4)
    terms = text_search.asked_terms(index, asked(spark, "common often seldom", "common nowhere"))
    met = text_search._met(index, terms, ["tf"], terms.weighted, terms.bound)
    assert sorted((r.query_id, r.id, r.term) for r in met[0].collect()) == sorted(("q0", i, t) for i in (0, 1) for t in ("common", "often", "seldom"))
    assert {(r.query_id, r.id) for r in text_search.matches(index, asked(spark, "common often seldom", "common nowhere", "often")).collect()} == {
        ("q0", 0), ("q0", 1), *[("q2", i) for i in range(50)]
    }


def test_null_ids_and_repeated_queries(spark):
    """Documents without an id are one document; queries of one id and as many terms share what they find."""
    docs = spark.createDataFrame([(None, "bank risk"), (None, "credit"), (1, "bank risk credit"), (2, "weather bank")], "id long, text string")
    index = build_text_index(docs, buckets=4, positions=True)
    queries = spark.createDataFrame([("a", "bank credit"), (None, "bank risk"), ("b", "bank risk"), ("b", "weather snow")], "query_id string, text string")
    found = {(r.query_id, r.id) for r in text_search.matches(index, queries).collect()}
    assert found == {("a", None), ("a", 1), (None, None), (None, 1), ("b", None), ("b", 1), ("b", 2)}
    assert {(r.query_id, r.id) for r in text_search.phrase_matches(index, queries.where("query_id = 'a' OR query_id IS NULL")).collect()} <= found


def test_summaries_move_texts_and_different_words_only(spark):
    """Texts are joined with no table by word: neither their words nor their sentences are shuffled or sorted."""
    docs = spark.createDataFrame([(i, f"Alpha beta {i}. Gamma gamma alpha. Delta!") for i in range(40)], "id long, text string")
    plan = summarize(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan and "sentence_no" not in plan
    assert summarize(docs, n_sentences=1).count() == 40
