"""The pipeline, stage by stage, against plain versions of the stages; registration of the queries."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_pii import plain_spans, plain_terms
from test_quality import lines_of, normal, plain_boilerplate, plain_rules
from test_simhash import plain_components, plain_simhash
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from finsearch.llm import bpe, chat, extraction, langid, packing, quality, queries, simhash, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows)], the documents first."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("removed", F.col("doc_id") * 2)
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0, 1), (90_002, "1234 5678 " * 30, "en", "src0", 300, 1), (None, "no id for this text " * 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    out, columns = [("documents", docs.collect())], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(base / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        out.append((name, docs.collect()))
    return out


def rows_of(stages, name):
    at = [n for n, _ in stages].index(name)
    return stages[at - 1][1], stages[at][1]


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "information_theoretic_pii", "best_fit_packing"]


def test_quality(stages):
    before, after = rows_of(stages, "quality_rules")
    common = plain_boilerplate([(r["source"] or "", r["text"] or "") for r in before], quality.LINE_SHARE, quality.LINE_TEXTS)
    expected = Counter()
    for r in before:
        text, host = r["text"] or "", r["source"] or ""
        lines = lines_of(text)
        left = [x for x in lines if (host, normal(x)) not in common]
        if not plain_rules(text)[5] and sum(map(len, left)) >= 0.3 * sum(map(len, lines)):
            clean = "\n".join(x for x in text.split("\n") if x not in lines or (host, normal(x)) not in common)
            expected[r["doc_id"], clean, len(clean), r["removed"]] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"], r["removed"]) for r in after) == expected
    assert 0.8 * len(before) < len(after) < len(before)


def test_language(stages):
    before, after = rows_of(stages, "language_id")
    letters = [r for r in before if re.search(r"[^\W\d_]", r["text"])]
    assert Counter(after) == Counter(letters)  # every text with letters has a known language here
    assert any(r["doc_id"] == 90_002 for r in before) is False or not any(r["doc_id"] == 90_002 for r in after)


def test_near_copies(stages):
    before, after = rows_of(stages, "simhash_near_dedup")
    prints = [plain_simhash(r["text"]) for r in before]
    root = plain_components(prints, 4)
    least = {}
    for r, p in zip(before, prints):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[root[p]] = min(key, least.get(root[p], key))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted(least.values())
    assert Counter(after) <= Counter(before)


def test_personal_data(stages):
    before, after = rows_of(stages, "information_theoretic_pii")
    terms = plain_terms({i: r["text"] for i, r in enumerate(before)})
    expected = Counter()
    for i, r in enumerate(before):
        marks = [(a, b, f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[no]}]") for a, no, b, _ in plain_spans(r["text"])]
        apart = [(a, b, "[TERM]") for a, b in terms[i] if not any(s < b and a < e for s, e, _ in marks)]
        at, out = 0, ""
        for a, b, mark in sorted(marks + apart):
            if a >= at:
                out, at = out + r["text"][at:a] + mark, b
        expected[r["doc_id"], (out + r["text"][at:]).replace("[TERM]", "")] += 1
    assert Counter((r["doc_id"], r["text"].replace("[TERM]", "")) for r in after) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_packing(stages):
    before, after = rows_of(stages, "best_fit_packing")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in sorted(after, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        ids.setdefault(r["doc_id"], []).extend(int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4))
    assert ids == {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 2] for r in before}


def test_run_gives_the_same(spark, stages):
    plain = Counter((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert sum(plain.values()) > 100


def test_registered():
    names = entry_points.queries()
    found = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert found == list(range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_task_functions_travel_with_their_code(tmp_path):
    parts = (simhash.simhash, warc.parsed, langid.grams, extraction.main_texts, packing.fit_runs, bpe.Encoder, chat.escaped)
    (tmp_path / "functions.pickle").write_bytes(cloudpickle.dumps(parts))
    code = f"import pickle; f = pickle.load(open({str(tmp_path / 'functions.pickle')!r}, 'rb')); print(f[0](b'a b c d e', 4), len(f[4]({{5: 3}}, 16)))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.split() == [str(simhash.simhash(b"a b c d e", 4)), "1"], out.stderr


def test_languages_of_many_signs_stay(spark):
    """Few of their n-grams are frequent enough to be learned, so a bound that suits an alphabet would reject all of them."""
    rng = random.Random(4)
    signs, weights = [chr(0x4E00 + i) for i in range(4000)], [1 / (i + 20) for i in range(4000)]
    spelt = lambda n: "".join(rng.choices(signs, weights, k=n))
    rows = [(i, " ".join(spelt(rng.randint(4, 12)) for _ in range(60)), "many") for i in range(300)]
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(stems) for _ in range(80)), "few") for i in range(300)]
    rows += [(2000, "12 34 !", None), (2001, None, None), (2002, "ж" * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = queries.language_filter(docs)
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    names, scores = model.predict([r[1] for r in held])
    assert any(n == "many" and s < corpus_pipeline.MIN_SCORE for n, s in zip(names, scores))
    kept = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    stay = {r["doc_id"] for r in kept.collect()}
    for lang in ("many", "few"):
        own = [r[0] for r in held if r[2] == lang]
        assert len(own) > 30 and len([i for i in own if i in stay]) >= 0.95 * len(own)
    assert not stay & {2000, 2001, 2002}
