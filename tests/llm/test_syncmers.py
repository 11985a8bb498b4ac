"""Fingerprints: the edit of every text, likeness, anchors that do not depend on their place."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from finsearch.llm import queries, syncmers


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def prints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r["p"] for r in frame.select("id", syncmers.fingerprint(F.coalesce("text", F.lit(""))).alias("p")).orderBy("id").collect()]


def anchor_sets(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    units = F.regexp_extract_all("text", F.lit(syncmers.UNIT), F.lit(0))
    return [r["a"] for r in frame.select("id", syncmers.anchors(units).alias("a")).orderBy("id").collect()]


def test_anchors_stand_wherever_a_passage_moves(spark):
    passage, other, third = sentences(1, 300), sentences(2, 50), sentences(3, 80)
    alone, moved = anchor_sets(spark, [passage, f"{other} {passage} {third}"])
    at = moved.index(alone[0])
    assert moved[at : at + len(alone)] == alone  # in the same order, nothing in between
    units = len([m for w in passage.split() for m in range(0, len(w), 3)])
    assert 0.35 < len(alone) / units < 0.65  # closed syncmers: 2 of every K - S + 1


def test_fingerprints(spark):
    long = sentences(5, 20_000)
    texts = ["", None, "   ", "one", "one two", "equal text " * 9, "equal text " * 9, "x" * 100_000, long, long + " more", " ".join(long.split()[10_000:])]
    got = prints(spark, texts)
    assert got[0] == got[1] == got[2] == []
    assert len(got[3]) == len(got[4]) == 1 and got[3] != got[4]
    assert got[5] == got[6]
    assert all(p == sorted(p) and len(p) <= 128 and len({a >> 25 for a in p}) == len(p) for p in got)
    frame = spark.createDataFrame([(got[8], got[9], got[10])], "a array<int>, b array<int>, c array<int>")
    near, half, none, same = frame.select(
        syncmers.likeness(F.col("a"), F.col("b")), syncmers.likeness(F.col("a"), F.col("c")),
        syncmers.likeness(F.col("a"), F.array().cast("array<int>")), syncmers.likeness(F.array().cast("array<int>"), F.array().cast("array<int>")),
    ).first()
    assert near > 0.98 and 0.5 < half < 0.85 and none == 0 and same == 1


def plain_edits(rows):
    """(id, text) -> edited text, in descending order of the ids, none last."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for place, (i, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        half = len(text) // 2
        out[i, text] = text[: len(text) - half] + after[:half]
    return out


def test_edits(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 401, "".join(rng.choice("aé😀 \n") for _ in range(rng.choice((0, 1, 2, 3, 50, 500))))) for i in range(300)]
    rows += [(5000, None), (None, "no id at all"), (5001, "repeated"), (5001, "repeated"), (6000, sentences(9, 4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("mine")).withColumn("hash", F.lit(1)).repartition(6)
    got = syncmers.edited_and_next(docs).collect()
    edits = plain_edits(rows)
    expected = sorted((-1 if i is None else i, len(t or ""), hashlib.sha256(edits[i, t or ""].encode()).hexdigest()) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert syncmers.edited_and_next(docs.limit(0)).count() == 0
    alone = syncmers.edited_and_next(docs.where("doc_id = 6000")).first()
    assert alone["near_next"] == 1.0 and alone["next_doc_id"] == 6000


@pytest.fixture(scope="module")
def result(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    return docs, {r["doc_id"]: r for r in queries.QUERIES["op2_syncmer_fingerprints"](spark, folder).collect()}


def test_query_edits(result):
    docs, rows = result
    edits = plain_edits(docs.items())
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r["n_chars"] == len(docs[i]) and r["edited_sha256"] == hashlib.sha256(edits[i, docs[i]].encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_query_likeness(result):
    docs, rows = result
    order = sorted(docs, reverse=True)
    of_text = {}
    for i, r in rows.items():
        assert of_text.setdefault(docs[i], r["fingerprint"]) == r["fingerprint"]
    for i, j in zip(order, order[1:]):
        if docs[i] == docs[j]:
            assert rows[i]["near_next"] == 1.0
    usual = sorted(r["near_edited"] for i, r in rows.items() if len(docs[i]) > 200)
    assert 0.45 < usual[len(usual) // 2] < 0.56  # half of the text is still there
    assert sum(0.3 < x < 0.75 for x in usual) > 0.97 * len(usual)


def test_one_character_more_in_an_unspaced_text(spark):
    rng = random.Random(4)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000)) + "\U0001f600" * 3 + "".join(chr(rng.randrange(0x20000, 0x20FFF)) for _ in range(500))
    texts = [han, han[:10] + "x" + han[10:], han[1:], han[:2000] + han[2002:], "".join(rng.choice("acgt") for _ in range(5000))]
    texts.append("".join(rng.choice("acgt") for _ in range(7)) + texts[4])
    frame = spark.createDataFrame([(i, t, texts[0 if i < 4 else 4]) for i, t in enumerate(texts)], "id long, text string, first string")
    alike = syncmers.likeness(syncmers.fingerprint(F.col("text")), syncmers.fingerprint(F.col("first")))
    assert all(r["x"] > 0.95 for r in frame.select(alike.alias("x")).collect())


def test_all_anchors_with_their_positions(spark):
    passage, other = "".join(w + "\n " for w in sentences(1, 200).split()), sentences(2, 50) + " \U0001f600 \t"
    texts = [passage, other + passage, "", None, " a b c ", "\u00e9" * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r["id"]: r for r in syncmers.anchored(frame).withColumn("print", syncmers.fingerprint(F.coalesce("text", F.lit("")))).collect()}
    assert rows[2]["anchors"] == rows[3]["anchors"] == []
    assert [(a["start"], a["end"]) for a in rows[4]["anchors"]] == [(1, 6)]
    moved = {(a["start"] - len(other), a["anchor"]) for a in rows[1]["anchors"]}
    assert rows[0]["anchors"] and {(a["start"], a["anchor"]) for a in rows[0]["anchors"]} <= moved
    same = {}
    for i in (0, 1, 5):
        for a in rows[i]["anchors"]:
            spelled = "".join(texts[i][a["start"] : a["end"]].split())
            assert len(spelled) == syncmers.K and same.setdefault(spelled, a["anchor"]) == a["anchor"]
        least = {}
        for a in rows[i]["anchors"]:
            least[a["anchor"] >> 25] = min(a["anchor"], least.get(a["anchor"] >> 25, a["anchor"]))
        assert rows[i]["print"] == sorted(least.values())
    hashed = spark.createDataFrame([("".join(passage.split()),)], "units string")
    runs = hashed.select(F.transform(F.sequence(F.lit(1), F.length("units") - syncmers.S + 1), lambda i: F.xxhash64(F.col("units").substr(i, F.lit(syncmers.S)))).alias("r"), syncmers.placed(F.col("units")).alias("p")).first()
    inner = syncmers.K - syncmers.S + 1
    r = runs["r"]
    assert [p["place"] for p in runs["p"]] == [i for i in range(len(r) - inner + 1) if min(r[i], r[i + inner - 1]) <= min(r[i + 1 : i + inner - 1])]


def test_prints_of_edited_texts_equal_their_own(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("aé😀 \n") for _ in range(rng.choice((0, 1, 2, 9, 15, 16, 29, 40, 300))))) for i in range(200)]
    rows += [(300, " " * 500 + "abc"), (301, "abc" * 20 + " " * 500), (302, " " * 90)]
    got = {r["doc_id"]: r["edited_fingerprint"] for r in syncmers.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edited = [(i, t) for (i, _), t in plain_edits(rows).items()]
    frame = spark.createDataFrame(edited, "id long, text string")
    assert got == {r["id"]: r["p"] for r in frame.select("id", syncmers.as_text(syncmers.fingerprint(F.col("text"))).alias("p")).collect()}
