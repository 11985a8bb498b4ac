"""Language filters: exact containment, held-out accuracy, defined results."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from finsearch.llm import langid, queries


def plain_grams(text):
    """N-grams of lower-case words with a space on either side; none spans two words."""
    letters = "".join(c if c.isalpha() else " " for c in text)
    found = []
    for word in letters.split():
        padded = f" {''.join(c.lower() if len(c.lower()) == 1 else c for c in word)} "
        for size in langid.SIZES:
            found += [padded[i : i + size] for i in range(len(padded) - size + 1)]
    return found


def test_grams_of_a_batch_equal_those_of_each_text():
    rng = random.Random(0)
    texts = ["", "a", "Ab c", " x ", "é-ü 1 ß", "İstanbul DŽ", "wordwordword", "a\n\nb"] + ["".join(rng.choice("ab é.\n1Z") for _ in range(50)) for _ in range(40)]
    hashes, owner = langid.grams(texts)
    named = {}
    for i, text in enumerate(texts):
        own = sorted(hashes[owner == i].tolist())
        expected = plain_grams(text)
        assert len(own) == len(expected), text
        for gram in set(expected):
            value = langid.grams([""])[0]  # an empty text has none
            assert len(value) == 0
        named[i] = own
    alone = [sorted(langid.grams([t])[0].tolist()) for t in texts]
    assert alone == [named[i] for i in range(len(texts))]
    everything = {g for t in texts for g in plain_grams(t)}
    assert len(set(hashes.tolist())) == len(everything)


def labelled(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ver", "ich"], "cc": ["que", "ñi", "ción"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (None, "ka lo mi kalo", None), (1003, "kalomi", "aa"), (1003, "kalomi", "aa")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine")).withColumn("n", F.lit(1))


def test_filter_contains_what_was_learned(spark):
    rows, docs = labelled(spark)
    model = langid.learn(docs.repartition(5), min_share=0.002)
    by_lang = {lang: [r[1] for r in rows if r[2] == lang and r[1] is not None] for lang in ("aa", "bb", "cc")}
    assert set(model.languages) == set(by_lang)
    sizes = {lang: len(texts) for lang, texts in by_lang.items()}
    assert [sizes[x] for x in model.languages] == sorted(sizes.values(), reverse=True)
    for lang, texts in by_lang.items():
        counts = {}
        for text in texts:
            for gram in plain_grams(text):
                counts[gram] = counts.get(gram, 0) + 1
        common = [g for g, n in counts.items() if n >= max(2, np.ceil(0.002 * sum(map(len, texts))))]
        bit = model.languages.index(lang)
        words = [g.strip() for g in common if g.startswith(" ") and g.endswith(" ")]
        for word in words:
            hashes, _ = langid.grams([word])
            if {x for x in plain_grams(word)} <= set(common):
                masks = [model.masks[p, 0] for p in langid._slots(hashes, len(model.masks))]
                assert (masks[0] & masks[1] & masks[2] >> np.uint64(0) & np.uint64(1 << bit)).all()


def test_predictions(spark):
    rows, docs = labelled(spark)
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    asked = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([r["lang_pred"] == r["lang"] for r in asked]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0)
    assert by_id[None][0] == "aa"
    single = [model.predict([r["text"] or ""]) for r in found]
    assert [(r["lang_pred"], r["score"]) for r in found] == [(n[0], s[0]) for n, s in single]


def test_many_languages_take_several_words(spark):
    rng = random.Random(3)
    rows = []
    for lang in range(70):
        part = ["".join(chr(0x4E00 + 40 * lang + rng.randrange(40)) for _ in range(2)) for _ in range(8)]
        rows += [(f"l{lang:02}", " ".join(rng.choice(part) for _ in range(12))) for _ in range(8)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert model.masks.shape[1] == 2 and len(model.languages) == 70
    names, _ = model.predict([t for _, t in rows])
    assert names == [lang for lang, _ in rows]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, "text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = langid.learn(none)
    assert [tuple(r) for r in langid.predict(none.select("doc_id", "text"), model).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    assert langid.predict(none.limit(0), model).count() == 0


def test_query_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.QUERIES["op8_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99
