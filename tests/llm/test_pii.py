"""Personal data against plain patterns in Python, and revealing terms against counts by hand."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from finsearch.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = "\\x20\\x09-\\x0D"


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), no, m.end(), m.group()) for m in re.finditer(pattern, text) if valid(kind, m.group())]
    return sorted(found)


def normal(no, value):
    kind = list(PLAIN)[no]
    return f"{kind}:" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))


CORE = r"[\p{L}\p{M}\p{N}]+(?:['\u2019\u2010\u2011-][\p{L}\p{M}\p{N}]+)*"
SIGN = r"[^\p{L}\p{M}\p{N}]"


def words(text):
    """(start, end, lower-case term) of tokens that are one run of letters, digits and marks with inner joints, a letter among them."""
    out = []
    for m in re.finditer(f"[^{SPACE}]+", text):
        core = regex.fullmatch(f"{SIGN}*({CORE}){SIGN}*", m.group())
        if core and len(core[1]) > 1 and regex.search(r"\p{L}", core[1]):
            out.append((m.start() + core.start(1), m.start() + core.end(1), core[1].lower()))
    return out


def plain_terms(docs, generalise=0.8, prior=1):
    """{doc: set of (start, end)} by the definition, over all documents."""
    has, holds, texts, pairs, kinds, by_kind = (defaultdict(set) for _ in range(6))
    found = {i: words(text) for i, text in docs.items()}
    entities = {i: {normal(no, value) for _, no, _, value in plain_spans(text)} for i, text in docs.items()}
    for i, text in docs.items():
        terms = {t for _, _, t in found[i]}
        for term in terms:
            has[term].add(i)
        for entity in entities[i]:
            kind = entity.split(":")[0]
            holds[entity].add(i)
            texts[entity].add(text)
            kinds[kind].add(text)
            for term in terms:
                pairs[entity, term].add(text)
                by_kind[kind, term].add(text)
    out, n = defaultdict(set), len(docs)
    for i in docs:
        for entity in entities[i]:
            own, kind = math.log2(n / len(holds[entity])), entity.split(":")[0]
            for a, b, term in found[i]:
                both, others = len(pairs[entity, term]), len(kinds[kind]) - len(texts[entity])
                usual = (len(by_kind[kind, term]) - both) / others if others else 0
                likely = (both + prior * usual) / (len(texts[entity]) + prior)
                if own > 0 and likely > 0 and round(math.log2(likely * n / len(has[term])) / own, 9) >= generalise:
                    out[i].add((a, b))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def digests(found):
    return {
        r["doc_id"]: (r["base"], r["spans"])
        for r in found.select("doc_id", pii.span_list(pii.base_spans()).alias("base"), pii.span_list(pii.all_spans()).alias("spans")).collect()
    }


def listed(spans):
    return ",".join(f"{pii.KINDS[no]}:{a}:{b}" for a, no, b, *_ in sorted(spans))


def hard_texts():
    rng = random.Random(5)
    parts = ["@", ".", "a", "b1", "-", "_", "%", "+", "é", " ", "\n", "x@y.z", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111",
             "5500-0000-0000-0004", "+1 (499) 555-6503", "+", "(", "12", "3", "9", "😀", "\x0b", "340000000000009", "co.uk"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_base_spans_equal_plain_patterns(spark):
    docs = dict(enumerate(hard_texts()))
    docs |= {10_000: "", 10_001: None, 10_002: "1" * 60_000, 10_003: "1 " * 60_000, 10_004: "a" * 60_000 + "@", 10_005: "a.b@c" + ".d" * 60_000}
    docs |= {10_006: "+" + "1(" * 40_000, 10_007: "\\" * 50_000 + " x@y.z " + "é" * 5000 + " 10.0.0.1"}
    got = digests(pii.found_in(frame(spark, list(docs.items()))))
    assert len(got) == len(docs)
    for i, text in docs.items():
        expected = listed(plain_spans(text or "")) if len(text or "") < 50_000 or i in (10_003, 10_005, 10_007) else ""
        assert got[i][0] == expected, (i, (text or "")[:200])


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    docs = {}
    for i in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if i % 30 == 0:  # the same person, always with the same rare words
            text[3:3] = ["Zorblax", "writes", "zed@mail.example.com", "the&&&", "quorn!"]
        elif i % 7 == 0:
            text[2:2] = ["the", "writes", f"+1 499 555 {6000 + i}"]
        docs[i] = " ".join(text)
    docs[900] = docs[901] = "only copies reveal copycat one@mail.example.com nothing"
    docs[902] = docs[900]
    got = digests(pii.found_in(frame(spark, list(docs.items()))))
    expected = plain_terms(docs)
    assert any(expected.values())
    for i, text in docs.items():
        spans = [(a, no, b) for a, no, b, _ in plain_spans(text)] + [(a, 4, b) for a, b in expected[i]]
        assert got[i][1] == listed(spans), text
    assert "term" in got[30][1]
    assert got[900][1] == got[901][1] == got[902][1]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, list(docs.items()))).collect()}
    assert len(clean) == len(docs)
    assert "zed@" not in clean[30] and "Zorblax" not in clean[30] and "[EMAIL]" in clean[30]
    assert all(clean[i] == docs[i] for i in docs if not plain_spans(docs[i]))


def test_defined_results(spark):
    rows = [(1, None), (None, "mail a@b.co now"), (2, ""), (3, "mail a@b.co now"), (3, "mail a@b.co now")]
    docs = frame(spark, rows).withColumn("entities", F.lit("mine")).withColumn("text_hash", F.lit(1)).withColumn("term", F.lit("x"))
    found = pii.found_in(docs)
    assert found.count() == 5
    assert found.where("doc_id is null and size(entities) = 1").count() == 1
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["entities"]) for r in clean.na.fill("null").collect()) == [
        (0, "mail [EMAIL] now", "mine"), (1, "null", "mine"), (2, "", "mine"), (3, "mail [EMAIL] now", "mine"), (3, "mail [EMAIL] now", "mine"),
    ]
    assert pii.found_in(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    terms = plain_terms(docs)
    marked, all_terms = sum(map(len, terms.values())), sum(len(words(docs[i])) for i in docs if plain_spans(docs[i]))
    assert 0 < marked < 0.5 * all_terms
    rows = queries.QUERIES["op10_information_theoretic_pii"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        apart = [(a, 4, b) for a, b in terms[r["doc_id"]] if not any(s < b and a < e for s, _, e, _ in base)]
        assert r["spans"] == listed([s[:3] for s in base] + apart)


def test_terms_of_the_whole_document(spark):
    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    names = ["O'Brien", "Anne-Marie", "kim1987", "Ze\u0301lie", "Zorblax"]
    docs = {}
    for i in range(300):
        text = [rng.choice(vocabulary) for _ in range(60)]
        if i % 30 == 0:  # before the entity and behind it, far beyond 64 code points; once beside it, in every second text only
            text = [*names, *text, " " * 10 + "zed@mail.example.com", *(["(Quorn!)"] if i % 60 else []), *text, *[n.upper() for n in names], "Quorn"]
        docs[i] = " ".join(text)
    docs[900] = "Zorblax in a text without the address stays"
    rows = {r["doc_id"]: r for r in pii.found_in(frame(spark, list(docs.items()))).collect()}
    for i in range(0, 300, 30):
        got = [docs[i][t["start"] : t["end"]] for t in rows[i]["terms"]]
        want = [*names, *(["Quorn"] if i % 60 else []), *[n.upper() for n in names], "Quorn"]
        assert [t for t in got if not t.startswith("w")] == want
    assert rows[900]["terms"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, list(docs.items()))).collect()}
    for i in range(0, 300, 30):
        assert not any(n.lower() in clean[i].lower() for n in [*names, "Quorn", "zed@"]), clean[i]
    assert clean[900] == docs[900]


def test_many_addresses_end_in_seconds(spark):
    import time

    text = " ".join(f"a{i}@b.co" for i in range(100_000))
    start = time.time()
    row = pii.found_in(frame(spark, [(1, text), (2, "none")])).selectExpr("doc_id", "size(entities) AS n").where("doc_id = 1").first()
    clean = pii.sanitised(frame(spark, [(1, text), (2, "none")])).where("doc_id = 1").first()["text"]
    assert row["n"] == 100_000 and clean == " ".join(["[EMAIL]"] * 100_000)
    assert time.time() - start < 90
