"""Quality rules against a plain version in Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from finsearch.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in re.split(f"[{SPACE}]+", text) if w]


def lines_of(text):
    return [line for line in text.split("\n") if line.strip(SPACE)]


def normal(line):
    return re.sub("[0-9]+", "0", line.strip(SPACE).lower())


def plain_rules(text):
    words, lines = words_of(text), lines_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def plain_boilerplate(rows, share, texts):
    """Lines above the limit, per host, from (host, text)."""
    of, docs = defaultdict(set), defaultdict(set)
    for host, text in rows:
        docs[host].add(text)
        for line in lines_of(text):
            of[host, normal(line)].add(text)
    return {k for k, v in of.items() if len(v) >= texts and len(v) >= share * len(docs[k[0]])}


def table(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "ga#mma", "d|lta", "é", "zeta,", "1999", "*", "eta"]

    def line(n):
        return rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", "\x0b"]).join(rng.choice(vocabulary) + rng.choice(["", str(rng.randrange(10**6))]) for _ in range(n)) + rng.choice(["", " "])

    rows = []
    for i in range(260):
        host = rng.choice(["a", "a", "a", "b", None])
        lines = [line(rng.randint(0, 30)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            lines.insert(0, f"  Menu of the SITE page {i} ")
        if rng.random() < 0.3:
            lines += ["copyright notice of this host that is long enough to count for most of the text in short documents, all rights reserved"] * rng.randint(1, 2)
        if rng.random() < 0.2:
            lines += [lines[0]] * 4
        rows.append((i, host, "\n".join(lines)))
    short = "menu of the site page 7\nCopyright notice of this host that is long enough to count for most of the text in short documents, all rights reserved"
    rows += [(1000, "a", None), (1001, "a", ""), (None, "a", rows[0][2]), (1002, None, rows[1][2]), (1003, "a", short), (1003, "a", short)]
    rows += [(2000 + i, "a", "exact copies of one clean text stay " + "with words " * 3 + "one two three four five six seven eight nine ten eleven") for i in range(200)]
    rows += [(3000, "b", "w " * 3000), (3001, "b", " ".join(f"x{i}" for i in range(3000)))]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_words", F.lit("mine")).withColumn("removed", F.lit(1)).withColumn("n_chars", F.lit(5))


def expected(rows):
    common = plain_boilerplate([(h or "", t or "") for _, h, t in rows], quality.LINE_SHARE, quality.LINE_TEXTS)
    assert common
    out = []
    for i, host, text in rows:
        lines = lines_of(text or "")
        left = sum(len(x) for x in lines if ((host or ""), normal(x)) not in common)
        rules = plain_rules(text or "")
        depleted = left < 0.3 * sum(map(len, lines))
        kept = not rules[5] and not depleted
        clean = "\n".join(x for x in (text or "").split("\n") if not x.strip(SPACE) or ((host or ""), normal(x)) not in common)
        out.append((-1 if i is None else i, *rules, kept, clean))
    return out


def test_rules_and_lines(spark):
    rows, docs = table(spark)
    got = quality.judged(docs.repartition(7)).select("doc_id", *quality.RULES, "kept").na.fill(-1).collect()
    want = expected(rows)
    assert any(w[-2] is False and w[6] is False for w in want), "some document is depleted"
    assert sorted(map(tuple, got)) == sorted(w[:-1] for w in want)


def test_cleaned(spark):
    rows, docs = table(spark)
    got = quality.cleaned(docs.repartition(7))
    assert got.columns == docs.columns
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_words"]) for r in got.collect())
    assert found == sorted((w[0], w[-1], "mine") for w in expected(rows) if w[-2])
    assert sum(i >= 2000 and i < 3000 for i, _, _ in found) == 200  # copies do not make their own lines boilerplate


def test_empty_table(spark):
    _, docs = table(spark)
    assert quality.judged(docs.limit(0)).count() == 0 and quality.cleaned(docs.limit(0)).count() == 0


def test_lines_of_a_very_large_host(spark):
    n, menu, passage = 12_000, quality.LINE_MOST, quality.LINE_MOST - 1  # both below 2 % of the texts
    rows = [(i, "hot" if i < n else f"s{i % 60}", f"text {chr(97 + i % 26)} x{'y' * (i % 7)} " + " ".join(f"w{chr(97 + i * k % 26)}{chr(97 + i // k % 26)}" for k in range(1, 25)) + f" {'z' * (i % 97)}v{'u' * (i % 89)}"
             + ("\nHome of the site" if i < menu else "") + ("\nseldom seen" if i < passage else "")) for i in range(3 * n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    line = docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("text_hash"), F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("lines"))
    hashes = spark.range(1).select(F.xxhash64(F.lit("Home of the site")), F.xxhash64(F.lit("seldom seen"))).first()
    found = {r["line"] for r in quality.boilerplate(line).where("host = 'hot'").collect()}
    assert hashes[0] in found and hashes[1] not in found
