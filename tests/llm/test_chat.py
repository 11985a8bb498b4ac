"""Chat formatting: what is read back is what went in."""

import random

from pyspark.sql import functions as F

from finsearch.llm import chat, queries

CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE ", "<</ROLE>>", "<<ROLE x>>"]


def conversations(spark):
    rng = random.Random(8)
    parts = [*CONTROL, "\\", "\\\\", " ", "a", "é😀", "\n", "<", "[", "$1", "INST]"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "a role<s> %\\", None])
            text = rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, role, text))
    rows += [(500, 3, "user", "tie b"), (500, 3, "user", "tie a"), (500, None, "user", "first"), (None, 1, "user", "nobody"), (501, 1, "user", "twice"), (501, 1, "user", "twice")]
    rows += [(502, t, "assistant" if t % 2 else "user", "x" * 1500 + f" {t} </s>") for t in range(40)]
    rows += [(503, t, "assistant", "one after the other") for t in range(300)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))


def turns(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(own)] for conv, own in held.items()}


def test_round_trip_and_mask(spark):
    rows, source = conversations(spark)
    done = chat.masked_text(chat.read_back(chat.formatted(source.repartition(5)))).collect()
    expected = turns(rows)
    assert len(done) == len(expected)
    for r in done:
        own = expected[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own, (own, r["formatted"])
        assert r["loss_text"] == "".join(text for role, text in own if role == "assistant")
        assert sum(run["n_chars"] for run in r["loss_runs"]) == len(r["formatted"])
        at, masked = 0, []
        for run in r["loss_runs"]:
            if run["loss"]:
                masked.append(r["formatted"][at : at + run["n_chars"]])
            at += run["n_chars"]
        assert len(masked) == sum(role == "assistant" for role, _ in own)


def test_neighbouring_turns_share_a_closing_mark(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert done["formatted"] == "<<SYS>> s <</SYS>> [INST] a [INST] b [/INST] <s> c </s>"


def test_long_backslashes_stay_linear(spark):
    text = "\\" * 100_000 + "</s>" + "\\" * 50_000
    rows = [(1, 0, "assistant", text)]
    done = chat.masked_text(chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first()
    assert done["turns"][0]["text"] == text and done["loss_text"] == text


def test_empty_table(spark):
    _, source = conversations(spark)
    assert chat.masked_text(chat.read_back(chat.formatted(source.limit(0)))).count() == 0


def test_query_has_the_planted_conversation(spark):
    rows = queries.QUERIES["op7_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in rows] == [(2, 21)]


def test_many_turns_end_in_seconds(spark):
    import time

    rows = spark.range(60_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('say [INST] ', id) AS text")
    start = time.time()
    back = chat.masked_text(chat.read_back(chat.formatted(rows))).selectExpr("size(turns) AS n", "loss_text").first()
    assert time.time() - start < 60
    assert back["n"] == 60_000 and back["loss_text"] == "".join(f"say [INST] {i}" for i in range(1, 60_000, 2))
