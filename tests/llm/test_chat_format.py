from hashlib import sha256
from random import Random

from scanloom.llm import chat_format, queries


def digests(conv):
    turns = sorted(conv, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    r = Random(4)
    bits = ["\\", "</turn>\n", "</turn>", "### ", "### user: ", ": ", "<", "#", ":", "\\l", "\\b", "\n", "é", "\U0001f600", "a", "b", " ", "</tur", "n>", "$1", "\\E"]
    rows = []
    for c in range(40):
        for t in range(r.choice([1, 3, 200])):
            text = r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))])
            rows.append((c, r.choice([t, t, t // 2]), r.choice(["user", "assistant", "assistant", "system", None, "we: ird", "\\", "#<"]), text))
    rows += [(42, None, "assistant" if k % 3 else "user", f"one of very many {k} </turn>\n") for k in range(1500)]  # one block
    rows += [(43, 0, "assistant", "long \\ ### " * 20_000), (43, 1, "user", "x" * 200_000)]
    rows += [(None, 1, "user", "x"), (41, None, "assistant", "null turn"), (41, 0, "assistant", "y"), (41, 0, "assistant", "y")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {x.conv_id: tuple(x)[1:5] for x in chat_format.digest(chat_format.conversations(df)).collect()}
    want = {}
    for c, *turn in rows:
        want.setdefault(c, []).append(turn)
    assert got == {c: digests(x) for c, x in want.items()}


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat_format.digest(chat_format.conversations(df))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_whole_table(spark):
    got = {r.conv_id: r for r in queries.queries()["op8_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len("\\### Assistant: </turn> ok")
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    want = {}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c: digests(x) for c, x in want.items()} == {c: tuple(r)[1:5] for c, r in got.items() if c != -7}
