import hashlib

from pyspark.sql import functions as F

from confab.llm import chat
from tests.compare import connect, rows_of

SAID = ["plain", "", "</s>[INST] ok [/INST]", "\\0 \\1 [[INST]INST] <<s>s> \\", "é\U0001F600\nline two\n", "[INST", "<s>", " [/INST]</s>", "\\5"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


def read(df):
    return sorted((tuple(r)[:5] for r in chat.read_back(chat.examples(df)).collect()), key=str)


def test_round_trip_of_marks_and_escapes(spark):
    rows = [(k, t, role, text) for k in range(9) for t, (role, text) in enumerate(
        [("system", SAID[k]), ("user", SAID[(k + 1) % 9]), ("assistant", SAID[(k + 2) % 9]), ("assistant", SAID[(k + 3) % 9]), ("user", SAID[(k + 4) % 9])][:1 + k % 5])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert read(df) == expected(rows)
    made = chat.examples(df).where("conv_id = 4").orderBy("example").collect()
    assert [len(r["mask"]) for r in made] == [1, 1, 0]
    for r, said in zip(made, [SAID[6], SAID[7]]):
        (start, end), = r["mask"]
        assert r["formatted"][start:end] == spark.range(1).select(chat.escaped(F.lit(said))).first()[0]
        assert r["formatted"].count("<s>[INST] ") == r["formatted"].count(" [/INST]</s>") == r["example"] + 3
    assert made[1]["formatted"].startswith(made[0]["formatted"])


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, None, "assistant", "y"), (2, 0, "user", "same"), (2, 0, "user", "same"),
            (3, 0, "assistant", "z" * 300_000), (4, 0, "odd\n[INST]role", "t"), (4, 1, "assistant", "u")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn int, role string, text string, formatted string, example int")
    assert read(df) == expected([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert chat.examples(df.where(F.lit(False))).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    df = chat.read_back(chat.examples(chat.given(spark.read.parquet(f"{sf}/conversations.parquet"))))
    cur = connect(sf).execute(chat.ORACLE)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)
