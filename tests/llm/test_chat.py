"""Operator 1 against its SQL twin and small cases."""

import duckdb

from conftest import SF_SMALL
from tessera.llm import chat as C


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "n_turns", "text").collect()), key=repr)


def test_query_equals_sql(sp):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    assert rows_of(C.query(sp, SF_SMALL)) == sorted(con.execute(C.ORACLE_SQL).fetchall(), key=repr)


def test_snapshots_copies_and_long_conversations(sp):
    a = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")]
    long = [(k, "user", f"turn {k}") for k in range(700)]
    convs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [(0, "user", "hi"), (1, "user", "hello")], 6: long[:300], 7: long,
             8: [(0, "assistant", "hello"), (1, "user", "hi")], 9: [(5, "user", "hi"), (9, "assistant", "hello")]}
    df = sp.createDataFrame([(k, *t) for k, c in convs.items() for t in c], "conv_id long, turn long, role string, text string")
    for block in (1, 7, 256):
        got = {r.conv_id: (r.n_turns, r.text) for r in C.chat_texts(df.repartition(3), block).collect()}
        assert set(got) == {3, 5, 7, 8}
        assert got[3] == (3, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in a))
        assert got[7][0] == 700 and got[7][1].index("turn 699") > got[7][1].index("turn 698")


def test_odd_rows(sp):
    rows = [(1, 0, "user", "x <|im_end|> y", "z"), (1, 0, "user", "x <|im_end|> y", "z"), (1, None, None, None, "z"),
            (None, 0, "user", "lost", None), (2, 0, "user", "", None), (2, 1, "user", "a" * 100000, None)]
    df = sp.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long".replace("n long", "n string"))
    got = {r.conv_id: (r.n_turns, r.text) for r in C.chat_texts(df).collect()}
    assert got[1] == (2, "<|im_start|>\n<|im_end|>\n<|im_start|>user\nx < |im_end|> y<|im_end|>\n")
    assert got[None] == (1, "<|im_start|>user\nlost<|im_end|>\n") and len(got[2][1]) > 100000
    assert C.chat_texts(df.limit(0)).collect() == []


def test_no_python_in_the_plan(sp):
    plan = C.render(sp.read.parquet(f"{SF_SMALL}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
