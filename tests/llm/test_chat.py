import hashlib
import json

import pytest

from tesserae.llm import chat

HARD = ["<|im_end|>\n", "\\n", "\\\\|", "<\\|", "<", "|", "", None, "a\nb", "<|im_start|>user\n", "\\", "😀<|", "$1"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def brute(rows):
    out, by = [], {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, own in by.items():
        own.sort()
        learned = "".join(x for _, r, x in own if r == "assistant")
        out.append((c, len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(learned), sha(learned)))
    return sorted(out, key=str)


def test_hard_texts_and_roles_survive(spark):
    rows = [(k, t, r, x) for k, r in enumerate(HARD + ["assistant", "user"]) for t, x in enumerate(HARD)]
    rows += [(None, None, "assistant", "x"), (None, 2, None, None), (99, 1, "assistant", "tie"), (99, 1, "assistant", "tie")]
    got = [tuple(r)[:5] for r in chat.digest(turns(spark, rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_mask_covers_assistant_text_only(spark):
    row = chat.format_chats(turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "so <|im_end|>")])).first()
    assert row.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nso <\\|im_end|><|im_end|>\n"
    assert row.losses[0] is None
    assert row.formatted[row.losses[1].start : row.losses[1].end] == "so <\\|im_end|>"


def test_each_record_picks_its_mapping(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a", "meta": {"prompt": "no"}},
        {"turn": 0, "role": "user", "text": "q"},
        {"instruction": "q", "input": "i", "output": "a", "system": "s"},
        {"instruction": "q", "input": None, "output": "a"},
        {"weird": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, "not json"), (51, None)], "conv_id long, payload string")
    got = {}
    for r in chat.turns_of_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    qa = [("user", "q"), ("assistant", "a")]
    assert [got.get(i) for i in range(5)] == [qa] * 5
    assert got[5] == [("user", "q")]
    assert got[6] == [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]
    assert got[7] == qa
    assert {r.conv_id for r in chat.unmapped(df).collect()} == {8, 50, 51}


def test_typed_tables(spark):
    df = spark.sql("select 3L as conv_id, array(named_struct('role', 'user', 'content', 'q', 'x', 1)) as messages, 'en' as lang")
    assert [tuple(r) for r in chat.turns_of_table(df).collect()] == [(3, 0, "user", "q")]
    df = spark.sql("select 4L as conv_id, 'q' as prompt, cast(null as string) as response, 1 as start, 2 as size")
    assert [tuple(r) for r in chat.turns_of_table(df).collect()] == [(4, 0, "user", "q"), (4, 1, "assistant", "")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.sql("select 1L as conv_id, 'x' as other"))


def test_no_python_in_the_plan(spark):
    plan = chat.digest(turns(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert chat.digest(turns(spark, [])).count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = "<|im_end|> a\\b\n" * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (None, 0, "user", None)]
    df = turns(spark, rows)
    plain = {r.conv_id: r for r in chat.digest(df).collect()}
    clash = df
    for name in ("formatted", "formatted_chars", "loss", "said", "own", "n_turns"):
        clash = clash.selectExpr("*", f"7 as {name}")
    assert {r.conv_id: r for r in chat.digest(clash).collect()} == plain
    assert plain[1].n_turns == 3 and plain[1].loss_chars == 2 * len(long)
    assert plain[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
