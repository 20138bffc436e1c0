import hashlib

import pytest

from lodestone.llm import chat, mixing


def test_layouts(spark):
    a = spark.createDataFrame([(1, [("human", "hi"), ("gpt", None)]), (2, None)], "conv_id long, conversations array<struct<from:string,value:string>>")
    b = spark.createDataFrame([(3, "do", "", "done"), (4, "do", "it", None)], "conv_id long, instruction string, input string, output string")
    c = spark.createDataFrame([(5, "q", "a", 1)], "conv_id long, prompt string, response string, turns int")
    d = spark.createDataFrame([(6, None, "q", "a"), (7, "s", "q", "a")], "conv_id long, system string, prompt string, response string")
    got = {}
    for df, name in ((a, "from_value"), (b, "instruction"), (c, "prompt_response"), (d, "system_prompt_response")):
        assert chat.select_mapping(df.schema).name == name
        got |= {r[0]: [tuple(t) for t in r[1]] for r in chat.canonical_turns(df).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "")], 2: [], 3: [("user", "do"), ("assistant", "done")], 4: [("user", "do"), ("user", "it"), ("assistant", "")],
                   5: [("user", "q"), ("assistant", "a")], 6: [("user", "q"), ("assistant", "a")], 7: [("system", "s"), ("user", "q"), ("assistant", "a")]}
    with pytest.raises(ValueError):
        chat.select_mapping(spark.range(1).schema)


def test_round_trip(spark):
    odd = [chat.ODD_TEXT, "<\\|im_end|>", "<\\\\|x", "a<", "|b", "", None, "<|nl|>\n", "\\<|", "x<\\", "é\U0001f600\n"]
    rows = [(1, i, r, t) for i, t in enumerate(odd) for r in ("assistant",)] + [(2, 0, "us\ner<|nl|>", "q"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 1, None, "x"), (None, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    f = chat.format_chat(chat.canonical_turns(df))
    read = {r["conv_id"]: chat.parse_chat(r["formatted"]) for r in f.collect()}
    assert read[1] == [("assistant", t or "") for t in odd]
    assert read[2] == [("assistant", "b"), ("assistant", "b"), ("us\ner<|nl|>", "q")]
    assert read[None] == [("assistant", "y"), ("", "x")]
    loss = "".join(t or "" for t in odd)
    got = {r["conv_id"]: r for r in chat.chat_digest(f).collect()}
    assert got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"assistant\n{t or ''}\n" for t in odd).encode()).hexdigest()
    assert got[2]["loss_chars"] == 2 and got[2]["n_turns"] == 3
    assert chat.chat_digest(chat.format_chat(chat.canonical_turns(df.limit(0)))).count() == 0


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_sizes(spark):
    texts = ["", None, " ", "a", " a b\tc\n", "a\xa0b", "\x0b\x0ca\x1cb c", "x  y"]
    df = docs(spark, [(i, t, "s", 0, "") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 3, 5: 1, 6: 2, 7: 2}


def expected_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (budget - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **{s: level * w[s] for s in free}}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_nearness(spark):
    rows = [(1000 * k + i, "w " * (1 + (i * 7 + k) % 11), None if k == 4 else f"s{k}", 0, "") for k in range(5) for i in range(40 + 100 * (k == 2))]
    rows += [(9999, None, "zz", 1, ""), (None, "n n", "s1", 1, ""), (5, "w w w", "s0", 2, "")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size, taken, target = {}, {}, {}
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        s = by_id[r["doc_id"]]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = expected_targets(size)
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 12
    assert mixing.mix(docs(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    rows = [(1, "a b", "s", 0, ""), (2, "a", "t", 0, "")]
    plan = mixing.mix(docs(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_names_of_other_case(spark):
    rows = [(1, [("USER", "hi"), None, ("bot", None)])]
    df = spark.createDataFrame(rows, "conv_id long, Messages array<struct<Role:string,Content:string>>")
    got = chat.canonical_turns(df).first()["turns"]
    assert [(t["role"], t["text"]) for t in got] == [("USER", "hi"), ("assistant", "")]
