"""Folded and rendered logs against a plain replay, and texts that hold control strings."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F

from statloom.llm import chat
from statloom.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
PIECES = ["<", ">", "/", "s", "\\", "[", "]", "INST", "<s>", "</s>", "[INST]", "[/INST] ", "<<SYS>>", "<</SYS>>", "SYS", "|", "role", "<|role|>", "<|text|>", "<|end|>", "é", "\U0001f600", "\n", " "]
LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def escaped(text):
    return re.sub(chat.ESCAPED, lambda m: m[1] + "\\" + m[2] + m[3], text)


def replay(events):
    """Messages of each conversation, event by event."""
    rank = {"message": 1, "edit": 2, "regenerate": 3, "delta": 0}
    low = -(10**30)
    ordered = sorted(events, key=lambda e: (low if e[1] is None else e[1], -rank.get(e[2], 1), e[5] or ""))
    held, out = {}, {}
    for i, (conv, seq, kind, message, role, text) in enumerate(ordered):
        key = (conv, message) if message is not None else (conv, "single", i)
        m = held.setdefault(key, {"conv": conv, "place": seq, "id": message, "role": None, "text": "", "again": None})
        m["role"] = role if m["role"] is None else m["role"]
        text = "" if kind == "regenerate" else text or ""
        m["text"] = m["text"] + text if kind == "delta" else text
        if kind == "regenerate" and message is not None:
            m["again"] = seq
    for m in held.values():
        out.setdefault(m["conv"], []).append(m)
    for conv, all_ in out.items():
        all_.sort(key=lambda m: (low if m["place"] is None else m["place"], m["id"] is not None, m["id"] or 0, m["role"] is not None, m["role"] or "", escaped(m["text"])))
        kept, reach = [], low
        for m in all_:
            if m["place"] is None or not reach > m["place"]:
                kept.append((m["role"] or "", m["text"]))
            reach = max(reach, low if m["again"] is None else m["again"])
        out[conv] = kept
    return out


def told(spark, rows, schema=LOG):
    formatted = chat.format_chats(spark.createDataFrame(rows, schema))
    read = formatted.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r["conv_id"]: r for r in read.collect()}


def drawn(seed, span):
    draw = random.Random(seed)
    rows, seqs = [], {}
    for _ in range(600):
        conv = draw.choice([1, 1, 1, 2, 3, None])
        seqs[conv] = seqs.get(conv, 0) + draw.randint(1, span)
        message = draw.choice([None, *range(12)])
        kind = draw.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delta", None, "other"])
        role = draw.choice(["user", "assistant", "system", "tool", None])
        rows.append((conv, seqs[conv], kind, message, role, draw.choice([None, "", *("".join(draw.choices(PIECES, k=4)) for _ in range(6))])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [1, 40, 3000])
def test_logs_match_a_replay(spark, span):
    rows = drawn(span, span)
    found, expected = told(spark, rows), replay(rows)
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        assert [tuple(t) for t in found[conv]["turns"]] == turns
        assert found[conv]["learned"] == [t for r, t in turns if r == "assistant"]


def test_events_do_what_they_say(spark):
    rows = [
        (1, 1, "message", 1, "user", "ask"),
        (1, 2, "message", 2, "assistant", None),
        (1, 3, "delta", 2, None, "wro"),
        (1, 4, "message", 3, "user", "what?"),
        (1, 5, "regenerate", 2, None, "ignored"),
        (1, 6, "delta", 2, None, "right "),
        (1, 7, "delta", 2, None, "answer"),
        (1, 8, "edit", 1, None, "asked"),
        (1, 9, "message", 4, "user", "thanks"),
    ]
    found = told(spark, rows)[1]
    assert found["formatted"] == "[INST] asked [/INST]<s>right answer</s>[INST] thanks [/INST]"
    assert [found["formatted"][s["start"] : s["end"]] for s in found["loss"]] == ["right answer"]


def test_odd_logs(spark):
    assert told(spark, []) == {}
    wide = spark.createDataFrame([(1, None, "message", None, None, None, 7, 8), (1, None, "message", None, None, None, 7, 8)], LOG + ", conv long, shelf long")
    row = chat.format_chats(wide).first()
    assert row["formatted"] == "<|role|><|text|><|end|>" * 2 and row["loss"] == []
    long = "".join(random.Random(1).choices(PIECES, k=60_000))
    found = told(spark, [(1, i, "message", None, "assistant" if i % 2 else "user", long[i * 10 :]) for i in range(6)])[1]
    assert found["learned"] == [long[i * 10 :] for i in (1, 3, 5)]
    with_ties = [(1, 5, "message", None, "user", "same")] * 3
    assert len(told(spark, with_ties)[1]["turns"]) == 3


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_any_text_comes_back(spark, data):
    texts = ["".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=12))) for _ in range(20)]
    draw = random.Random(len("".join(texts)))
    texts += ["".join(draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(3000)]
    rows = [(i, 2 * i + j, "message", None, r, t) for i, t in enumerate(texts) for j, r in enumerate([t, "assistant"])]
    found = told(spark, rows)
    for i, t in enumerate(texts):
        assert [tuple(x) for x in found[i]["turns"]] == [(t, t), ("assistant", t)] or t in chat.MARKS
        assert "".join(found[i]["learned"]) == t


def test_streamed_rows_come_back(spark):
    rows = [(1, 1, "user", "a" * 1000), (1, 1, "user", "a" * 1000), (1, None, "system", None), (None, 2**62, "tool", "x"), (1, -(2**63), "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.format_chats(chat.streamed(df, chunk=7)).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert found[None] == [("tool", "x")]
    assert sorted(found[1][:2]) == [("assistant", ""), ("system", "")] and found[1][2:] == [("user", "a" * 1000)] * 2


def test_no_python_runs(spark):
    plan = Q.op12_chat_format(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_query_op12(spark):
    found = Q.op12_chat_format(spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(Q.ORACLES["op12_chat_format"]).df()) is None
