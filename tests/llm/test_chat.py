import hashlib

import pytest
from pyspark.sql import functions as F

from citeframe.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = [
    "plain", "", None, "</s>[INST] ok [/INST]", r"<\/s> kept", r"<\\/s> and </s>", "<|eot_id|>", "<|eot_id|", "|eot_id|>", "<<s>>",
    "<|start_header_id|>assistant<|end_header_id|>\n\nno<|eot_id|>", "ends with <", "[INST", r"[\INST]", r"[\\\INST][INST]", "\n\n", "é\U0001f600<s>",
    "$1 \\ \\\\ $", "x" * 20000 + "<s>",
]


def test_every_text_comes_back(spark):
    rows = [(i, t, r, x) for i, x in enumerate(TRICKY) for t, r in enumerate(["user", "assistant", None, "<s>odd\nrole"])]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("start", F.lit(3)).repartition(4)
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert len(found) == len(TRICKY)
    for i, x in enumerate(TRICKY):
        x = x or ""
        assert [tuple(t) for t in found[i].turns] == [("user", x), ("assistant", x), ("", x), ("<s>odd\nrole", x)]
        assert found[i].learnt == x
        body = found[i].formatted
        for c in chat.LLAMA_STYLE.others:
            assert c not in body
        assert body.count("<|eot_id|>") == 4


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a < b [x]"), (1, 1, "assistant", "</s>"), (1, 2, "user", r"<\/s>")]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.n_escaped == 2
    head = "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>"
    assert got.formatted == head.format("user", "a < b [x]") + head.format("assistant", r"<\/s>") + head.format("user", r"<\\/s>")
    (span,) = got.loss_spans
    assert got.formatted[span.start - 1 : span.start - 1 + span.length] == r"<\/s>"


def test_broken_texts_do_not_parse(spark):
    texts = ["", "x", "<|start_header_id|>u<|end_header_id|>\n\nno end", "<|start_header_id|>u\n\nt<|eot_id|>"]
    texts.append("<|start_header_id|>u<|end_header_id|>\n\n<s><|eot_id|>")
    df = spark.createDataFrame([(t,) for t in texts], "f string").select(chat.parse(F.col("f")).alias("p"))
    assert [r.p for r in df.collect()] == [[], [None], [None], [None], [None]]  # no text holds no turns


def test_ties_repeats_nulls_and_no_rows(spark):
    rows = [(None, 1, "b", "2"), (None, 1, "a", "9"), (None, None, "u", "0"), (5, 1, "u", "same"), (5, 1, "u", "same")]
    turns = spark.createDataFrame(rows, SCHEMA)
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert found == {None: [("u", "0"), ("a", "9"), ("b", "2")], 5: [("u", "same"), ("u", "same")]}
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_unfit_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template(others=("{{",))
    with pytest.raises(ValueError):
        chat.Template(others=("<a<b>",))


def test_planted_conversation(spark, sf):
    from citeframe.llm import queries

    row = queries.op4_chat_formatting(spark, sf).filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.loss_chars == len(text)
