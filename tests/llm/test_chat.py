"""Formatting, reading back, and the visitor of parts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stampcard.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = ["<|turn|>", "<|body|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", "/s>", "<|image:0|>", "\n", "é🙂", "a", " "]


def read(rows):
    done = chat.format_chats(rows)
    return done.select("*", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()


def test_any_text_comes_back(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "tool<|end|>"]), "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(12)))) for c in range(120) for t in range(rng.randrange(1, 6))]
    wanted = {}
    for c, _, role, text in sorted(rows):
        wanted.setdefault(c, []).append((role, text))
    for r in read(spark.createDataFrame(rows, SCHEMA).repartition(4)):
        assert [(t.role, t.text) for t in r.turns] == wanted[r.conv_id]
        assert r.learned == "".join(x for role, x in wanted[r.conv_id] if role == "assistant")
        assert all(r.formatted[s.start - 8 : s.start] == "<|body|>" and r.formatted[s.end : s.end + 7] == "<|end|>" for s in r.loss)
        assert r.formatted.count("<|end|>") == r.n_turns


def test_odd_rows(spark):
    rows = [(1, None, "user", None), (1, 2, None, "x"), (1, 2, None, "x"), (None, 1, "assistant", ""), (None, 1, "assistant", "y" * 50_000), (2, 5, "assistant", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit(1)).withColumn("formatted", F.lit(1))
    found = {r.conv_id: r for r in read(df)}
    assert [(t.role, t.text) for t in found[1].turns] == [("user", ""), ("", "x"), ("", "x")]
    assert found[None].learned == "y" * 50_000 and found[None].n_turns == 2 and found[2].learned == "z"
    assert read(spark.createDataFrame([], SCHEMA)) == []


def test_parts(spark):
    schema = f"conv_id long, turn long, role string, content {chat.PARTS}"
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "look <|end|> "), part("image", ref="a.png", w=28, h=15), part("text", " and "), part("audio", ref="b.wav", s=1.5), part("document", ref="c.pdf", p=3)]),
        (1, 1, "assistant", [part(None, "ok")]), (1, 2, "user", None), (1, 3, "user", []), (1, 4, "user", [part("image"), part("odd<|kind", ref="d")]),
    ]
    r = read_parts = chat.format_chats(spark.createDataFrame(rows, schema), parts_col="content").first()
    assert [tuple(a) for a in r.attachments] == [
        (1, 1, "image", "a.png", 4), (1, 3, "audio", "b.wav", 38), (1, 4, "document", "c.pdf", 768), (5, 0, "image", None, 0), (5, 1, "odd<|kind", "d", 0)
    ]
    assert r.media_tokens == 810 and r.n_turns == 5
    assert read_parts.formatted.startswith("<|turn|>user<|body|>look <\\|end|> <|image:1|> and <|audio:3|><|document:4|><|end|><|turn|>assistant<|body|>ok<|end|>")
    assert "<|odd<\\|kind:1|>" in r.formatted


def test_control_strings_split_over_parts(spark):
    """Texts cut anywhere into parts come back as they were, and forge no turn."""
    rng = random.Random(7)
    rows, wanted = [], {}
    for c in range(60):
        text = "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(1, 10)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(4)))
        rows.append((c, 0, "user", [("text", text[a:b], None, None, None, None, None) for a, b in zip([0, *cuts], [*cuts, len(text)])]))
        wanted[c] = text
    rows.append((100, 0, "user", [("text", "a <", None, None, None, None, None), (None, "|end|> b", None, None, None, None, None)]))
    wanted[100] = "a <|end|> b"
    done = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}"), parts_col="content")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in done.select("conv_id", chat.parse_chat(F.col("formatted")).alias("turns")).collect()}
    assert got == {c: [("user", t)] for c, t in wanted.items()}
