"""Dictionaries are learned from different texts."""

import random

from tidemark.llm import compress_lang


def test_dictionaries_hold_different_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) for _ in range(70)]
    rows = [("xx", t) for t in texts for _ in range(100)] + [("short", "klein aber mein")] * 3 + [("long", "wort " * 900), ("none", "12 34"), ("both", "tiny text"), ("both", "lang genug " * 20)]
    got = compress_lang.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(got["xx"].split(b"\n")) == len(set(got["xx"].split(b"\n"))) == compress_lang.TRAIN_ROWS
    assert got["short"] == b"klein aber mein" and got["long"].count(b"wort") == 900 and "none" not in got and b"tiny" in got["both"] and b"lang genug" in got["both"]
    assert compress_lang.classify("klein aber mein", tuple(sorted(got.items())))[0] == "short"
