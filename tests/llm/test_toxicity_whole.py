"""Every labelled row takes part in the toxicity model: its fit, its counts and its thresholds."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(2000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def marked(i, word, n=12):
    w = prose(n, i).split()
    w[i % n] = word
    return " ".join(w)


def test_rows_beyond_any_sample_are_learned_from(spark):
    """The toxic texts with the greatest hashes of doc_id, beyond 1,500 of their class, hold a word of their own."""
    ids = spark.range(3600).withColumn("h", F.xxhash64("id")).orderBy("h").collect()
    toxic = [r.id for r in ids if r.id % 2]
    late = set(toxic[1500:])
    rows = [(i, marked(i, "zulrix" if i in late else "vyrmox") if i % 2 else prose(12, i), "en", i % 2) for i in range(3600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    model = toxicity.train(d, d)
    assert (model.scores([marked(10_000 + i, "zulrix") for i in range(40)]) >= 0.5).mean() > 0.9
    assert (model.scores([marked(10_000 + i, "vyrmox") for i in range(40)]) >= 0.5).mean() > 0.9
    assert (model.scores([prose(12, 20_000 + i) for i in range(40)]) < 0.5).mean() > 0.9


def test_shards_make_one_model(spark):
    """Many shards learn as one does, however the rows are dealt, and copies of a row count once."""
    rows = [(i, marked(i, ("vyrmox", "vyrmin")[i % 2]) if i % 4 == 0 else prose(12, i), ("en", "fr", None)[i % 3], int(i % 4 == 0)) for i in range(800)]
    rows += [(-1, "", "en", 1), (-2, None, "en", 0), (-3, "x y", "en", None), (None, "x y", "en", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = d.select("doc_id", "toxic")
    model = toxicity.train(d.repartition(3), labels, shard=200)
    again = toxicity.train(d.unionByName(d.where("doc_id % 5 = 0")).repartition(7), labels, shard=200)
    new = [marked(10_000 + i, "vyrmox") if i % 2 else prose(12, 20_000 + i) for i in range(100)]
    p = model.scores(new)
    assert np.mean((p >= 0.5) == (np.arange(100) % 2 == 1)) > 0.95
    np.testing.assert_allclose(again.scores(new), p, atol=1e-4)


def test_responses_at_ends_of_texts():
    """Texts shorter than a filter, empty ones between others, and blocks of texts: as each text alone."""
    model = toxicity.Model(["en"], 3)
    texts = ["a b c d e", "", "q r", None, "s", "t u v w x", prose(9000, 1), "y z"]
    got = model.logits(*toxicity.coded(texts))
    for text, x in zip(texts, got, strict=True):
        held, flat, ends = toxicity.coded([text])
        vectors = model.embed[held].mean(1)[flat]
        hidden = []
        for f in model.filters:
            places = range(max(1, len(flat) - len(f) + 1))
            hidden += np.max([sum(vectors[k + j] @ f[j] for j in range(len(f)) if k + j < len(flat)) + np.zeros(toxicity.FILTERS) for k in places], axis=0).tolist()
        assert abs(np.maximum(hidden + model.bias, 0) @ model.out + model.shift[0] - x) < 1e-4


def test_no_cut_parts_equal_outputs(spark):
    """Copies under other ids have one output; the cut counts all of them on one side."""
    rows = [(i, "vyrmox vyrmin" if i % 3 == 0 else "plain words here", "en", int(i % 3 == 0 and i % 30 != 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(d, d)
    assert model.scores(["vyrmox vyrmin"])[0] > 0.6 and model.scores(["plain words here"])[0] < 0.4
