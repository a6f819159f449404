"""The training-data operators against DuckDB, brute force, the tokenizer libraries and planted cases."""

import hashlib
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import common, components, compress_lang, decontaminate, html_text, jaccard_join, licenses, pieces, quality, queries, rans, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, ids string, score string, class long"
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + ("." if r.random() < 0.1 else "") for _ in range(n))


HARD = ["", " ", "\n\n", "a", "one two", "It's I'll\tdon't", "a  b   c", "é́ ÀÉ ß ª", "日本語 テキスト\n🙂", "\x00\x01", "x" * 5000, "end<|endoftext|>a", "▁x▁▁y", "THE the, The.", "the " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t), "r", "i", "s", 7) for i, t in enumerate(HARD)]
    rows += [(None, None, None, None, None, None, None, None, None), (99, None, None, "s", None, None, None, None, None), (None, prose(60, 1), None, None, None, None, None, None, None)]
    rows += [(100, prose(80, 2), "en", "s", 1, "r", "i", "s", 7)] * 2 + [(101, prose(80, 2), "en", "s", 1, "r", "i", "s", 7), (102, prose(30000, 3), "de", "s", 1, "r", "i", "s", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100, 1, 0), (101, 1, 1), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_hard_rows_and_empty_tables(docs, empty, labels, spark):
    bench = spark.createDataFrame([(1, prose(80, 2)), (2, None), (None, "a b c d e f"), (3, "")], "item_id long, text string")
    made = {
        "quality": lambda d: quality.apply(d, labels),
        "jaccard": jaccard_join.apply,
        "substring": substring_dedup.apply,
        "decontaminate": lambda d: decontaminate.apply(d, bench),
        "pieces": lambda d: pieces.decode(pieces.encode(d)),
        "licenses": lambda d: licenses.scan(d, licenses.word_counts(d)),
        "language": lambda d: compress_lang.predict(d, {"en": b"the and of to in", "de": b"und der die das"}),
        "toxicity": lambda d: toxicity.predict(d, toxicity.Model(["en"])),
        "tokens": lambda d: rans.digest(rans.write(d)),
    }
    for name, fn in made.items():
        assert fn(empty).count() == 0, name
    assert {r.doc_id for r in made["quality"](docs).collect()} >= {100, 101}
    kept = [r.doc_id for r in made["jaccard"](docs).collect()]
    assert kept.count(100) == 1 and 101 not in kept and 102 in kept and kept.count(None) == 2
    clean = [r.doc_id for r in made["decontaminate"](docs).collect()]
    assert 100 not in clean and 101 not in clean and 102 in clean and 0 in clean
    for name in ("pieces", "licenses", "language", "toxicity", "tokens"):
        assert made[name](docs).count() == docs.count(), name
    assert {r.lang_pred for r in made["language"](docs.where("text is null or text = ''")).collect()} == {"und"}
    assert compress_lang.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert set(substring_dedup.apply(docs).columns) == set(docs.columns)


def test_quality_thresholds_hold_their_risk(spark):
    p = spark.createDataFrame([(k, 1000) for k in (0, 1, 5, 20, 60)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect()
    con = duckdb.connect()
    for (got,), k in zip(p, (0, 1, 5, 20, 60), strict=True):
        want = con.sql(f"select sum(exp(lgamma(1001) - lgamma(i + 1) - lgamma(1001 - i) + i * ln(0.05) + (1000 - i) * ln(0.95))) from range({k + 1}) t(i)").fetchall()[0][0]
        assert abs(got - (want if k <= 50 else 1.0)) < 1e-9
    rows = [(i, "x", 100, 500, 0 if i % 1000 else 300, 0, 0) for i in range(20_000)]
    judged = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    cut = quality.thresholds(judged, spark.createDataFrame([(i, 1) for i in range(20_000)], "doc_id long, quality int")).collect()[0]
    assert cut.n_good == 20_000 and cut.symbols_level == len(quality.RULES["symbols"][1])
    few = quality.thresholds(judged.where("doc_id < 50"), spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")).collect()[0]
    assert few.symbols_level == 0


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 4095, 4096, 4097, 30_000):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
        data = rans.write_file([5, None], np.array([n, 0]), ids)
        doc, lengths, back = rans.read_file(data)
        assert doc == [5, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(rans.CorruptFile):
        rans.read_file(bytes(bad))


def test_token_files(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in own.collect()}
    got = {r.doc_id: r for r in rans.digest(rans.write(own)).collect()}
    at = 0
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[i][:20]
        at += len(ids)


def test_token_files_of_repeated_ids(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    runs = [sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.digest(rans.write(d)).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    assert [r[0] for r in runs[0]] == np.cumsum([0, *(r[2] for r in runs[0])])[:-1].tolist()
    ids = [-(1 << 63) if r[1] is None else r[1] for r in runs[0]]
    assert ids == sorted(ids)
    want = sorted(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sorted(r[2] for r in runs[0]) == want


def test_pieces(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in pieces.digest(docs).join(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_chunk_table_forgets_without_changing():
    table = common.ChunkTable(lambda new: common.joined([[len(c)] * len(c) for c in new]), limit=3)
    for _ in range(4):
        flat, at = table.ids([["a", "bb"], [], ["ccc", "dddd", "a"]])
        assert flat.tolist() == [1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 1] and at.tolist() == [0, 3, 3, 11]


def families(seed):
    r = random.Random(seed)
    texts = []
    for f in range(12):
        base = prose(r.choice((6, 9, 30, 120, 400)), 100 + f).split()
        for _ in range(r.choice((1, 4, 15))):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            texts.append(" ".join(w))
    return texts


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("shingles_in_a_block", [1_500_000, 900])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, shingles_in_a_block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles_in_a_block)
    texts = families(3) + HARD[:5]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(d, 4, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 4, 85)


def test_r_tree_links_equal_brute_force():
    texts = families(8)
    make = jaccard_join.Sets(4)
    sets = make(texts)
    classes = {}
    for s in sets:
        if len(s):
            classes[jaccard_join.class_of(s)] = s
    keys = np.array(list(classes), np.int64)
    links = jaccard_join.link(keys, list(classes.values()), 85)
    for a, b in links:
        both = len(np.intersect1d(classes[a], classes[b]))
        assert 100 * both >= 85 * (len(classes[a]) + len(classes[b]) - both)


@pytest.mark.parametrize("percent", [70, 80, 85, 90])
def test_cells_meet_for_every_link(percent):
    bands, r = jaccard_join.Bands(percent), np.random.default_rng(percent)
    links = 0
    for n in [*range(bands.least, 40), 60, 140, 500, 1300, 2200, 3000, 4000, 5800, 10_000]:
        for share in (0, 0.3, 0.5, 1) * (5 if n < 40 else 1):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            keep = r.permutation(a)[: n - int(share * ((100 - percent) * n // 100))]
            new = 0
            while 100 * len(keep) >= percent * (n + new + 1):
                new += 1
            b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, new).astype(np.uint64)]))
            assert 100 * len(keep) >= percent * (n + len(b) - len(keep))
            links += 1
            assert len(np.intersect1d(bands.cells(a), bands.cells(b))) > 0, n
    assert links > 500


def test_cells_stay_few():
    for percent, most in ((70, 2.0), (80, 1.1), (85, 0.6), (90, 0.4)):
        bands, r = jaccard_join.Bands(percent), np.random.default_rng(percent)
        for n in [*range(60, 400, 37), 97, 128, 256, 900, 1300, 2200, 3000, 4000, 5800, 10_000, 50_000]:
            held = [len(bands.cells(np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)))) / n for _ in range(3)]
            assert sum(held) / 3 < most, (percent, n)
    with pytest.raises(ValueError):
        jaccard_join.Bands(50)


def test_components(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 21)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and got[21] == 20 and got[129] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(components, "BUFFER_EDGES", 20)
    r = random.Random(4)
    names = r.sample(range(-5000, 5000), 900)
    chains = [list(zip(x, x[1:], strict=False)) for x in (names[:400], names[400:700])] + [[(names[700], n) for n in names[701:800]], [(names[r.randrange(800, 830)], n) for n in names[830:]]]
    edges = [e for c in chains for e in c] * 2
    r.shuffle(edges)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {int(n): int(c) for n, c in [*components.forest(np.array(edges)), *((c, c) for c in set(components.forest(np.array(edges))[:, 1]))]}
    assert all(got[n] == min(names[:400]) for n in names[:400]) and all(got[n] == min(names[700:800]) for n in names[700:800])


def plain_units(text):
    """Start, end and words of the lines' sentences, found character by character."""
    out, start = [], 0
    for i in range(len(text) + 1):
        if i == len(text) or text[i] == "\n" or (text[i].isspace() and i and text[i - 1] in ".!?…。！？"):
            if text[start:i].strip():
                left = start + len(text[start:i]) - len(text[start:i].lstrip())
                out.append((left, left + len(text[left:i].rstrip()), text[left:i].lower().split()))
            start = i + 1
    return [u for u in out if len(u[2]) >= 3]


def brute_spans(rows):
    first, out = {}, set()
    for i, t in sorted(rows):
        for a, _, w in plain_units(t):
            first.setdefault(tuple(w), (i, a))
    for i, t in rows:
        run = []
        for a, b, w in [*plain_units(t), (None, None, None)]:
            if w and first[tuple(w)] != (i, a):
                run.append((a, b, len(w)))
                continue
            if sum(x[2] for x in run) >= 20:
                out.add((i, run[0][0], run[-1][1]))
            run = []
    return out


def test_substring_dedup_against_brute_force(spark):
    passage = "The first of it is here. " + " ".join(f"Then {prose(9, 50 + k)}." for k in range(6))
    line = "A line of twenty or more words stands here, as it does elsewhere, and is counted among the repeats of this small table"
    rows = [(i, prose(40, 200 + i) + " of " + passage + " and " + prose(30, 300 + i)) for i in range(5)]
    rows += [(10, line + ".\nother\n" + prose(20, 9)), (11, prose(20, 10) + "\n" + line.upper().replace("LINE", " LINE ").strip() + "."), (12, prose(50, 11)), (13, ""), (14, "no no")]
    rows += [(20, "One sentence that both have.  " + prose(30, 21)), (21, prose(30, 22) + "\nOne sentence that both have.")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.start, r.end) for r in substring_dedup.spans(d).collect()} == brute_spans(rows)
    after = {r.doc_id: r.text for r in substring_dedup.apply(d).collect()}
    assert sum("Then " in t for t in after.values()) == 1 and after[12] == dict(rows)[12] and "elsewhere" not in after[11].lower()
    assert 13 in after and after[21] == dict(rows)[21]


def test_decontamination_finds_substitutions_and_spares_the_rest(spark, monkeypatch):
    items = [(i, prose(n, 400 + i)) for i, n in enumerate((5, 8, 18, 30, 52))] + [(9, "a b")]
    rows = []
    for i, t in items[:5]:
        w = t.split()
        if len(w) > 12:
            for k in range(5, len(w), 11):
                w[k] = "substituted"
        rows.append((i, prose(50, 500 + i) + " " + " ".join(w).upper() + " " + prose(50, 600 + i)))
    rows += [(20 + i, prose(300, 700 + i)) for i in range(5)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (2_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert {(r.doc_id, r.item_id) for r in decontaminate.find(d, b).collect()} == {(i, i) for i in range(5)}
        assert {r.doc_id for r in decontaminate.apply(d, b).collect()} == {20, 21, 22, 23, 24}


def test_seed_hits_equal_plain_search():
    items = decontaminate.Items([(1, prose(40, 1)), (2, prose(20, 2))])
    h = decontaminate.WordHashes()(decontaminate.tokens(prose(30, 3) + " " + prose(40, 1)))
    want = {(k, p - q) for m, mask in enumerate(decontaminate.MASKS) for k, w in enumerate(items.words) for q in range(len(w) - 11) for p in range(len(h) - 11) if all(h[p + x] == w[q + x] for x in mask)}
    assert set(map(tuple, items.laid(h).T.tolist())) == want


def test_license_join_misses_no_block():
    join = licenses.Join({w: i for i, w in enumerate(sorted(frozenset().union(*(s for _, s in licenses.template_sets()))))})
    r = random.Random(1)
    for _, text, _, _ in licenses.TEMPLATES:
        for _ in range(20):
            w = [x for x in licenses.words(text) if r.random() > 0.15] + [v.encode() for v in VOCAB[:5]]
            told = [set(licenses.words(need)) <= set(w) and not set(licenses.words(bar)) & set(w) for _, _, need, bar in licenses.TEMPLATES]
            want = {k: len(s & set(w)) / len(s) for k, (_, s) in enumerate(licenses.template_sets()) if told[k] and len(s & set(w)) >= 0.8 * len(s) - 1e-9}
            assert join.match(w) == want
    n, places, found = licenses.scan_text("Under the MIT License, under the mit license.\nxx", join)
    assert n == 9 and [p for p, _ in places] == [0, 4]


def test_language_held_out(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = compress_lang.query(spark, "/root/testdata/sf0.01").where("held_out").join(d.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.95


def test_toxicity_learns_words_and_starts(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(r.randint(20, 80), 1000 + i).split()
        if bad:
            w[r.randrange(len(w))] = r.choice(("vilexa", "vilexo", "vilexin", "grumthon"))
        rows.append((i, " ".join(w), r.choice(("en", "fr")), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(d.where("doc_id < 300"), d.where("doc_id < 300"))
    test = d.where("doc_id >= 300").collect()
    p = model.scores([t.text for t in test]) >= 0.5
    assert np.mean(p == np.array([t.toxic for t in test], bool)) > 0.95
    assert (model.scores([None, "", "123"]) < 0.5).all()
    assert toxicity.train(d, d.where("toxic = 0")) is None


def test_html_blocks_and_text(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li>Menu</ul></nav><article><h1>A &amp; B</h1><p>One<br>two &copy; three four five six seven.<p><b>Next</b> part of the text is here<script>var x='</p>'</script>.</article><footer>Copyright me</footer>"
    assert [b[0] for b in html_text.blocks(page)] == ["Home", "Menu", "A & B", "One two © three four five six seven.", "Next part of the text is here.", "Copyright me"]
    model = html_text.trained(400)
    rng = random.Random(77)
    made = [html_text.sample_page(rng) for _ in range(60)]
    right = [(z > 0) == np.array(y) for (p, y), z in zip(made, model.logits([html_text.blocks(p) for p, _ in made]), strict=True)]
    assert np.concatenate(right).mean() > 0.97
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>"), (5, "plain <b")], "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extract(df, model).collect()}
    assert got[1] == "A & B\n\nOne two © three four five six seven.\n\nNext part of the text is here." and got[2] == got[3] == got[4] == ""


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 3_000_000, None, "b", "c" * 2_500_000, ""]})
    assert [r for s in common.slices(batch, "text") for r in s.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        after[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == names
            docs = spark.createDataFrame(after[name], docs.schema)
    judged = {r.doc_id for r in quality.query(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in after["quality_rules"]} == judged
    texts = [r.text for r in sorted(after["quality_rules"], key=lambda r: r.doc_id)]
    ids = sorted(judged)
    want = {ids[i] for i, c in enumerate(brute_components(texts, 5, 80)) if c == i}
    assert {r.doc_id for r in after["near_duplicates"]} == want
    near = [(r.doc_id, r.text) for r in after["near_duplicates"]]
    cut = brute_spans(near)
    for r in after["repeated_passages"]:
        t, out, at = before[r.doc_id], [], 0
        for _, a, b in sorted(x for x in cut if x[0] == r.doc_id):
            out.append(t[at:a])
            at = b
        assert r.text == "".join(out) + t[at:] and r.n_chars == len(r.text)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r for r in after["decontamination"] if any(t in r.text for t in items)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r.text for r in after["decontamination"]}
    assert {r.doc_id: list(r.ids) for r in after["tokens"]} == {i: sp.encode(t) for i, t in last.items()}


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        d = spark.read.parquet(f"{sf}/{name}.parquet")
        (d.limit(0) if name == "documents" else d).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
