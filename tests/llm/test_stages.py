"""Pipeline stages on awkward rows; the language model, the classifier and the licence scan against plain versions."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lm
from corpusloom.llm.licenses import align, scan_licenses
from corpusloom.llm.lm import LogBilinear, Vocabulary, contexts, score_texts, tokens
from corpusloom.llm.quality import fit
from tests.llm.test_llm import vocabulary

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, quality string, keep int, kept string, component_id int, n_words string, "
    "kept_text int, doc string, tag int, row string, __doc int, __cut int, `a b` int"
)


@pytest.fixture()
def sf_dir(spark, tmp_path):
    """Tables with benchmark items and labels."""
    spark.createDataFrame([(1, "what is the capital of the large country in the far north of the old world"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def frame(spark, rows):
    rest = ("good", 1, "k", 2, "w", 3, "d", 4, "r", 5, 6, 7)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *rest) for i, t, s in rows], COLUMNS)


def awkward():
    draw, words = random.Random(2), vocabulary(600, 3)
    text = lambda k: " ".join(draw.choice(words) for _ in range(k)) + "."
    body = text(80)
    leak = "x " + "what is the capital of the large country in the far north of the old world"
    return [
        (1, body, "a"), (1, text(70), "a"), (2, body, None), (None, body, "b"), (None, text(60), "b"), (None, None, "b"), (3, None, None), (4, "", "a"),
        (5, " \n\t", "a"), (6, text(30) + " " + leak, "a"), (7, text(20000), "c"), (7, text(20000), "c"), (8, text(65) + " " + body, "a"),
    ]


@pytest.mark.parametrize("number", range(5))
def test_stage_on_awkward_rows(spark, sf_dir, number):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    rows = awkward()
    docs = frame(spark, rows).repartition(3)
    out = stage(spark, docs, sf_dir)
    found = out.collect()
    if name != "mix":
        assert out.columns == docs.columns
        assert all((r.quality, r.keep, r.kept, r.component_id, r.n_words, r.kept_text, r.doc, r["a b"]) == ("good", 1, "k", 2, "w", 3, "d", 7) for r in found)
    texts = collections.Counter((r.doc_id, r.text) for r in found)
    given = collections.Counter((i, t) for i, t, _ in rows)
    if name == "minhash_near_dedup":  # document 2 is a copy of document 1; rows without an id are like nothing else
        assert given - texts == collections.Counter([(2, rows[0][1])]) and not texts - given
    if name == "substring_dedup":
        assert not {2} & {r.doc_id for r in found} and (None, rows[0][1]) not in texts
        assert (3, None) in texts and (4, "") in texts and all(r.n_chars == len(r.text) for r in found if r.doc_id == 8)
    if name == "decontaminate":
        assert given - texts == collections.Counter([(6, rows[9][1])])
    if name == "mix":
        assert not {3, 4, 5} & {r.doc_id for r in found} and all(r.taken > 0 for r in found)
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same scores over 1, 16 and 128 partitions, with one block of tokens and with several."""
    draw, words = random.Random(5), vocabulary(300, 4)
    rows = [(i, " ".join(draw.choice(words[: 1 + i % 300]) for _ in range(draw.randint(0, 120)))) for i in range(300)]
    for block in (1 << 21, 4000):
        monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
        found = []
        for n in (1, 16, 128):
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
            found.append({r.doc_id: r.score for r in score_texts(docs).collect()})
        # Products of single-precision matrices differ in their last digits with the number of rows.
        assert all(f[i] == pytest.approx(found[0][i], rel=1e-5) for f in found for i in f)


def test_scores_like_plain_numpy(spark):
    """The score is the sum of log P(class | context) and log P(word | class), evaluated token by token."""
    draw, words = random.Random(6), vocabulary(400, 4)
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for i in range(120)]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held_out"), F.col("doc_id").alias("doc"))
    counts = texts.select("held_out", "text").mapInArrow(lm._count, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    known = Vocabulary(counts)
    learn = texts.where("NOT held_out").select(F.xxhash64("doc", "text").alias("h"), "text").toArrow()
    model = LogBilinear(known.unigram, np.array(lm._train(known, None)(learn).column("flat")[0].as_py()))
    for i, text in rows:
        word, last, row, per_row = tokens(pa.array([text]))
        heavy, place = known.find(word)
        classes = known.classes(last, heavy, place)
        total = 0.0
        for t, c in enumerate(contexts(classes, row, per_row)):
            guess = sum(model.context[c[j]].astype(float) * model.position[j] for j in range(lm.CONTEXT))
            scores = model.target.astype(float) @ guess + model.bias
            total += (scores[classes[t]] - np.log(np.exp(scores).sum())) / np.log(10)
            if classes[t] >= lm.TOP:
                n = known.counts[place[t]] if heavy[t] else 0
                total += np.log10((n + lm.ALPHA) / known.sizes[classes[t]])
        assert got[i] == pytest.approx(total, rel=1e-4)


def longest_common(a, b):
    """Most words in common, in order: the plain table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_matches_most_words():
    draw = np.random.Generator(np.random.PCG64(4))
    for _ in range(60):
        a = draw.integers(0, 10**6, 20)
        b = list(a)
        for _ in range(draw.integers(0, 4)):  # changed, dropped or added words, within the band
            at = int(draw.integers(0, len(b)))
            b[at : at + int(draw.integers(0, 2))] = list(draw.integers(10**6, 10**7, int(draw.integers(0, 2))))
        shifted = np.array([0] * 8 + b + [0] * 16)
        matched, first, last = align(a.astype(np.uint64), shifted.astype(np.uint64), 8)
        assert matched == longest_common(list(a), b)
        assert first >= 8 and last < 8 + len(b)


def test_templates_from_a_table(spark):
    words = vocabulary(40, 6)
    templates = spark.createDataFrame([("long", " ".join(words)), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(words).upper() + " c"), (2, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.start_word, r.end_word, r.coverage) for r in scan_licenses(docs, templates=templates).collect()] == [(1, "long", 2, 42, 1.0)]


def test_classifier_does_not_depend_on_the_layout(spark):
    """Also where texts with one fingerprint have different labels."""
    draw, words = random.Random(9), vocabulary(500, 5)
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 80))) + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(60)] + [(300 + i, "") for i in range(5)]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0 or i in (201, 230))) for i in range(305)], "doc_id long, quality int, toxic int")
    found = []
    for n in (1, 9):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        found.append({r.doc_id: (round(r.quality, 6), round(r.toxicity, 6), r.keep) for r in fit(docs, labels, label_rows=250, fit_rows=200).score(docs).collect()})
    assert found[0] == found[1]


def paired(n=400):
    """Texts of 600 words, and few of four rarer ones with the same last byte, each of which has its own neighbours."""
    draw, words = random.Random(9), vocabulary(700, 6)[:600]
    rare = ["zz" + w + "z" for w in words[:4]]
    rows = [(i, " ".join(draw.choice(words) for _ in range(400))) for i in range(n)]
    for i in range(n, n + 40):
        rows.append((i, " ".join(f"{words[0]} {rare[0]} {words[2]} {words[1]} {rare[1]} {words[3]} {rare[2]} {words[4]} {rare[3]} {words[5]}".split()[k % 10] for k in range(0, 10 * (i % 7 + 1)))))
    return rows, words, rare


def test_words_beyond_the_most_frequent_have_a_context(spark, monkeypatch):
    """words that share a class, and even their counts, are told apart by what stands before them, and tell apart what follows."""
    for split in (1 << 20, 100):  # whole classes, and such split by hash
        monkeypatch.setattr(lm, "CLASS_TOKENS", split, raising=False)
        rows, words, rare = paired()
        asked = {  # right before wrong: as what is predicted, and as what it is predicted from
            1_000_000: f"{words[0]} {rare[0]}", 1_000_001: f"{words[0]} {rare[1]}", 1_000_002: f"{words[1]} {rare[1]}", 1_000_003: f"{words[1]} {rare[0]}",
            1_000_004: f"{rare[2]} {words[4]}", 1_000_005: f"{rare[3]} {words[4]}", 1_000_006: f"{rare[3]} {words[5]}", 1_000_007: f"{rare[2]} {words[5]}",
        }
        docs = spark.createDataFrame(rows + list(asked.items()), "doc_id long, text string")
        got = {r.doc_id: r.score for r in score_texts(docs).where("doc_id >= 1000000").collect()}
        gains = [got[i] - got[i + 1] for i in range(1_000_000, 1_000_008, 2)]
        assert gains[0] + gains[1] > 0.02 and gains[2] + gains[3] > 0.02, gains


def test_a_tree_holds_all_words():
    """probabilities of a class's words add up to one, before training by their counts, and stay so."""
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 700):
        weight = draw.integers(1, 1000, n) ** 2 + lm.ALPHA
        tree, guess = lm.Tree(weight), draw.normal(size=(1, lm.WIDTH)).astype(np.float32)
        assert len(tree.vec) == n - 1
        p = 10 ** tree.log10(np.arange(n), np.repeat(guess, n, 0))
        assert p == pytest.approx(weight / weight.sum(), rel=1e-4)
        before = p[0]
        for _ in range(200):
            tree.train(np.zeros(8, np.int64), np.repeat(guess, 8, 0))
        p = 10 ** tree.log10(np.arange(n), np.repeat(guess, n, 0))
        assert p.sum() == pytest.approx(1, abs=1e-4) and (n == 1 or p[0] > before + 0.1)
