"""The training-data operators against brute force, and on awkward rows."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries as q
from corpusloom.llm.ann import nearest
from corpusloom.llm.chat import InstructTemplate, format_chats, locate, read_back
from corpusloom.llm.decontam import benchmark_leaks, without_leaks
from corpusloom.llm.licenses import scan_licenses
from corpusloom.llm.lm import LogBilinear, CLASSES, CONTEXT, score_texts
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm import neardup, quality
from corpusloom.llm.neardup import near_duplicates
from corpusloom.llm.quality import expectation_maximisation, fit
from corpusloom.llm.substring import remove_repeats
from corpusloom.llm.suffix import maximal_repeats
from tests.compare import compare, connect
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
DOCS = "doc_id long, text string, source string, size string, doc string, n_words int, tag int, bucket string"


def vocabulary(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def corpus(seed=2, n=60):
    """Random texts with exact copies, near copies, shared passages, repeated words, and awkward rows."""
    draw, words = random.Random(seed), vocabulary(300)
    text = lambda k: [draw.choice(words) for _ in range(k)]
    passage = text(70)
    rows = []
    for i in range(n):
        kind = i % 6
        w = text(draw.randint(1, 160))
        if kind == 1 and rows:
            w = rows[-1][1].split()
        if kind == 2 and rows:
            w = rows[-2][1].split()
            w[draw.randrange(len(w))] = "changed"
        if kind == 3:
            at = draw.randrange(len(w))
            w[at:at] = passage[draw.randrange(5) :]
        if kind == 4:
            w = [w[0]] * draw.randint(1, 90)
        rows.append((i, draw.choice(["", " ", "\n"]) + draw.choice([" ", "  ", "\t"]).join(w) + draw.choice(["", " \r\n"])))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "É ß x y"), (n + 4, "x" * 300_000 + " y" * 50)]


def frame(spark, rows):
    """With extra columns whose names clash with results and internals."""
    return spark.createDataFrame([(i, t, None if i is None else f"s{i % 4}", "z", "d", 5, 6, "b") for i, t in rows], DOCS).repartition(5)


@tables
@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, q.QUERIES[name], q.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("seed", [2, 3])
def test_substring(spark, seed):
    rows = corpus(seed)
    out = remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out} == brute.repeats(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("seed", [2, 3])
def test_suffix_array(spark, seed):
    rows = corpus(seed)
    out = maximal_repeats(frame(spark, rows)).collect()
    removed = collections.Counter()
    for r in out:
        removed[r.doc_id] += r.n_words
        assert r.n_words == r.end_word - r.start_word >= 50 and r.first_doc_id < r.doc_id
    assert removed == collections.Counter({i: b for i, (_, b, _) in brute.repeats(rows, 50).items() if b})


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_suffix_array_origins(spark, partitions):
    """The smallest document of a span, also where the order spreads a passage over tasks or contexts differ."""
    draw, words = random.Random(11), vocabulary(400)
    text = lambda k: [draw.choice(words) for _ in range(k)]
    passage, body = text(80), text(30)
    rows = corpus(9) + [(100 + i, " ".join(passage)) for i in range(60)]
    rows += [(200, " ".join(text(9) + passage[:70])), (90, " ".join(text(20) + passage[5:75] + text(20)))]
    shared = text(60)
    rows += [(302, " ".join(text(30) + shared + text(30)))] + [(i, " ".join(body + shared + body)) for i in (305, 307, 309)]
    split = {i: brute.words(t) for i, t in rows}
    first = {}
    for i in sorted(split):
        for j in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][j : j + 50]), i)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = maximal_repeats(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id for r in found} > {101, 159, 305, 307, 309}
    for r in found:
        w = split[r.doc_id]
        assert r.first_doc_id == min(first[tuple(w[j : j + 50])] for j in range(r.start_word, r.end_word - 49)), r


def test_many_runs_of_one_anchor(spark):
    """An anchor with more different surroundings than a task settles at once."""
    draw, words = random.Random(5), vocabulary(500)
    line = [draw.choice(words) for _ in range(14)]
    rows = [(i, " ".join([draw.choice(words) for _ in range(20)] + line + [draw.choice(words) for _ in range(20)])) for i in range(200)]
    out = remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out} == brute.repeats(rows)


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(4, 90)
    base = vocabulary(200, 9)
    draw = random.Random(6)
    for i in range(200, 260):  # a group of copies, some further from each other than from the first
        w = list(base)
        for _ in range(draw.randint(0, 7)):
            w[draw.randrange(200)] = f"e{draw.random()}"
        rows.append((i, " ".join(w)))
    out = near_duplicates(frame(spark, rows), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == brute.near(rows)


def test_pigeonhole():
    """Errors placed as badly as can be leave SHARED keys; a pair of similarity 0.8 hardly ever has more errors."""
    per_chunk = [math.comb(neardup.CHUNK - e, neardup.CHUNK - neardup.ERRORS) if e <= neardup.ERRORS else 0 for e in range(neardup.CHUNK + 1)]
    fewest = {0: 0}
    for _ in range(neardup.SLOTS // neardup.CHUNK):
        new = {}
        for used, keys in fewest.items():
            for e, left in enumerate(per_chunk):
                if used + e <= neardup.DISTANCE:
                    new[used + e] = min(new.get(used + e, 10**9), keys + left)
        fewest = new
    assert neardup.SHARED == min(fewest.values()) >= 1
    miss = sum(math.comb(64, d) * 0.2**d * 0.8 ** (64 - d) for d in range(neardup.DISTANCE + 1, 65))
    assert miss < 1e-6


def test_every_pair_within_the_distance_shares_keys():
    """Signatures of b bits: all pairs within the distance, found by comparing all of them, have SHARED keys in common."""
    draw = np.random.Generator(np.random.PCG64(3))
    base = draw.integers(0, 1 << neardup.BITS, (40, neardup.SLOTS), dtype=np.uint64)
    rows = [base]
    for errors in (1, 8, 15, 22, 28, 30, 31, 40):
        other = base.copy()
        for row in other:
            at = draw.choice(neardup.SLOTS, errors, replace=False)
            if errors == 30:  # two in each of fifteen chunks
                at = np.array([4 * c + i for c in draw.choice(16, 15, replace=False) for i in draw.choice(4, 2, replace=False)])
            row[at] = (row[at] + draw.integers(1, 1 << neardup.BITS, errors, dtype=np.uint64)) % (1 << neardup.BITS)
        rows.append(other)
    signatures = np.concatenate(rows)
    keys = [set(k) for k in neardup.keys_of(signatures).tolist()]
    within = 0
    for i in range(len(signatures)):
        near = neardup.within_distance(signatures[i], signatures)
        for j in np.flatnonzero(near):
            assert len(keys[i] & keys[j]) >= neardup.SHARED
        within += near.sum() - 1
    assert within >= 2 * 6 * 40


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(vocabulary(60))
    rows = [(1, text), (1, text), (1, "a b c"), (None, text), (None, None), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert cut == collections.Counter({(1, 60, 0): 2, (1, 3, 0): 1, (None, 60, 60): 1, (None, 0, 0): 1, (2, 60, 60): 1})
    spans = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in maximal_repeats(docs).collect()}
    assert spans == {(2, 0, 60, 1), (None, 0, 60, 1)}
    near = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert near == collections.Counter({(1, 1, True): 3, (2, 1, False): 1, (None, None, True): 2})
    scores = score_texts(docs).collect()
    assert len(scores) == 6 and {r.n_tokens for r in scores if r.doc_id == 1} == {61, 4}
    assert scan_licenses(docs).count() == 0
    kept = fit(docs).score(docs).collect()
    assert len(kept) == 6 and not any(r.keep for r in kept if not r.text)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for out in (
        remove_repeats(docs), maximal_repeats(docs), near_duplicates(docs), score_texts(docs), scan_licenses(docs),
        fit(docs, labels).score(docs), benchmark_leaks(docs, items), without_leaks(docs, items), nearest(vectors, vectors),
        format_chats(turns), mix_sources(docs.drop("size").withColumn("size", F.lit(1)))[0],
    ):
        assert out.count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert benchmark_leaks(one, items).count() == 0 and without_leaks(one, items).count() == 1


def test_mixing(spark):
    draw = random.Random(8)
    rows = [(i, None if i % 7 == 0 else f"s{min(i % 5, 3)}", draw.choice([0, 1, 5, 3000, None])) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "tiny", 3), (9, "tiny", 3)], "doc_id long, source string, size long").withColumn("target", F.lit("x"))
    out, slots = mix_sources(docs, block_words=64)
    got = out.collect()
    assert len(got) == 402 and {c for c in out.columns} == {"doc_id", "source", "size", "source_size", "target", "taken"}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] == math.floor(target[s] + 1e-6) <= 3 * sizes[s] for s in sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    weights = dict(zip(sorted((s for s in sizes if s), key=str) + [None], [1, 2, 3, 1, 2, 3]))
    free = [s for s in sizes if target[s] < 3 * sizes[s] - 1e-6]
    levels = [target[s] / weights[s] for s in free]
    assert max(levels) - min(levels) < 1e-6 * max(levels)
    assert all(3 * sizes[s] / weights[s] <= max(levels) for s in sizes if s not in free)
    order = slots.orderBy("slot").collect()
    assert len({r.slot for r in order}) == len(order) and sum(r.take for r in order) == sum(taken.values())
    large = max(taken, key=taken.get)
    number = {r.number for r in order if r.number == max(collections.Counter(x.number for x in order), key=collections.Counter(x.number for x in order).get)}
    first = order[: len(order) // 4]
    share = sum(r.number in number for r in first) / len(first)
    assert abs(share - taken[large] / sum(taken.values())) < 0.05  # every stretch of the schedule has the shares
    again, _ = mix_sources(docs.repartition(7), block_words=64)
    key = lambda rs: collections.Counter((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(again.collect()) == key(got)


def test_mixing_with_given_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(100)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    out, _ = mix_sources(docs, weights=weights)
    assert {r.source: r.target for r in out.collect()} == {"a": 750.0, "b": 250.0}


ITEM = "A train leaves Boston at 60 km per hour and meets the other train after 3 hours. How far did Anna travel in the train from Boston?"


def test_decontamination(spark):
    other = ITEM.replace("Boston", "Chicago").replace("60 km", "75 miles").replace("3 hours", "5 hours").replace("Anna", "Maria")
    mixed = "word " * 30
    rows = [
        (1, mixed + ITEM), (2, mixed + other + " and so on"), (3, "the 5 km of 6 km per 7 km at 8 km " * 5), (4, None), (5, ""),
        (6, " ".join(vocabulary(400))), (7, mixed + "leaves Boston at 60 km per hour and"), (None, ITEM), (8, ITEM), (8, ITEM), (9, "What is two plus two"),
    ]
    items = spark.createDataFrame([(1, ITEM, 0), (2, "What is two plus two", 0), (3, "too short", 0), (4, None, 0), (None, ITEM, 0)], "item_id long, text string, doc int")
    found = {(r.doc_id, r.item_id): r.changed_values for r in benchmark_leaks(frame(spark, rows), items).collect()}
    own = {1: 0, 2: 5, None: 0, 8: 0}
    assert found == {(d, i): n for d, n in own.items() for i in (1, None)} | {(9, 2): 0}  # an item without an id is looked for, too
    assert collections.Counter(r.doc_id for r in without_leaks(frame(spark, rows), items).collect()) == collections.Counter([3, 4, 5, 6, 7])


def test_decontamination_wants_one_renaming(spark):
    swapped = ITEM.replace("Boston", "Chicago", 1)  # the second Boston stays: one of the two cannot be a renaming
    row = benchmark_leaks(spark.createDataFrame([(1, swapped)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    assert row is None or row.matched_tokens < 27


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = benchmark_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.matched_tokens, r.changed_values, r.start_word, r.end_word) for r in found}


def test_decontamination_of_verbatim_copies_in_any_case_and_place(spark):
    items = ["What is two plus two", "Which year did Marie Curie win the second Nobel Prize in Stockholm", "Où vit Émile Zola avec sa tante Zoé"]
    texts = ["Heading\nWhat is two plus two", "heading WHAT IS TWO PLUS TWO?", items[1].lower(), "so " + items[1].upper(), items[2].upper(), "What is two plus three"]
    assert leaks(spark, texts, items) == {
        (0, 0): (5, 0, 1, 6), (1, 0): (5, 0, 1, 6), (2, 1): (12, 0, 0, 12), (3, 1): (12, 0, 1, 13), (4, 2): (8, 0, 0, 8),
    }


def test_decontamination_of_short_items_and_many_placeholders(spark):
    items = ["What is 12 + 30 - 5 + 7", "two words", "Paris", "Ada Lovelace Alan Turing Grace Hopper 1 2 3 4 5 6 7 8 9"]
    texts = ["so: what is 12 + 30 - 5 + 7", "only two words, two words", "paris Paris", "x " + items[3], "What is 13 + 31 - 6 + 8", "two other words"]
    assert leaks(spark, texts, items) == {(0, 0): (6, 0, 1, 10), (1, 1): (2, 0, 1, 3), (2, 2): (1, 0, 0, 1), (3, 3): (15, 0, 1, 16)}


def test_decontamination_of_many_variants_in_one_document(spark):
    words = vocabulary(24, 12)
    item = lambda slots: " ".join(f"{a} {b} {c} {s}" for a, b, c, s in zip(words[::3], words[1::3], words[2::3], slots))
    variants = [item([100 * v + i for i in range(8)]) for v in range(1, 11)]
    outvoted = " ".join([item([7] * 8), item(range(8)), item([7] * 8)])
    found = leaks(spark, ["; ".join(variants), "; ".join(variants[:2]), outvoted, item([5] * 8)], [item(range(8))])
    assert found == {(0, 0): (32, 8, 0, 32), (1, 0): (32, 8, 0, 32), (2, 0): (32, 0, 32, 64)}


@tables
def test_decontamination_brute(spark):
    items = [brute.words(brute.lower(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    grams = {tuple(w[j : j + 13]) for w in items for j in range(len(w) - 12)}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    expected = set()
    for r in docs:
        w = brute.words(brute.lower(r.text))
        if any(tuple(w[j : j + 13]) in grams for j in range(len(w) - 12)):
            expected.add(r.doc_id)
    assert {r.doc_id for r in q.op2_decontaminate(spark, SF_DIR).collect()} == expected


def test_expectation_maximisation():
    draw = np.random.Generator(np.random.PCG64(1))
    bad = draw.random(4000) < 0.2
    votes = np.ones((4000, 5), np.int64)
    for j in range(5):
        seen = bad & (draw.random(4000) < 0.6) | ~bad & (draw.random(4000) < 0.01)
        votes[:, j] = np.where(seen, 0, np.where(draw.random(4000) < 0.3, 1, 2))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, _ = expectation_maximisation(patterns, counts.astype(float))
    right = {tuple(p): b for p, b in zip(patterns, posterior)}
    assert np.mean([(right[tuple(v)] > 0.5) == b for v, b in zip(votes, bad)]) > 0.95  # knowing all rates: 0.98


@tables
def test_quality(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good")
    rows = q.op3_quality_classifier(spark, sf).join(labels, "doc_id").collect()
    clean = [r.keep for r in rows if r.good and not r.toxic]
    assert sum(clean) >= 0.97 * len(clean)
    junk = [r.keep for r in rows if not r.good]
    assert sum(junk) <= 0.1 * len(junk)
    toxic = [r.keep for r in rows if r.toxic]
    assert sum(toxic) <= 0.35 * len(toxic)  # so few labels teach part of the lexicon


def test_sample_is_gathered_behind_a_shuffle(spark):
    texts = spark.range(1000, numPartitions=7).select("id", F.col("id").cast("string").alias("text"))
    sample = spark.createDataFrame([(i, 0.5, 0.1) for i in (900, 5, 77)], "id long, bad double, toxic double")
    out = quality._gathered(texts, sample)
    assert [r.text for r in out.collect()] == ["5", "77", "900"] and out.rdd.getNumPartitions() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Exchange SinglePartition") < plan.index("Join")


def test_language_model(spark):
    rows = corpus(7)
    got = {r.doc_id: r for r in score_texts(frame(spark, rows)).collect()}
    split = {i: [*brute.words(brute.lower(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in split}
    counts = collections.Counter(w for i, ws in split.items() if not held[i] for w in ws)
    total = sum(counts.values())
    for i, ws in split.items():
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_class_probabilities_add_up():
    draw = np.random.Generator(np.random.PCG64(2))
    unigram = draw.random(CLASSES)
    model = LogBilinear(unigram / unigram.sum())
    seen = [np.full_like(p, 1e-4) for p in model.parts()]
    context = draw.integers(0, CLASSES + 1, (256, CONTEXT))
    goal = (context[:, 0] % CLASSES).astype(np.int64)
    before = model.log10(context, goal).mean()
    for _ in range(150):
        model.train(context, goal, draw.integers(0, CLASSES, 24), unigram / unigram.sum(), seen)
    assert model.log10(context, goal).mean() > before + 0.2
    row = np.repeat(context[:1], CLASSES, 0)
    assert (10 ** model.log10(row, np.arange(CLASSES))).sum() == pytest.approx(1, abs=1e-4)


@tables
def test_language_model_beats_base_on_held_out_texts(spark):
    held = q.op4_lm_scores(spark, SF_DIR.replace("0.001", "0.01")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_chat_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\[INST]", "[SYS][/SYS]<s>", "a\\</s>", "[ROLE]x[SAYS]", "<", "[/INST", "\n\t é", "]"]
    draw = random.Random(3)
    turns = [(c, t, draw.choice(["system", "user", "assistant", "tool", "", "[ROLE]"]), draw.choice(texts)) for c in range(40) for t in range(draw.randint(1, 9))]
    turns += [(99, None, None, None), (99, 1, "assistant", None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x")]
    chats = format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    template = InstructTemplate()
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    rows = chats.withColumn("got", read_back(F.col("formatted"), F.col("spans"))).collect()
    assert len(rows) == 42
    for row in rows:
        expected = [(r, x) for _, r, x in sorted(by[row.conv_id])]
        assert template.read(row.formatted) == expected and not row.rewrites_history
        said = [template.unescape(row.formatted[s.text_start : s.text_end]) for s in row.spans]
        assert said == [x for _, x in expected] and row.got.n_turns == len(expected)
        assert row.spans[-1].end == len(row.formatted) == row.got.formatted_chars


def test_rewriting_template_is_noticed():
    class LastOnly:
        def render(self, turns):
            return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    assert locate(LastOnly(), [("a", "one"), ("b", "two")])[2]
    assert not locate(InstructTemplate(), [("user", "one"), ("assistant", "two")])[2]


def test_nearest(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    data = draw.normal(size=(900, 16))
    data[500:700] = data[499]  # one very common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (None, rows[0][1]), (1005, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = collections.defaultdict(list)
    for r in nearest(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    for query, found in got.items():
        exact = sorted((float(np.sqrt(((v - data[query]) ** 2).sum())), i) for i, v in enumerate(data) if i != query)[:10]
        assert [i for i, _ in found] == [i for _, i in exact]
        assert np.allclose([s for _, s in found], [s for s, _ in exact], rtol=1e-12, atol=1e-12)
    few = vectors.where("vec_id < 3")
    assert nearest(few, few).count() == 6


def test_licenses(spark):
    filler = " ".join(vocabulary(50))
    rows = [
        (1, f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler}"), (2, "released under THE mit license!"),
        (3, f"{filler} This work is licensed under the old GNU General Public License version 3 {filler}"), (4, filler), (5, None), (6, ""),
        (7, "Licensed under CC BY-NC 4.0. " + filler + " Licensed under CC BY-NC 4.0"), (None, "Released under the MIT License"),
    ]
    found = collections.defaultdict(list)
    for r in scan_licenses(frame(spark, rows)).collect():
        found[r.doc_id].append((r.license, r.start_word, r.end_word, round(r.coverage, 3)))
    assert found[1] == [("Apache-2.0", 50, 57, 1.0)] and found[2] == [("MIT", 0, 5, 1.0)]
    assert found[3] == [("GPL-3.0", 50, 63, 1.0)] and sorted(found[7]) == [("CC-BY-NC-4.0", 0, 5, 1.0), ("CC-BY-NC-4.0", 55, 60, 1.0)]
    assert set(found) == {1, 2, 3, 7, None}


def test_licenses_close_together(spark):
    mit, cc = "Released under the MIT License", "Licensed under CC BY-NC 4.0"
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    rows = [(1, "\n".join([mit] * 7)), (2, f"{cc}\n{mit}\nx {cc} y {cc} {mit}"), (3, lesser)]
    found = collections.defaultdict(list)
    for r in scan_licenses(frame(spark, rows)).collect():
        found[r.doc_id, r.license].append((r.start_word, r.end_word))
    assert sorted(found[1, "MIT"]) == [(5 * i, 5 * i + 5) for i in range(7)]
    assert sorted(found[2, "MIT"]) == [(5, 10), (22, 27)] and sorted(found[2, "CC-BY-NC-4.0"]) == [(0, 5), (11, 16), (17, 22)]
    assert found[3, "LGPL-2.1-header"] == [(0, len(lesser.split()))]


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "decontaminate", "mix"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = corpus_pipeline.minhash_near_dedup(spark, docs, SF_DIR)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == {i for i, (_, _, kept) in brute.near(rows, 5).items() if kept}
    cut = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, SF_DIR).collect()}
    expected = brute.repeats(rows, 50)
    assert set(cut) == {i for i, (n, removed, _) in expected.items() if removed == 0 or removed < n}
    assert all(cut[i].text == t for i, t in rows if expected[i][1] == 0)
    assert all(len(brute.words(cut[i].text)) == expected[i][0] - expected[i][1] for i in cut)
    final = corpus_pipeline.run(spark, SF_DIR)
    assert final.count() > 0 and {"doc_id", "taken", "target"} <= set(final.columns)
