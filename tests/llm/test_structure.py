"""Packing, conversation repair and the conversation trie against brute force, and on awkward rows."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries as q, repair, structure_queries
from corpusloom.llm.packing import Encoder, best_pair, best_two_fit, fill, pack_documents
from corpusloom.llm.repair import damaged, repair_conversations
from corpusloom.llm.trie import conversation_trie, numbered, running
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
TURNS = "conv_id long, turn long, role string, text string, conv string, at int, task string, h int"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def turns_frame(spark, rows):
    """With extra columns whose names clash with internals."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], TURNS).repartition(6)


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_those_of_whole_texts():
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "a", "b", "Foo", "é", "ß", "ü ", " ", " ", "1", "23", ".", ",", "<|endoftext|>",
             "<|endof", "\x1c", "\x85", "中", "'sam", "\r\n", "́", "²", "ª", "😀", "_", "\x00", "\x7f", "×"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(8000)] + [None, "", "x" * 100_000]
    ids, counts = Encoder(PATH)(pa.array(texts))
    assert [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])] == whole(texts)


def one_by_one(sizes, capacity):
    """Best-two-fit on a plain list, a bin at a time."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        own, gap = [], capacity
        while True:
            for s in list(left):
                if s <= gap:
                    own.append(s)
                    left.remove(s)
                    gap -= s
            if not gap or len(own) < 2:
                break
            least = min(own)
            pairs = [(a + b, b) for i, b in enumerate(left) for a in left[i + 1 :] if least < a + b <= gap + least]
            if not pairs:
                break
            total, b = max(pairs)
            own.remove(least)
            left.append(least)
            for s in (b, total - b):
                own.append(s)
                left.remove(s)
            left.sort(reverse=True)
            gap += least - total
        bins.append(tuple(sorted(own)))
    return collections.Counter(bins)


@pytest.mark.parametrize("seed", range(6))
def test_counted_plan_gives_the_bins_of_one_by_one(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([draw.randint(1, 50), draw.randint(20, 25), 7]) for _ in range(draw.randint(1, 300))]
    got = collections.Counter()
    for chosen, bins in best_two_fit(np.bincount(sizes, minlength=51), 50):
        got[tuple(sorted(chosen.elements()))] += bins
    assert got == one_by_one(sizes, 50)


def test_two_smaller_ones_replace_the_smallest():
    left = np.bincount([6, 3, 2, 2], minlength=11)
    assert best_pair(np.bincount([2, 2], minlength=11), 4) == (2, 2) and best_pair(np.bincount([2], minlength=11), 4) == (0, 0)
    assert sorted(fill(left, 10).elements()) == [2, 2, 6] and left[3] == 1  # 6 + 3 leaves 1, 6 + 2 + 2 nothing


def test_packing(spark):
    draw = random.Random(4)
    words = ["one", "two", "thrée", "four\n", "5", "<|endoftext|>"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ".join(words * 200), "same text"] + ["same text"] * 40
    docs = spark.createDataFrame([(i % 250 if i % 9 else None, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, ids string, part int").repartition(7)
    packing = pack_documents(docs, PATH, capacity=64)
    rows = packing.place(packing.pieces).collect()
    by_row = collections.defaultdict(list)
    for r in rows:
        by_row[r.row].append(r)
    got = collections.Counter()
    for own in by_row.values():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 64 for r in own[1:]) and 0 < own[0].length <= 64
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        got[own[0].doc_id, tuple(i for r in own for i in np.frombuffer(r.ids, "<u4").tolist())] += 1
    expected = collections.Counter((i % 250 if i % 9 else None, (*ids, 0)) for i, ids in enumerate(whole(texts)))
    assert got == expected
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 64
    total = sum(r.length for r in rows)
    assert len(by_sequence) == packing.n_sequences <= -(-total // 64) + 1
    sequences = {r.sequence_id: r.ids for r in packing.sequences().collect()}
    assert sum(map(len, sequences.values())) == 4 * total
    assert all(sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids for r in rows)
    empty = pack_documents(docs.where("false"), PATH)
    assert empty.place(empty.pieces).count() == 0 == empty.sequences().count()


@tables
def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    ids = dict(zip(texts, whole(texts.values())))
    rows = q.QUERIES["op11_best_fit_packing"](spark, SF_DIR).collect()
    for r in rows:
        piece = np.array([*ids[r.doc_id], 0][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes())
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in ids.values())
    assert len({r.sequence_id for r in rows}) <= 1.05 * sum(r.length for r in rows) / 2048 + 1


def conversations(seed, n=200):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user", "assistant"], ["Hi.", "ok", "", " \n", "A b c!", "x? ", "same.", "é ", None]
    return [(c, draw.choice([None, 0, 1, 2, 3, 4, 5, 6, 9]), draw.choice(roles), draw.choice(texts)) for c in range(n) for _ in range(draw.randint(1, 9))]


def test_repair(spark):
    draw = random.Random(7)
    rows = conversations(5) + [(None, 1, "user", "a."), (None, 2, "user", "b.")]
    rows += [(1000, t, draw.choice(["user", "assistant"]), f"{draw.randint(0, 300)}.") for t in range(500)]  # longer than a block
    rows += [(1001, 5, "user", "same.")] * 200 + [(1002, t, "user", "same.") for t in range(100)]
    frame = damaged(turns_frame(spark, rows))
    found = repair_conversations(frame, copies_col="copies").collect()
    expected = brute.repairs(rows)
    assert len(found) == len(expected) and {r.conv_id: tuple(r)[1:] for r in found} == expected


@pytest.mark.parametrize("partitions", [1, 30])
def test_repair_of_a_conversation_in_many_tasks(spark, partitions):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant", "system"]), f"{draw.randint(0, 99)}{draw.choice(['.', ''])}") for t in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        (row,) = repair_conversations(damaged(turns_frame(spark, rows)), copies_col="copies").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(row)[1:] == brute.repairs(rows)[1]


def test_blocks_join_to_the_derivation_of_the_whole():
    draw = random.Random(9)
    for _ in range(60):
        rows = [repair.Row(draw.choice("usax"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 12))]
        blocks, at = repair.Blocks(), 0
        while at < len(rows):
            to = at + draw.randint(1, 4)
            blocks.add(repair.block_of(rows[at:to]))
            at = to
        assert repair.best(blocks.whole()) == repair.lightest(rows, repair.ACCEPTED, "-")["-"]


def test_repair_without_rows(spark):
    assert repair_conversations(turns_frame(spark, []).limit(0)).count() == 0
    gone = turns_frame(spark, [(1, 1, "user", "a."), (None, None, None, None)]).withColumn("copies", F.lit(0))
    rows = repair_conversations(gone, copies_col="copies").collect()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in rows} == {1: nothing, None: nothing}


@pytest.mark.parametrize("share", [True, False])
def test_trie(spark, share):
    draw = random.Random(6)
    said = ["Hi.", "ok you", "", " \n", "A b c!", None]
    rows = [(c, t or None, draw.choice(["user", "assistant", None, ""]), draw.choice(said)) for c in draw.sample(range(900), 300) for t in range(draw.randint(1, 6))]
    rows += [(None, 1, "user", "a."), (None, 2, "user", "b.")]
    rows += [(1000, t, draw.choice(["user", "assistant"]), f"{draw.randint(0, 400)}.") for t in range(2200)]  # more than a block of totals
    rows += [(1010, t, r, x) for c, t, r, x in rows if c == 1000 and t < 1500]
    rows += [(c, t, "user", "copied") for c in range(2000, 2300) for t in range(2)]
    found = conversation_trie(turns_frame(spark, rows), share_first=share).collect()
    expected = brute.trie(rows, share)
    assert len(found) == len(expected) and {(r.conv_id, r.depth): tuple(r)[2:] for r in found} == expected


def test_trie_without_rows(spark):
    assert conversation_trie(turns_frame(spark, []).limit(0)).count() == 0
    assert conversation_trie(turns_frame(spark, [(None, 1, "user", "a")])).count() == 0


@pytest.mark.parametrize("partitions", [1, 13])
def test_numbers_and_running_totals(spark, partitions):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 2, 3]), i, draw.randint(-5, 5)) for i in range(5000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = numbered(spark.createDataFrame(rows, "k long, i long, v long").repartition(9), ["k"], ["i"])
        sums = running(frame, ["k"], ["v"], 4999).collect()
        xors = {(r.k, r.i): r.v for r in running(frame, ["k"], ["v"], 4999, xor=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at, total, xor = collections.Counter(), collections.Counter(), collections.Counter()
    expected = {}
    for k, i, v in rows:
        total[k] += v
        xor[k] ^= v
        expected[k, i] = (at[k], total[k], xor[k])
        at[k] += 1
    assert {(r.k, r.i): (r.at, r.v, xors[r.k, r.i]) for r in sums} == expected
