"""What tasks hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import operators as op
from corpusloom.llm import common

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


def test_stored_tables_reach_python_in_small_batches(spark):
    before = spark.conf.get(KEY, None)
    sizes = [r.n for r in common.stored(spark.range(0, 5000, 1, 1).mapInArrow(_sizes, "n long")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= common.BATCH_ROWS
    assert spark.conf.get(KEY, None) == before


def test_new_parts_are_encoded_in_groups(monkeypatch):
    """The tokenizer's results for many new parts are never held all at once; ids stay the same."""
    import public_tokenizers

    from corpusloom.llm import packing

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = np.random.default_rng(1).integers(97, 123, (8000, 9), np.uint8)
    texts = pa.array([b" ".join(w.tobytes() for w in part).decode() for part in np.split(letters, 100)])
    seen, plain = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda parts: seen.append(len(parts)) or plain(parts))
    ids, counts = encoder(texts)
    assert sum(seen) > max(seen) and max(seen) <= packing.AT_ONCE
    assert np.array_equal(ids, np.concatenate(encoder.whole(texts.to_pylist()))) and counts.sum() == len(ids)


def test_pairs_of_blocks_are_not_shuffled(spark):
    """F1 to F3: nothing is shuffled or written for a pair of blocks."""
    from corpusloom.operators import blocks

    vectors = np.random.default_rng(4).normal(size=(200, 3))
    rows = [(i, v.tolist(), 1, 0.0, 0, 9.0) for i, v in enumerate(vectors)]
    packed = blocks.packed(blocks.placed(spark.createDataFrame(rows, blocks.POINT), vectors[:4]), 8)
    assert packed.count() > 16
    met = blocks.meet(packed, 3, lambda: blocks.Nearest(2), blocks.NEAREST)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    near = {r.id: [e["id"] for e in r.near] for r in met.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, 2).alias("near")).collect()}
    d = ((vectors[:, None] - vectors[None]) ** 2).sum(-1) + np.diag(np.full(200, np.inf))
    assert near == {i: np.argsort(d[i])[:2].tolist() for i in range(200)}


def test_no_cluster_but_all_rows(spark):
    """a tree without a split into two large sides has no cluster to select."""
    vectors = np.random.default_rng(5).normal(size=(25, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    assert {r.hdbscan for r in op.density_hierarchy(df, "v", "id", 15, 3).collect()} == {-1}


def test_counts_are_kept_by_piece(monkeypatch):
    """the Python objects of all texts of a batch are never held together."""
    from corpusloom.operators import matchmany

    monkeypatch.setattr(matchmany, "PIECE_BYTES", 1000)
    texts = pa.array(["x" * 100] * 4000)
    tracemalloc.start()
    found = matchmany._matches(lambda piece: [dict.fromkeys(range(50), 1) for _ in range(len(piece))], [[f"n{i}"] for i in range(50)], texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4000 and len(found[3999]) == 50 and peak < 4 << 20


def test_features_are_made_behind_the_join(spark, tmp_path):
    """what is shuffled are vectors, not their features."""
    from corpusloom.plans.queries import QUERIES

    vectors = np.random.default_rng(6).normal(size=(50, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["kernel_products"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" in plan and "EvalPython" not in plan[plan.index("Join") :]
    assert {(r.vec_id, r.near) for r in found.collect()} == {(i, True) for i in range(49)}


def test_cuts_are_judged_once(spark):
    """a text's words around its cuts are looked at once, not for begins and ends each."""
    from corpusloom.operators import boundaries

    model = boundaries.BoundaryModel(["dr"], ["the"], ["prof smith"])
    df = spark.createDataFrame([("He met Dr. Low. Prof. Smith left. The dr. The end.  ",), ("",), (None,)], "t string")
    frame = df.select(boundaries.learned_spans(F.col("t"), model).alias("s"))
    assert frame._jdf.queryExecution().analyzed().toString().count("prof smith") == 1
    assert [[(x.start, x.end) for x in r.s] if r.s is not None else None for r in frame.collect()] == [[(0, 15), (16, 33), (34, 41), (42, 50)], [], None]


def test_models_get_pieces(spark):
    """a user's model never gets all texts of a batch."""
    sizes = op.model_encoder(lambda: lambda texts: [[len(texts)] for _ in texts])
    df = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("t"))
    assert max(r.v[0] for r in op.encode_text(df, "t", sizes, out="v").collect()) <= 1024


def _most_held(task, batch):
    tracemalloc.start()
    rows = sum(out.num_rows for out in task(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_stages_hold_small_pieces_of_text():
    """A task of the pipeline holds the numbers of a small piece of text, whatever the batch."""
    from corpusloom.llm import decontam, neardup, quality, substring

    def examined(batches):
        for batch in batches:
            for piece in quality.slices(batch, "text", quality.SMALL_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(quality.examine(piece.column("text"), np.arange(5, dtype=np.uint64))[-1])], ["n"])

    words = np.random.default_rng(7).integers(97, 123, (400, 700, 5), np.uint8)
    texts = pa.array([b" ".join(w.tobytes() for w in text).decode() for text in words])  # 1.7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int64()), texts], ["doc", "tag", "text"])
    leaks = decontam._template_windows([8], np.zeros(16, np.uint64))
    for task, rows, most_mb in ((examined, 400, 24), (neardup._sketch(5), 400, 12), (leaks, 0, 22), (substring._runs(13, 5, 1), 1, 17)):
        found, peak = _most_held(task, batch)
        assert found == rows and peak < most_mb << 20


def test_a_text_is_cut_once(spark):
    """A filter on what is left of a text does not cut it again, in another Python worker of the same task."""
    from corpusloom.llm.substring import remove_repeats

    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"a {passage} b"), (3, passage), (4, None)], "doc_id long, text string")
    cut = remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words").select("doc_id", "kept_text")
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {tuple(r) for r in cut.collect()} == {(1, passage), (2, "a b"), (4, "")}


def test_small_tables_need_no_python_workers(spark):
    df = common.small_table(spark, {"a": np.array([3, 1]), "b": np.array([0.5, 1.0])}, "a long, b double")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert df.dtypes == [("a", "bigint"), ("b", "double")] and [tuple(r) for r in df.collect()] == [(3, 0.5), (1, 1.0)]
    empty = common.small_table(spark, {"a": np.array([], np.int64), "b": np.array([])}, "a long, b double")
    assert empty.dtypes == df.dtypes and empty.collect() == []
