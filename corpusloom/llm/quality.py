"""Quality and toxicity from weak labels.

1. A lexicon: words and beginnings of words (``STEMS`` bytes) that toxic labelled documents have and others do not, by
   log-likelihood, from at most ``LABEL_ROWS`` labelled rows (those with the smallest hash of their id). Of documents
   with the same smallest shingle, as near copies have, one counts.
2. Votes: overlapping heuristic labellers say bad (-1), good (+1) or nothing (0) about every document; where there are
   labels, the annotator is one more labeller.
3. Expectation-maximisation over the counts of vote patterns (a table whose size the labellers fix) estimates how
   often each labeller says what of good and bad documents, and each pattern's posterior.
4. A hashed linear scorer learns the posteriors from at most ``FIT_ROWS`` documents, again those with the smallest hash.
5. All documents are scored in the scan.

Quality and toxicity are two such models side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import common
from corpusloom.llm.licenses import bare_words
from corpusloom.llm.neardup import distinct_shingles
from corpusloom.llm.words import SMALL_BYTES, Hasher, Words, mix, slices

LABEL_ROWS, FIT_ROWS = 16384, 16384
BUCKETS = 1 << 18
EPOCHS, STEP, DECAY = 6, 0.5, 1e-5
SYMBOLS = b"#$%&*|@^~<>{}[]\\=+_/"
STEMS = (4, 5, 6)
QUALITY = ("symbols", "capitals", "letterless", "doubled_marks", "repeated_lines", "distinct_words", "word_length", "sentences")
TOXIC = ("lexicon_a", "lexicon_b", "lexicon_c")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _vote(x: np.ndarray, good: tuple[float, float], bad_below: float, bad_above: float, sure: np.ndarray) -> np.ndarray:
    vote = np.where((x >= good[0]) & (x <= good[1]), 1, np.where((x < bad_below) | (x > bad_above), -1, 0))
    return np.where(sure, vote, 0).astype(np.int64)


def terms(words: Words, bare: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of bare words and of the beginnings of longer ones, with their rows."""
    hashes, rows, of = [bare], [row], words.row_of_word()
    for stem in STEMS:
        long_ = words.end - words.start > stem
        start = words.start[long_]
        hashes.append(Hasher(lower=True, seed=100 + stem).words(words.text, start, start + stem))
        rows.append(of[long_])
    return np.concatenate(hashes), np.concatenate(rows)


def examine(column: pa.Array, lexicon: np.ndarray):
    """Votes on quality, votes on toxicity, hashes of bare words and the row of each, and the number of words."""
    words, full, bare = bare_words(column)
    text, row = words.text, words.row_of_word()
    rows, n = words.rows, words.counts

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[words.offsets])

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[words.end] - sums[words.start]

    def words_where(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=rows)

    upper, lower = (text >= 65) & (text <= 90), (text >= 97) & (text <= 122)
    letter = upper | lower | (text >= 0xC0)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    long_enough = n >= 8
    chars = np.bincount(row, weights=words.end - words.start, minlength=rows)
    last = text[words.end - 1]
    before = text[np.maximum(words.end - 2, 0)]
    marked = (last < 128) & ~np.isin(last, [*range(48, 58), *range(65, 91), *range(97, 123)])
    doubled = marked & (last == before) & (words.end - words.start > 1)
    ends = np.isin(last, [ord(c) for c in ".?!"]) & ~doubled

    hashes = Hasher(lower=True).words(text, words.start, words.end)
    order = np.lexsort((hashes, row))
    fresh = np.zeros(len(row), bool)
    fresh[order[common.heads_of(row[order], hashes[order])]] = True
    breaks = np.append(0, np.cumsum(text == 10))
    line = breaks[words.start]
    heads = common.heads_of(row, line)
    tails = np.append(heads[1:], len(row))[: len(heads)]
    other = Hasher(lower=True, seed=5)
    lines = other.sequences(other.prefix(hashes), heads, tails)
    of = row[heads]
    again = np.lexsort((lines, of))
    distinct_lines = np.bincount(of[again[common.heads_of(of[again], lines[again])]], minlength=rows)
    all_lines = np.bincount(of, minlength=rows)

    votes = np.stack([
        _vote(_share(per_row(symbol[text]), chars), (0, 0.02), 0, 0.08, long_enough),
        _vote(_share(per_row(upper), per_row(upper | lower)), (0, 0.2), 0, 0.5, long_enough),
        _vote(_share(words_where(per_word(letter) == 0), n), (0, 0.05), 0, 0.2, long_enough),
        _vote(_share(words_where(doubled), n), (0, 0.05), 0, 0.3, long_enough),
        _vote(_share(all_lines - distinct_lines, all_lines), (0, 0.1), 0, 0.5, all_lines >= 4),
        _vote(_share(words_where(fresh), n), (0.3, 1), 0.15, 1, n >= 50),
        _vote(_share(chars, n), (3, 10), 2, 14, long_enough),
        _vote(_share(words_where(ends), n), (0.02, 0.3), 0.005, 0.6, n >= 30),
    ], 1)
    bare_row = row[full]
    term, of = terms(words, bare, bare_row) if len(lexicon) else (bare[:0], bare_row[:0])
    place = np.searchsorted(lexicon, term)
    hit = lexicon[np.minimum(place, len(lexicon) - 1)] == term if len(lexicon) else np.zeros(0, bool)
    part = (term % np.uint64(3)).astype(np.int64)
    has = np.stack([np.bincount(of[hit & (part == i)], minlength=rows) > 0 for i in range(3)], 1)
    toxic = np.stack([np.where(has[:, i] | has[:, (i + 1) % 3], -1, 1) for i in range(3)], 1)
    return votes, toxic, bare, bare_row, n


def _code(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


def decode(code: np.ndarray, labellers: int) -> np.ndarray:
    return np.asarray(code)[:, None] // 3 ** np.arange(labellers) % 3


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of bad for each vote pattern (0 bad, 1 none, 2 good), and P(vote | class) per class and labeller.

    A prior as strong as a tenth of the documents holds that a labeller speaks against few good documents, while it may
    miss most bad ones, as each looks for one kind of badness. So the classes keep their meaning.
    """
    m = votes.shape[1]
    total = max(1.0, float(counts.sum()))
    prior = np.array([[[0.01, 0.0, 0.99]] * m, [[0.3, 0.0, 0.7]] * m]) * (0.1 * total + 1)  # good, bad
    bad = 1 / (1 + np.exp(-(4.0 * (votes == 0).sum(1) - 2.0)))
    speech = prior / prior.sum(2, keepdims=True)
    for _ in range(rounds):
        speech = prior.copy()
        speech[0] *= np.maximum(0.05, 1 - (bad * counts).sum() / total)
        speech[1] *= np.maximum(0.05, (bad * counts).sum() / total)
        for value in (0, 2):
            said = (votes == value) * counts[:, None]
            speech[0, :, value] += ((1 - bad)[:, None] * said).sum(0)
            speech[1, :, value] += (bad[:, None] * said).sum(0)
        speech /= speech.sum(2, keepdims=True)
        share = ((bad * counts).sum() + 0.1) / (total + 1.0)
        score = np.full(len(votes), np.log(share) - np.log(1 - share))
        for j in range(m):
            spoke = votes[:, j] != 1  # silence says nothing
            heard = votes[spoke, j]
            score[spoke] += np.log(speech[1, j, heard]) - np.log(speech[0, j, heard])
        renewed = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(renewed - bad).max(initial=0) < 1e-9:
            break
        bad = renewed
    return bad, speech


def _features(votes: np.ndarray, toxic: np.ndarray, bare: np.ndarray, row: np.ndarray, rows: int):
    """Rows, buckets and values of a sparse matrix: votes count 1, distinct words share a length of 1."""
    order = np.lexsort((bare, row))
    keep = order[common.heads_of(row[order], bare[order])]
    of, bucket = row[keep], (mix(bare[keep] + np.uint64(3)) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64
    value = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=rows)))[of]
    both = np.concatenate([votes, toxic], 1)
    at, labeller = np.nonzero(both)
    said = both[at, labeller] + 2 + 3 * labeller
    return np.concatenate([at, np.arange(rows), of]), np.concatenate([said, np.zeros(rows, np.int64), bucket]), np.concatenate([np.ones(len(at) + rows), value])


def _train(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Logistic regression with Adagrad on the bounded sample, both models at once."""
    weights, seen = np.zeros((BUCKETS, 2), np.float32), np.full((BUCKETS, 2), 1e-6, np.float32)
    data = []
    for batch in batches:
        for piece in slices(batch, "text", SMALL_BYTES):
            votes, toxic, bare, row, n = examine(piece.column("text"), lexicon)
            at, bucket, value = _features(votes, toxic, bare, row, len(n))
            order = np.argsort(at, kind="stable")
            heads = np.searchsorted(at[order], np.arange(len(n) + 1))
            bucket, value = bucket[order].astype(np.int32), value[order].astype(np.float32)
            goal = np.stack([piece.column(c).to_numpy() for c in ("bad", "toxic")], 1)
            data += [(bucket[a:b], value[a:b], g) for a, b, g in zip(heads[:-1], heads[1:], goal)]
    shuffled = np.random.Generator(np.random.PCG64(1))
    for _ in range(EPOCHS):
        for part in np.array_split(shuffled.permutation(len(data)), max(1, len(data) // 64)):
            if not len(part):
                continue
            sizes = [len(data[i][0]) for i in part]
            bucket, value = (np.concatenate([data[i][c] for i in part]) for c in (0, 1))
            of = np.repeat(np.arange(len(part)), sizes)
            margin = np.stack([np.bincount(of, weights=value * weights[bucket, h], minlength=len(part)) for h in (0, 1)], 1)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.stack([data[i][2] for i in part])
            unique, place = np.unique(bucket, return_inverse=True)
            for h in (0, 1):
                slope = np.bincount(place, weights=value * error[of, h], minlength=len(unique)) / len(part) + DECAY * weights[unique, h]
                seen[unique, h] += slope**2
                weights[unique, h] -= STEP * slope / np.sqrt(seen[unique, h])
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})


class QualityModel:
    """A fitted model: the lexicon, the weights, and what EM found out about the labellers."""

    def __init__(self, lexicon: np.ndarray, weights: np.ndarray, speech: dict[str, np.ndarray]):
        self.lexicon, self.weights, self.speech = lexicon, weights, speech

    def score(self, docs: DataFrame, text_col: str = "text", limit: float = 0.5) -> DataFrame:
        """Each row of ``docs`` with ``quality``, ``toxicity`` (probabilities) and ``keep``.

        Kept is what is neither bad nor toxic with a probability above ``limit``. Null and empty texts, and texts
        without words, score 0 quality and are not kept. Columns named like a result are replaced.
        """
        lexicon = self.lexicon
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)  # BUCKETS rows, whatever the input

        @F.arrow_udf("quality double, toxicity double, keep boolean")
        def judge(text: pa.Array) -> pa.Array:
            out = []
            for piece in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SMALL_BYTES):
                votes, toxic, bare, row, n = examine(piece.column("text"), lexicon)
                at, bucket, value = _features(votes, toxic, bare, row, len(n))
                margin = [np.bincount(at, weights=value * shared.value[bucket, h], minlength=len(n)) for h in (0, 1)]
                bad, poison = (1 / (1 + np.exp(-np.clip(m, -30, 30))) for m in margin)
                if not len(lexicon):
                    poison = np.zeros(len(n))
                bad = np.where(n > 0, bad, 1.0)
                keep = (bad <= limit) & (poison <= limit)
                out.append(pa.StructArray.from_arrays([pa.array(1 - bad), pa.array(poison), pa.array(keep)], ["quality", "toxicity", "keep"]))
            kind = pa.struct([("quality", pa.float64()), ("toxicity", pa.float64()), ("keep", pa.bool_())])
            return pa.concat_arrays(out) if out else pa.array([], kind)

        names = ["quality", "toxicity", "keep"]
        plain = docs.drop(*[c for c in docs.columns if c in names])
        scored = plain.withColumn("__judged", judge(F.col(text_col)))
        return scored.select(*[F.col(f"`{c}`") for c in plain.columns], *[F.col(f"__judged.{n}").alias(n) for n in names])


def _smallest(ids: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``id``."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(rows)


def _lexicon(docs: DataFrame, labels: DataFrame, label_rows: int) -> np.ndarray:
    """Words and word beginnings that toxic texts of the labelled sample have, and others hardly ever; no more than the sample holds."""
    chosen = F.broadcast(_smallest(labels, label_rows))  # narrow rows

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                shingles, sizes = distinct_shingles(Words(piece.column("text")), Hasher(lower=True), 4)
                heads = np.cumsum(sizes) - sizes
                least = np.zeros(len(sizes), np.uint64)
                least[sizes > 0] = shingles[heads[sizes > 0]]  # they are sorted
                least = np.where(sizes > 0, least, piece.column("h").to_numpy().view(np.uint64))  # texts without words are like themselves only
                columns = [piece.column(c) for c in ("id", "h", "text", "toxic")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(least.view(np.int64))], ["id", "h", "text", "toxic", "same"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                words, full, bare = bare_words(piece.column("text"))
                word, row = terms(words, bare, words.row_of_word()[full])
                order = np.lexsort((word, row))
                keep = order[common.heads_of(row[order], word[order])]
                poison = piece.column("toxic").to_numpy()
                unique, at = np.unique(word[keep], return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(unique.view(np.int64)), "docs": pa.array(np.bincount(at, minlength=len(unique))),
                    "toxic": pa.array(np.bincount(at, weights=poison[row[keep]], minlength=len(unique)).astype(np.int64)),
                })
                yield pa.RecordBatch.from_pydict({"word": pa.array([0]), "docs": pa.array([words.rows]), "toxic": pa.array([int(poison.sum())])})

    grouped = docs.join(chosen, "id").select("id", F.xxhash64("text").alias("h"), "text", "toxic").mapInArrow(group, "id long, h long, text string, toxic int, same long")
    texts = grouped.groupBy("same").agg(F.min_by(F.struct("text", "toxic"), F.struct("h", "id")).alias("one")).select("one.*")
    counts = common.stored(texts.select("text", "toxic").mapInArrow(task, "word long, docs long, toxic long").groupBy("word").agg(
        F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")
    ))
    head = counts.where("word = 0").first()
    if not head or not head["toxic"] or head["toxic"] == head["docs"]:
        return np.zeros(0, np.uint64)
    rate = head["toxic"] / head["docs"]
    several = counts.where("word <> 0 AND docs > 1").count()
    share = F.col("toxic") / F.col("docs")
    gain = F.col("toxic") * F.log(share / rate)
    known = counts.where("word <> 0").where((share >= 0.97) & (gain >= float(np.log(max(several, 1)) + 1))).orderBy(F.desc(gain), "word")
    return np.sort(np.array([r["word"] for r in known.select("word").collect()], np.int64).view(np.uint64))


def _gathered(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """The texts of the sample in one task, in order of their ids; all tasks look for them, and a shuffle stands between."""
    chosen = texts.join(F.broadcast(sample), "id").select("id", "text", "bad", "toxic")  # fit_rows narrow rows at most
    return chosen.repartition(1).sortWithinPartitions("id", "text").select("text", "bad", "toxic")


def fit(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_rows: int = LABEL_ROWS, fit_rows: int = FIT_ROWS
) -> QualityModel:
    """Fit on ``docs``; ``labels (doc_id, quality, toxic)`` are optional and may cover any part of them.

    The lexicon is learned from at most ``label_rows`` labelled rows, the scorer from at most ``fit_rows`` rows, those with
    the smallest hash of their id; votes are counted over all rows.
    Repeated labels of one document count by their mean; null labels say nothing. Rows without an id have no label.
    Without labels there is no lexicon, so nothing is toxic. Empty tables give a model that knows nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = None
    lexicon = np.zeros(0, np.uint64)
    if labels is not None:
        given = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
            F.round(F.avg("quality")).cast("int").alias("quality"), F.round(F.avg("toxic")).cast("int").alias("toxic")
        )
        lexicon = _lexicon(texts, given.where("toxic IS NOT NULL").select("id", "toxic"), label_rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SMALL_BYTES):
                votes, toxic, *_ = examine(piece.column("text"), lexicon)
                yield pa.RecordBatch.from_pydict({"id": piece.column("id"), "good": pa.array(_code(votes)), "clean": pa.array(_code(toxic))})

    votes = texts.mapInArrow(task, "id long, good long, clean long")
    if given is None:
        votes = votes.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    else:
        votes = votes.join(given, "id", "left")
    said = F.when(F.col("quality") > 0, 2).when(F.col("quality") <= 0, 0).otherwise(1)
    warned = F.when(F.col("toxic") > 0, 0).when(F.col("toxic") <= 0, 2).otherwise(1)
    votes = common.stored(votes.select(
        "id", (F.col("good") + said * 3 ** len(QUALITY)).alias("good"), (F.col("clean") + warned * 3 ** len(TOXIC)).alias("clean")
    ))
    posterior, speech = {}, {}
    for kind, labellers in (("good", QUALITY), ("clean", TOXIC)):
        rows = votes.groupBy(kind).count().collect()  # 3 ** (labellers + 1) rows at most
        code, count = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        bad, speech[kind] = expectation_maximisation(decode(code, len(labellers) + 1), count)
        posterior[kind] = common.small_table(spark, {kind: code, f"{kind}_bad": bad}, f"{kind} long, {kind}_bad double")
    sample = _smallest(votes.where("id IS NOT NULL"), fit_rows).join(posterior["good"], "good").join(posterior["clean"], "clean")
    sample = sample.select("id", F.col("good_bad").alias("bad"), F.col("clean_bad").alias("toxic"))
    chosen = _gathered(texts, sample)
    learn = lambda batches: _train(batches, lexicon)
    trained = chosen.mapInArrow(learn, "weights binary").collect()  # no row without documents
    weights = np.frombuffer(trained[0]["weights"], "<f4").reshape(BUCKETS, 2) if trained else np.zeros((BUCKETS, 2), np.float32)
    return QualityModel(lexicon, weights, speech)
