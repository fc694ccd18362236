"""Language-model scores: a smoothed unigram base and a log-bilinear model trained with noise-contrastive estimation.

Words are counted over all training documents. The ``HEAVY`` most frequent ones travel with the tasks; what a
document has beyond them joins the counts by word, once per document and word.

The neural model is a hierarchical one over all words of the training documents. It predicts a token's class from the
``CONTEXT`` tokens before it, and the word from its class and these tokens. Each of the ``TOP`` most frequent words is a
class of its own; other words are classed by their last byte and, where a class has more than ``CLASS_TOKENS`` tokens,
by the first bits of their hash. Inside a class each word is a leaf of a binary tree that follows the words' smoothed
counts, with a vector and a bias for each fork; one unseen word per class takes the rest. So P(token) =
P(class | context) * P(word | class, context) adds up to one. A context word's vector is that of its class, for a word
beyond the most frequent plus those of two codes of its hash; codes grow with the root of the number of words, so that pairs
of codes outnumber the words. The context's vectors, each scaled by a position vector, add up to a prediction whose
products with the class or fork vectors, plus biases, are the scores.

Classes are trained with noise-contrastive estimation. Documents are dealt by hash into blocks of about ``BLOCK_TOKENS``
tokens, whatever the input's files and partitions; each block is trained on in numpy in the order of the hashes, with
noise classes shared by a batch, and the parameters are averaged by tokens. Then the tokens of each class meet in one
task, which trains the class's forks on those of the training documents, in the order of the hashes, and scores all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import common
from corpusloom.llm.words import Hasher, Words, slices

HEAVY, TOP, ENDINGS = 65536, 512, 32
CONTEXT, WIDTH, NOISE, BATCH, STEP = 3, 16, 24, 1024, 0.05
ALPHA = 0.1
END = np.uint64(0x5EED)
FLUSH_WORDS = 1 << 20
BLOCK_TOKENS, CLASS_TOKENS = 1 << 21, 1 << 20
PACK_TOKENS = 1 << 20  # that a task holds before it hands them over by class
CHUNK = 1 << 12
CLASSES = TOP + ENDINGS


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, last byte and row of every token, and the tokens per row; each row closes with END."""
    words = Words(column)
    hashes = Hasher(lower=True).words(words.text, words.start, words.end)
    last = words.text[words.end - 1] if len(hashes) else np.zeros(0, np.uint8)
    at = words.bounds[1:]
    row = np.insert(words.row_of_word(), at, np.arange(words.rows))
    return np.insert(hashes, at, END), np.insert(last, at, 0), row, words.counts + 1


def ending(last: np.ndarray) -> np.ndarray:
    return TOP + (last % ENDINGS).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def flush():
        word, last, count = (np.concatenate(c) for c in zip(*held))
        unique, first, at = np.unique(word, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=count, minlength=len(unique)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(ending(last[first])), pa.array(total)], ["word", "ending", "n"])

    for batch in batches:
        for piece in slices(batch, "text"):
            word, last, row, _ = tokens(piece.column("text"))
            learn = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[row]
            unique, first, count = np.unique(word[learn], return_index=True, return_counts=True)
            held.append((unique, last[learn][first], count))
            rows += len(unique)
            if rows >= FLUSH_WORDS:
                yield flush()
                held, rows = [], 0
    if held:
        yield flush()


class Vocabulary:
    """Heavy words with their counts, which of them are classes, and the class sizes. Its size is fixed."""

    def __init__(self, counts: DataFrame):
        step = F.floor(F.log2("n") * 8)
        summary = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
        summary.sort(key=lambda r: -r["step"])  # a few hundred rows
        self.total = sum(r["tokens"] for r in summary)
        self.distinct = sum(r["words"] for r in summary)
        kept, least = 0, None
        for r in summary:
            if kept + r["words"] > HEAVY:
                break
            kept, least = kept + r["words"], r["step"]
        rows = counts.where(step >= least).collect() if least is not None else []  # HEAVY rows at most
        rows.sort(key=lambda r: (r["word"] != int(END), -r["n"], r["word"]))
        rank = {r["word"]: i for i, r in enumerate(rows[:TOP])}
        by_hash = sorted(rows, key=lambda r: r["word"] % (1 << 64))
        self.words = np.array([r["word"] for r in by_hash], np.int64).view(np.uint64)
        self.counts = np.array([r["n"] for r in by_hash], float)
        self.top = np.array([rank.get(r["word"], -1) for r in by_hash], np.int64)
        self.sizes = np.full(CLASSES, ALPHA)  # of the classes by ending: smoothed counts of their words
        for r in counts.groupBy("ending").agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect():
            self.sizes[r["ending"]] += r["tokens"] + ALPHA * r["words"]
        for r in rows[:TOP]:
            self.sizes[r["ending"]] -= r["n"] + ALPHA
        # Classes by ending that hold too many tokens are split by the first bits of the hash.
        self.bits = np.ceil(np.log2(np.maximum(self.sizes[TOP:] / CLASS_TOKENS, 1.0))).astype(np.uint64)
        self.offset = TOP + np.cumsum(1 << self.bits.astype(np.int64)) - (1 << self.bits.astype(np.int64))
        if self.bits.any():
            self._split(counts, rows[:TOP])
        self.codes = 1 << math.ceil(math.log2(4 * math.sqrt(self.distinct + 1)))
        unigram = np.full(len(self.sizes), 1.0)
        unigram[TOP:] += self.sizes[TOP:]
        for r in rows[:TOP]:
            unigram[rank[r["word"]]] += r["n"]
        self.unigram = unigram / unigram.sum()

    def _split(self, counts: DataFrame, top: list) -> None:
        most = int(self.bits.max())
        sizes = np.full(self.offset[-1] + (1 << int(self.bits[-1])), ALPHA)
        prefix = F.shiftrightunsigned("word", 64 - most)
        for r in counts.groupBy("ending", prefix.alias("prefix")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect():
            e = r["ending"] - TOP
            sizes[self.offset[e] + (r["prefix"] >> (most - int(self.bits[e])))] += r["tokens"] + ALPHA * r["words"]
        for r in top:
            e = r["ending"] - TOP
            sizes[self.offset[e] + ((r["word"] % (1 << 64)) >> (64 - int(self.bits[e])))] -= r["n"] + ALPHA
        self.sizes = sizes

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is heavy, and its place among the heavy words."""
        if not len(self.words):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        place = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return self.words[place] == word, place

    def classes(self, last: np.ndarray, heavy: np.ndarray, place: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        """The class of each token; their hashes ``word`` are needed where endings are split."""
        end = ending(last) - TOP
        out = self.offset[end]
        if self.bits.any():
            out = out + ((word >> np.uint64(32)) >> (np.uint64(32) - self.bits[end])).astype(np.int64)
        if len(self.words):
            top = np.where(heavy, self.top[place], -1)
            out = np.where(top >= 0, top, out)
        return out


    def coded(self, word: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Two codes of each word that shares its class; ``codes`` stands for none."""
        low = np.stack([word, word >> np.uint64(24)], axis=1) & np.uint64(self.codes - 1)
        return np.where(classes[:, None] >= TOP, low.astype(np.int64), self.codes)


def contexts(classes: np.ndarray, row: np.ndarray, per_row: np.ndarray, start: int = CLASSES) -> np.ndarray:
    """Classes, or other numbers, of the CONTEXT tokens before each token; before a text stands the number ``start``."""
    place = np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row]
    out = np.full((len(row), CONTEXT), start, np.int64)
    for j in range(CONTEXT):
        inside = place > j
        out[inside, j] = classes[np.flatnonzero(inside) - j - 1]
    return out


def _added(total: np.ndarray, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Add rows of ``values`` to those of ``total`` that ``index`` names; which these are."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    heads = common.heads_of(index)
    total[index[heads]] += np.add.reduceat(values[order], heads, axis=0)
    return index[heads]


class LogBilinear:
    def __init__(self, unigram: np.ndarray, flat: np.ndarray | None = None, codes: int = 0):
        draw = np.random.Generator(np.random.PCG64(11))
        self.context = draw.normal(0, 0.1, (len(unigram) + 1, WIDTH)).astype(np.float32)
        self.position = np.ones((CONTEXT, WIDTH), np.float32)
        self.target = draw.normal(0, 0.1, (len(unigram), WIDTH)).astype(np.float32)
        self.bias = np.log(unigram).astype(np.float32)
        self.code = np.zeros((codes + 1, WIDTH), np.float32)  # the last stays zero
        if flat is not None:
            at = 0
            for part in self.parts() if codes else self.parts()[:4]:
                part[...] = flat[at : at + part.size].reshape(part.shape)
                at += part.size

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.position, self.target, self.bias, self.code]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    def _own(self, context: np.ndarray, codes: np.ndarray | None, j: int) -> np.ndarray:
        own = self.context[context[:, j]]
        return own if codes is None else own + self.code[codes[:, j, 0]] + self.code[codes[:, j, 1]]

    def predict(self, context: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        out = self._own(context, codes, 0) * self.position[0]
        for j in range(1, CONTEXT):
            out += self._own(context, codes, j) * self.position[j]
        return out

    def train(self, context: np.ndarray, goal: np.ndarray, noise: np.ndarray, unigram: np.ndarray, seen: list[np.ndarray], codes: np.ndarray | None = None) -> None:
        """One step of noise-contrastive estimation on a batch; ``seen`` are Adagrad's sums."""
        guess = self.predict(context, codes)
        offset = np.log(len(noise) * unigram).astype(np.float32)
        true = 1 - 1 / (1 + np.exp(-np.clip((guess * self.target[goal]).sum(1) + self.bias[goal] - offset[goal], -20, 20)))
        false = -1 / (1 + np.exp(-np.clip(guess @ self.target[noise].T + self.bias[noise] - offset[noise], -20, 20)))
        slope = true[:, None] * self.target[goal] + false @ self.target[noise]
        grads = [np.zeros_like(p) for p in self.parts()[:4]]
        _added(grads[2], goal, true[:, None] * guess)
        grads[3] += np.bincount(goal, weights=true, minlength=len(unigram)).astype(np.float32)
        np.add.at(grads[2], noise, false.T @ guess)
        np.add.at(grads[3], noise, false.sum(0))
        parts = []
        for j in range(CONTEXT):
            grads[1][j] = (slope * self._own(context, codes, j)).sum(0)
            parts.append(slope * self.position[j])
        _added(grads[0], context.T.reshape(-1), np.concatenate(parts))
        if codes is not None:
            coded = np.flatnonzero(codes[:, :, 0].T.reshape(-1) < len(self.code) - 1)
            both = codes.transpose(1, 0, 2).reshape(-1, 2)[coded].T.reshape(-1)
            if len(both):
                rows, at = np.unique(both, return_inverse=True)
                grad = np.zeros((len(rows), WIDTH), np.float32)
                _added(grad, at, np.tile(np.concatenate(parts)[coded], (2, 1)))
                grad /= len(goal)
                seen[4][rows] += grad**2
                self.code[rows] += STEP * grad / np.sqrt(seen[4][rows])
        for value, grad, total in zip(self.parts(), grads, seen):
            grad /= len(goal)
            total += grad**2
            value += STEP * grad / np.sqrt(total)

    def log10(self, context: np.ndarray, goal: np.ndarray, codes: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
        """Normalised log10 probability of each class given its context."""
        out = np.empty(len(goal))
        target = np.ascontiguousarray(np.hstack([self.target, self.bias[:, None]]).T)
        for a in range(0, len(goal), block):
            guess = self.predict(context[a : a + block], None if codes is None else codes[a : a + block])
            scores = np.hstack([guess, np.ones((len(guess), 1), np.float32)]) @ target
            own = scores[np.arange(len(scores)), goal[a : a + block]]
            most = scores.max(1)
            scores -= most[:, None]
            out[a : a + block] = own - most - np.log(np.exp(scores, out=scores).sum(1))
        return out / np.log(10)


class Tree:
    """The words of one class as leaves of a binary tree by their weights, in the order given, and the way to each: forks and sides."""

    def __init__(self, weight: np.ndarray):
        self.width = len(weight)
        total = np.cumsum(weight)
        code = ((total - weight / 2) / total[-1] * 2.0**48).astype(np.int64)
        code = np.maximum.accumulate(code - np.arange(len(code))) + np.arange(len(code))  # no two alike
        leaf, ways, bias, forks = np.arange(len(code)), [], [], 0
        for level in range(49, -1, -1):  # leaves that share the bits above this one
            side = (code[leaf] >> level & 1).astype(bool)
            head = common.heads_of(code[leaf] >> (level + 1))
            run = common.run_of(head, len(leaf))
            split = np.maximum.reduceat(side, head) & ~np.minimum.reduceat(side, head)
            both, right = (np.bincount(run, weights=weight[leaf] * w) for w in (1.0, side))
            bias.append(np.log(right[split] / (both - right)[split]))
            at = split[run]
            ways.append((leaf[at], (np.cumsum(split) - 1 + forks)[run[at]], side[at]))
            forks += np.count_nonzero(split)
            head = common.heads_of(code[leaf] >> level)
            leaf = leaf[np.repeat(np.diff(np.append(head, len(leaf))) > 1, np.diff(np.append(head, len(leaf))))]
            if not len(leaf):
                break
        of, fork, side = (np.concatenate(c) for c in zip(*ways))
        order = np.argsort(of, kind="stable")
        self.fork, self.side = fork[order], side[order]
        self.heads = np.searchsorted(of[order], np.arange(self.width + 1))
        self.vec = np.zeros((forks, WIDTH), np.float32)
        self.bias = np.concatenate(bias).astype(np.float32)
        self.seen = np.full((forks, WIDTH + 1), 1e-1, np.float32)

    def _ways(self, leaf: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each fork on the ways to the leaves: which of them, the fork, the side as 1 or -1, and the score of the right side."""
        many = self.heads[leaf + 1] - self.heads[leaf]
        of = np.repeat(np.arange(len(leaf)), many)
        at = np.arange(len(of)) + np.repeat(self.heads[leaf] - (np.cumsum(many) - many), many)
        fork = self.fork[at]
        return of, fork, np.where(self.side[at], np.float32(1), np.float32(-1)), np.einsum("ij,ij->i", self.vec[fork], guess[of]) + self.bias[fork]

    def train(self, leaf: np.ndarray, guess: np.ndarray) -> None:
        """One step of logistic regression at every fork on the ways, with Adagrad."""
        of, fork, side, score = self._ways(leaf, guess)
        if not len(of):
            return
        slope = side / (1 + np.exp(np.clip(side * score, -30, 30)))
        rows, at = np.unique(fork, return_inverse=True)
        grad = np.zeros((len(rows), WIDTH + 1), np.float32)
        _added(grad, at, np.hstack([slope[:, None] * guess[of], slope[:, None]]))
        self.seen[rows] += grad**2
        grad *= STEP / np.sqrt(self.seen[rows])
        self.vec[rows] += grad[:, :-1]
        self.bias[rows] += grad[:, -1]

    def log10(self, leaf: np.ndarray, guess: np.ndarray) -> np.ndarray:
        of, _, side, score = self._ways(leaf, guess)
        return np.bincount(of, weights=-np.logaddexp(0, -side * score), minlength=len(leaf)) / np.log(10)


def _read(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Hash, class, classes and codes of the context, and row of every token, and the tokens per row."""
    word, last, row, per_row = tokens(texts)
    classes = vocabulary.classes(last, *vocabulary.find(word), word)
    coded = vocabulary.coded(word, classes)
    codes = np.stack([contexts(coded[:, i], row, per_row, vocabulary.codes) for i in (0, 1)], axis=2)
    return word, classes, contexts(classes, row, per_row, len(vocabulary.unigram)), codes, row, per_row


def _train(vocabulary: Vocabulary, start: np.ndarray | None):
    def block(table: pa.Table) -> pa.Table:
        """One block of training documents to parameters."""
        model = LogBilinear(vocabulary.unigram, start, vocabulary.codes)
        seen = [np.full_like(p, 1e-4) for p in model.parts()]
        draw = np.random.Generator(np.random.PCG64(5))
        chances = np.cumsum(vocabulary.unigram)
        done = 0
        for batch in table.sort_by("h").select(["text"]).combine_chunks().to_batches(max_chunksize=4096):
            for piece in slices(batch, "text"):
                word, classes, context, codes, row, _ = _read(vocabulary, piece.column("text"))
                use = draw.permutation(len(row))
                for a in range(0, len(use), BATCH):
                    at = use[a : a + BATCH]
                    noise = np.minimum(np.searchsorted(chances, draw.random(NOISE)), len(chances) - 1)
                    model.train(context[at], classes[at], noise, vocabulary.unigram, seen, codes[at])
                done += len(use)
        return pa.table({"tokens": pa.array([done]), "flat": pa.array([model.flat().astype(float)], pa.list_(pa.float64()))})

    return block


_SCORED = "doc long, row long, n_tokens long, known long, h long, shared long, base double, model double, words array<long>, times array<int>"


def _score(vocabulary: Vocabulary, flat: np.ndarray | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LogBilinear(vocabulary.unigram, flat, vocabulary.codes)
        denominator = np.log10(vocabulary.total + ALPHA * (vocabulary.distinct + 1))
        log_counts = np.log10(vocabulary.counts + ALPHA)
        for batch in batches:
            for piece in slices(batch, "text"):
                n = piece.num_rows
                word, classes, context, codes, row, per_row = _read(vocabulary, piece.column("text"))
                heavy, place = vocabulary.find(word)
                own = np.where(heavy, log_counts[place], 0.0) if len(log_counts) else np.zeros(len(word))
                base = np.bincount(row, weights=own - denominator, minlength=n)
                total = np.bincount(row, weights=model.log10(context, classes, codes), minlength=n)
                rest, of = word[~heavy], row[~heavy]
                order = np.lexsort((rest, of))
                rest, of = rest[order], of[order]
                heads = common.heads_of(of, rest)
                times = np.diff(np.append(heads, len(rest))).astype(np.int32)
                offsets = pa.array(np.searchsorted(of[heads], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc": piece.column("doc"), "row": piece.column("row"), "n_tokens": pa.array(per_row),
                    "known": pa.array(np.bincount(row[heavy], minlength=n)), "h": piece.column("h"),
                    "shared": pa.array(np.bincount(row[classes >= TOP], minlength=n)), "base": pa.array(base), "model": pa.array(total),
                    "words": pa.ListArray.from_arrays(offsets, pa.array(rest[heads].view(np.int64))),
                    "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
                })

    return task


def _by_class(vocabulary: Vocabulary):
    """Tokens that share their class, packed by class: hashes, numbers of the context, and the document of each."""
    kind = np.int16 if max(len(vocabulary.unigram), vocabulary.codes) < 1 << 15 else np.int32

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        classes, *columns = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(classes, kind="stable")
        classes = classes[order]
        heads = common.heads_of(classes)
        parts = [np.split(c[order], heads[1:]) for c in columns]
        arrays = [pa.array(classes[heads]), *(pa.array([v.tobytes() for v in p], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(arrays, ["class", "word", "context", "h", "learn"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                word, classes, context, codes, row, _ = _read(vocabulary, piece.column("text"))
                at = np.flatnonzero(classes >= TOP)
                if not len(at):
                    continue
                learn = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                numbers = np.concatenate([context[at][:, :, None], codes[at]], axis=2).astype(kind)
                held.append((classes[at], word[at], numbers, piece.column("h").to_numpy()[row[at]], learn[row[at]]))
                size += len(at)
                if size >= PACK_TOKENS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return task


def _in_class(vocabulary: Vocabulary, flat: np.ndarray | None):
    kind = np.int16 if max(len(vocabulary.unigram), vocabulary.codes) < 1 << 15 else np.int32

    def task(table: pa.Table) -> pa.Table:
        """All tokens of a class to the sum of log10 P(word | class, context) of each document."""
        whole = lambda name, of: np.concatenate([np.frombuffer(v.as_buffer(), of) for v in table.column(name)])
        h = whole("h", np.int64)
        order = np.argsort(h, kind="stable")
        h, learn, word = h[order], whole("learn", bool)[order], whole("word", np.uint64)[order]
        numbers = whole("context", kind).reshape(-1, CONTEXT, 3)[order]
        model = LogBilinear(vocabulary.unigram, flat, vocabulary.codes)
        guess = lambda at: model.predict(numbers[at, :, 0], numbers[at, :, 1:])
        known, leaf, count = np.unique(word[learn], return_inverse=True, return_counts=True)
        tree = Tree(np.append(count + ALPHA, ALPHA))  # the last leaf is the unseen word
        draw, learned = np.random.Generator(np.random.PCG64(7)), np.flatnonzero(learn)
        use = draw.permutation(len(learned))
        for a in range(0, len(use), BATCH):
            at = use[a : a + BATCH]
            tree.train(leaf[at], guess(learned[at]))
        place = np.searchsorted(known, word)
        leaf = np.where(np.append(known, np.uint64(0))[place] == word, place, len(known))
        leaf[place == len(known)] = len(known)
        heads = common.heads_of(h)
        parts = [np.arange(a, min(a + 8 * BATCH, len(h))) for a in range(0, len(h), 8 * BATCH)]
        sums = np.add.reduceat(np.concatenate([tree.log10(leaf[at], guess(at)) for at in parts]), heads)
        return pa.table({"h": h[heads], "inside": sums, "n": np.diff(np.append(heads, len(h)))})

    return task


def _averaged(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("block", "ascending")])
    weight = table.column("tokens").to_numpy()
    values = table.column("part").combine_chunks().flatten().to_numpy().reshape(len(weight), -1)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([weight @ values / weight.sum()], pa.list_(pa.float64()))})


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Held out of all learning are documents whose crc32 of the id as text is divisible by 10; rows without an id are
    not. A text's tokens are its words with A-Z lower-cased and one end. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over them, ``score`` is the model's log10 probability of the text, of all its words,
    ``n_known`` counts tokens seen in training. Null and empty texts consist of their end. Extra columns are not
    read. Words are told apart by 64-bit hashes. An empty table gives an empty one.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    texts = docs.select(
        common.doc_key(id_col).alias("doc"), held.alias("held_out"), F.col(text_col).alias("text")
    ).withColumn("h", F.xxhash64("doc", "text"))
    counts = common.stored(
        texts.select("held_out", "text").mapInArrow(_count, "word long, ending long, n long")
        .groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    )
    vocabulary = Vocabulary(counts)
    flat = None
    blocks = max(1, -(-vocabulary.total // BLOCK_TOKENS))
    learn = texts.where("NOT held_out").select("h", "text")
    for _ in range(rounds):
        dealt = learn.withColumn("block", F.pmod("h", F.lit(blocks)))
        trained = dealt.groupBy("block").applyInArrow(_train(vocabulary, flat), "tokens long, flat array<double>")
        trained = common.stored(trained.withColumn("block", F.xxhash64("flat")))
        size = trained.agg(F.max(F.size("flat"))).first()[0]
        if size:
            chunks = F.explode(F.sequence(F.lit(0), F.lit((size - 1) // CHUNK)))
            cut = trained.select("block", "tokens", "flat", chunks.alias("chunk")).select("block", "tokens", "chunk", F.slice("flat", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("part"))
            parts = cut.groupBy("chunk").applyInArrow(_averaged, "chunk int, part array<double>").orderBy("chunk").toArrow()
            flat = parts.column("part").combine_chunks().flatten().to_numpy()  # the parameters
    # Once stored, a row keeps its number.
    scored = common.stored(texts.drop("held_out").withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(vocabulary, flat), _SCORED))
    pairs = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = pairs.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("sum"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"),
    )
    extra = F.coalesce(F.col("sum"), F.lit(0.0))
    packs = texts.select("held_out", "h", "text").mapInArrow(_by_class(vocabulary), "class long, word binary, context binary, h binary, learn binary")
    inside = packs.groupBy("class").applyInArrow(_in_class(vocabulary, flat), "h long, inside double, n long")
    inside = common.stored(inside.groupBy("h").agg(F.sum("inside").alias("inside"), F.sum("n").alias("n")))
    # Equal rows share h and have the same words.
    within = F.coalesce(F.col("inside") * F.col("shared") / F.col("n"), F.lit(0.0))
    joined = scored.drop("words", "times").join(found, "row", "left").join(inside, "h", "left")
    doc = F.nullif(F.col("doc"), F.lit(common.LAST_ID))
    return joined.select(
        doc.alias("doc_id"), F.coalesce(F.crc32(doc.cast("string")) % 10 == 0, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + within).alias("score"),
    )
