"""Best-two-fit packing of token sequences.

A document's tokens are cut, if too long, into pieces of at most ``capacity`` tokens; the first piece may be shorter.
A bin takes, largest first, whatever still fits (the greedy fill). Then its smallest piece gives way to two unpacked
pieces that fit the gap it leaves more tightly, as often as that fills the bin further.

Sizes are whole numbers up to ``capacity``, so bins that see the same sizes left are filled alike. The plan is made
from the number of pieces of each size (``capacity`` rows at most): a filling is repeated as often as all its sizes last,
which gives the same bins as filling them one by one. Pieces then find their place by their rank among pieces of their
size. A task ranks its own pieces while it cuts them, and one row per task and size carries the ranks on, so nothing
is sorted and no size is gathered.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm import common
from corpusloom.llm.words import slices

CAPACITY = 2048
KNOWN = 1 << 18
TEXT_BYTES = 1 << 21
AT_ONCE = 2048  # parts that the library encodes in one call
_RANKS = 40


class Encoder:
    """Token ids of texts by a file of the ``tokenizers`` library, as ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level tokenizer never joins letters with what stands before or behind them, but for a blank in front, so
    texts are cut there and each distinct part is encoded once. Texts that hold one of the tokenizer's added tokens,
    and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        parts = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        before = parts.get("pre_tokenizer") or {}
        self.by_parts = (
            parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and parts["model"]["type"] == "BPE"
        )
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, parts: pa.Array) -> list[list[int]]:
        """Ids of each part; letters with or without a blank in front are one word for the model."""
        text = parts.cast(pa.large_string())
        bare = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        word = pc.utf8_is_alpha(bare)
        bytes_of = lambda some: b"\xff".join(some.to_pylist())  # noqa: E731  a byte that UTF-8 never has
        words = bytes_of(parts.filter(word)).decode("latin-1").translate(self.letters).split("\xff")
        split, mixed = self.tokenizer.model.tokenize, iter(self.whole(text.filter(pc.invert(word)).to_pylist()))
        simple = iter(words)
        return [[t.id for t in split(next(simple))] if w else next(mixed) for w in word.to_pylist()]

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Numbers of the parts in ``known``."""
        if len(self.known) > KNOWN:
            self._forget()
        number = pc.index_in(parts, value_set=self.known)
        unknown = pc.is_null(number)
        new = parts.filter(unknown)
        number, unknown = pc.fill_null(number, 0).to_numpy().astype(np.int64), unknown.to_numpy(zero_copy_only=False)
        number[unknown] = len(self.known) + np.arange(len(new))
        if len(new):
            ids, sizes = [self.ids], []
            for start in range(0, len(new), AT_ONCE):  # the library's results weigh far more than their ids
                found = self._encode(new.slice(start, AT_ONCE))
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
            self.ids = np.concatenate(ids)
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes)))
            self.known = pa.concat_arrays([self.known, new])
        return number

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        if not self.by_parts:
            special[:] = True
        plain = column if not special.any() else pc.if_else(pa.array(special), pa.scalar("", pa.large_string()), column)
        ids, counts = self._in_parts(plain)
        if special.any():
            rows = np.split(ids, np.cumsum(counts)[:-1])
            at = np.flatnonzero(special)
            for i, own in zip(at, self.whole(column.take(pa.array(at)).to_pylist())):
                rows[i], counts[i] = np.array(own, np.uint32), len(own)
            ids = np.concatenate(rows)
        return ids, counts

    def _in_parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        if data is None or offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        heads = np.flatnonzero(part_heads(text, offsets))
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(heads), [None, pa.py_buffer(np.append(heads, len(text))), pa.py_buffer(np.ascontiguousarray(text))]
        ).dictionary_encode()
        number = self._learn(parts.dictionary)[parts.indices.to_numpy()]
        sizes = self.ends[number + 1] - self.ends[number]
        ends = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.ends[number] - ends[:-1], sizes) + np.arange(ends[-1])
        bounds = ends[np.searchsorted(heads, offsets)]
        return self.ids[at], np.diff(bounds)


def part_heads(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing their tokens: a mask of first bytes.

    Before a blank that follows a printable character, behind ASCII letters, and before ASCII letters that follow
    other ASCII characters than blanks and apostrophes; of line ends and tabs only single ones. Two-byte characters
    from U+00C0 on hold no white space.
    """
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    solid = np.zeros(256, bool)
    solid[33:127] = True
    opening = solid & ~letter
    opening[39] = False
    two = np.zeros(256, bool)
    two[0xC3:0xE0] = True
    heads = np.zeros(len(text) + 1, bool)
    a, b = text[:-1], text[1:]
    printable = solid[a]
    printable[1:] |= two[text[:-2]] & (a[1:] >= 0x80)
    single = np.isin(a, (9, 10))
    single[1:] &= solid[text[:-2]]
    single[:1] = False
    heads[1:-1] = (b == 32) & printable | letter[a] & ~letter[b] & (b < 128) | letter[b] & (opening[a] | single)
    heads[offsets[:-1]] = True
    return heads[: len(text)]


def best_pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two sizes with the largest sum up to ``room``, of them the pair with the largest member; zeros if none."""
    sizes = np.arange(min(room, len(left) - 1) + 1)
    here = left[sizes] > 0
    here[0] = False
    below = np.maximum.accumulate(np.where(here, sizes, 0))  # the largest size there is up to each
    large = sizes[here]
    small = below[np.minimum(large, room - large)]
    alone = (small == large) & (left[large] < 2)
    small = np.where(alone, below[large - 1], small)
    if not (small > 0).any():
        return 0, 0
    total = np.where(small > 0, small + large, 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return int(small[best]), int(large[best])


def fill(left: np.ndarray, capacity: int) -> Counter:
    """Sizes of the next bin; ``left`` counts the pieces of each size and is used up."""
    chosen, gap = Counter(), capacity
    while True:
        sizes = np.flatnonzero(left[: gap + 1])
        at = bisect_right(sizes, gap) - 1
        while at >= 0 and gap > 0:
            size = int(sizes[at])
            take = min(int(left[size]), gap // size)
            if take:
                chosen[size] += take
                left[size] -= take
                gap -= take * size
            at = min(at, bisect_right(sizes, gap)) - 1
        if not gap or chosen.total() < 2:
            return chosen
        least = min(chosen)
        a, b = best_pair(left, gap + least)
        if a + b <= least:
            return chosen
        chosen[least] -= 1
        left[least] += 1
        chosen += Counter()  # drops sizes that are used no more
        for size in (a, b):
            chosen[size] += 1
            left[size] -= 1
        gap += least - a - b


def best_two_fit(counts: np.ndarray, capacity: int) -> Iterator[tuple[Counter, int]]:
    """Fillings and how many bins have them, until no piece is left."""
    left = counts.copy()
    left[0] = 0
    while left.any():
        chosen = fill(left, capacity)
        again = min(int(left[size]) // n for size, n in chosen.items())
        for size, n in chosen.items():
            left[size] -= again * n
        yield chosen, again + 1


@dataclass
class Packing:
    """``pieces`` has the documents' id, row, piece, start, length, ids, and ``part`` and ``local`` for placing.

    Ids are little-endian unsigned 32-bit numbers, one after the other.
    """

    pieces: DataFrame
    offsets: DataFrame
    plan: np.ndarray
    n_sequences: int

    def place(self, pieces: DataFrame) -> DataFrame:
        """``pieces``, whole or some of its columns, with ``sequence_id`` and ``offset`` in place of ``part`` and ``local``."""
        plan = self.plan

        @F.arrow_udf("sequence_id long, offset long")
        def find(length: pa.Array, rank: pa.Array) -> pa.Array:
            length, rank = length.to_numpy(), rank.to_numpy()
            at = np.searchsorted(plan["key"], (length << _RANKS) | rank, "right") - 1
            step = rank - (plan["key"][at] & ((1 << _RANKS) - 1))
            sequence, slot = np.divmod(step, plan["times"][at])
            places = [pa.array(plan["sequence"][at] + sequence), pa.array(plan["offset"][at] + slot * length)]
            return pa.StructArray.from_arrays(places, ["sequence_id", "offset"])

        found = pieces.join(self.offsets, ["part", "length"]).withColumn("__place", find("length", F.col("local") + F.col("before")))
        return found.select(*[c for c in pieces.columns if c not in ("part", "local")], "__place.*")

    def sequences(self) -> DataFrame:
        """``(sequence_id, ids)``: the packed sequences."""
        placed = self.place(self.pieces.select("length", "part", "local", "ids"))
        whole = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
        return whole.select("sequence_id", F.aggregate("held.ids", F.lit(b""), lambda all_, ids: F.concat(all_, ids)).alias("ids"))


def _cut(path: str, text_col: str, keep: list[str], capacity: int, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path), np.zeros(capacity + 1, np.int64)
        part, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, text_col, TEXT_BYTES):
                ids, counts = encoder(piece.column(text_col))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                counts = counts + 1
                cuts = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), cuts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first = (counts - (cuts - 1) * capacity)[owner]
                length = np.where(number > 0, capacity, first)
                start = np.where(number > 0, first + (number - 1) * capacity, 0)
                order = np.argsort(length, kind="stable")
                heads = common.heads_of(length[order])
                local = np.empty(len(order), np.int64)
                local[order] = np.arange(len(order)) - heads[common.run_of(heads, len(order))]
                local += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = 4 * np.append(0, np.cumsum(length)).astype(np.int32)
                arrays = [piece.column(c).take(pa.array(owner)) for c in keep]
                arrays += [pa.array(a) for a in (owner + rows + (part << 40), number.astype(np.int32), start, length, np.full(len(owner), part, np.int64), local)]
                arrays.append(pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "row", "piece", "start", "length", "part", "local", "ids"])
                rows += piece.num_rows

    return task


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0
) -> Packing:
    """Pack the tokens of all documents, ``end_id`` behind each, into sequences of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library, the same on all machines. Null texts are empty
    and have the end alone. Every row of ``docs`` is a document of its own, also where ids are null or repeated;
    ``row`` tells them apart. Only the id and the text are read, so other columns cannot clash. An empty table
    gives empty frames. The plan, which travels with the tasks, has some rows for each size, not for each document.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, row long, piece int, start long, length long, part long, local long, ids binary"
    pieces = common.stored(docs.select(id_col, text_col).mapInArrow(_cut(tokenizer, text_col, [id_col], capacity, end_id), schema))
    of_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per size
        counts[row["length"]] = row["count"]
    rows, taken, base = [], np.zeros(capacity + 1, np.int64), 0
    for chosen, bins in best_two_fit(counts, capacity):
        offset = 0
        for size, times in sorted(chosen.items(), reverse=True):
            rows.append(((size << _RANKS) | int(taken[size]), base, times, offset))
            taken[size] += times * bins
            offset += times * size
        base += bins
    plan = np.array(sorted(rows), [(c, np.int64) for c in ("key", "sequence", "times", "offset")])
    return Packing(pieces, offsets, plan, base)
