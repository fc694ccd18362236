"""Hierarchical regex counting with thousands of patterns: one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.automaton import BREAK, FOLDED, Automaton, apart, compiled, literals
from corpusloom.operators.matchcount import _dictionary_rows, node_leaves

PIECE_BYTES = 1 << 19


class _Counter:
    """Counts of all patterns in slices of texts."""

    def __init__(self, patterns: list[tuple[str, bool]]):
        self.patterns = [compiled(*p) for p in patterns]
        self.everywhere, self.plain = [], {}  # patterns without a literal; plain strings by word
        owners: dict[str, list[int]] = {}
        for number, (pattern, case_sensitive) in enumerate(patterns):
            found = literals(pattern)
            if found is None:
                self.everywhere.append(number)
                continue
            words, pure = found
            if pure and not case_sensitive:
                self.plain.setdefault(words[0], []).append(number)
            else:
                for word in words:
                    owners.setdefault(word, []).append(number)
        self.words = sorted({*owners, *self.plain})
        self.owners = [owners.get(w, []) for w in self.words]
        self.counted = [self.plain.get(w, []) for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.automaton = Automaton(self.words)

    def __call__(self, texts: pa.Array) -> list[dict[int, int]]:
        """Per text the patterns that match and how often."""
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        folded = texts
        for letter, plain in FOLDED.items():
            folded = pc.replace_substring(folded, letter, plain)
        folded = pc.utf8_lower(folded)
        offsets = np.frombuffer(folded.buffers()[1], np.int64)[folded.offset : folded.offset + len(folded) + 1]
        data = folded.buffers()[2]
        text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        joined = np.insert(text, ends, BREAK)
        place, word = self.automaton.find(joined) if self.words else (ends[:0], ends[:0])
        row = np.searchsorted(ends + np.arange(1, len(ends) + 1), place, "left")
        order = np.lexsort((place, row, word))
        place, word, row = place[order], word[order], row[order]
        kept = apart(word, row, place, self.lengths)
        pairs, of = np.unique(np.stack([row, word]), axis=1, return_inverse=True)
        times = np.bincount(of.reshape(-1), weights=kept, minlength=pairs.shape[1]).astype(np.int64)
        check: set[tuple[int, int]] = set()
        for r, w, n in zip(*pairs.tolist(), times.tolist()):
            for p in self.counted[w]:
                out[r][p] = n
            check.update((r, p) for p in self.owners[w])
        check.update((r, p) for r in range(len(out)) for p in self.everywhere)
        plain = texts.to_pylist() if check else []
        for r, p in check:
            n = sum(1 for _ in self.patterns[p].finditer(plain[r]))
            if n:
                out[r][p] = n
        return out


def match_counts(
    df: DataFrame, col: str, dictionary: DataFrame | Sequence[dict], level_cols: Sequence[str], regex_col: str, case_col: str | None = None, out: str = "matches"
) -> DataFrame:
    """Add a ``map<string, bigint>`` of the dictionary's nodes and their matches, without nodes that have none.

    The numbers are those of :func:`match_counter`, in a form that suits thousands of nodes: each text is read once by an
    automaton over the patterns' literals, and a regex runs only on texts that hold one of its literals. Patterns that are
    plain strings need no regex; patterns without a literal run on every text. Narrow; null and empty texts have an
    empty map but for patterns that match nothing at all. An existing column ``out`` is refused.
    """
    if out in df.columns:
        raise ValueError(f"columns exist already: {[out]}")
    rows = _dictionary_rows(dictionary, level_cols, regex_col, case_col)
    paths = list(dict.fromkeys(path for path, _, _ in rows))
    nodes_of: dict[tuple, list[str]] = {path: [] for path in paths}
    for node, leaves in node_leaves(paths).items():
        for path in leaves:
            nodes_of[path].append(node)
    names = [nodes_of[path] for path, _, _ in rows]
    patterns = [(regex, case) for _, regex, case in rows]

    @F.arrow_udf("map<string,bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _Counter(patterns)
        for texts in batches:
            yield _matches(counter, names, texts)

    return df.withColumn(out, F.when(F.col(col).isNotNull(), count(F.col(col))).otherwise(F.create_map().cast("map<string,bigint>")))


def _matches(counter, names: list[list[str]], texts: pa.Array) -> pa.Array:
    """Per text a map of the nodes that have matches; counts are Python objects only for a piece of the texts."""
    kind = pa.map_(pa.string(), pa.int64())
    made = [pa.array([], kind)]
    for piece in pieces(texts, PIECE_BYTES):
        found = []
        for counts in counter(piece):
            nodes: dict[str, int] = {}
            for p, n in counts.items():
                for node in names[p]:
                    nodes[node] = nodes.get(node, 0) + n
            found.append(sorted(nodes.items()))
        made.append(pa.array(found, kind))
    return pa.concat_arrays(made)


def pieces(texts: pa.Array, n_bytes: int, n_rows: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of about ``n_bytes`` and at most ``n_rows``; a longer text is one of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = total[at - 1] if at else 0
        to = max(at + 1, min(at + n_rows, int(np.searchsorted(total, done + n_bytes, "right"))))
        yield texts.slice(at, to - at)
        at = to
