"""Hierarchical regex counting: one count column per node of a keyword dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.patterns import java_regex, match_count, sql_literal, validate

Path = tuple[str, ...]


def match_counter(
    df: DataFrame,
    col: str,
    dictionary: DataFrame | Sequence[dict],
    level_cols: Sequence[str],
    regex_col: str,
    case_col: str | None = None,
) -> DataFrame:
    """Add a ``bigint`` column per node: its own matches for a leaf, the sum of its children above.

    ``dictionary`` has one row per regex with the node names from the outermost level in; without
    ``case_col`` matching ignores case. Nodes of one name on one level are added up under that name.
    Narrow: patterns are literals in the plan, compiled once per task.
    """
    rows = _dictionary_rows(dictionary, level_cols, regex_col, case_col)
    leaves: dict[Path, list[tuple[str, bool]]] = {}
    for path, regex, case_sensitive in rows:
        leaves.setdefault(path, []).append((regex, case_sensitive))
    nodes = node_leaves(list(leaves))

    clashes = [n for n in nodes if n in df.columns]
    if clashes:
        raise ValueError(f"columns exist already: {clashes}")

    # Written as SQL text: a long dictionary is parsed in one go instead of being put together call by call.
    names = {path: f"__leaf_{i}" for i, path in enumerate(leaves)}
    as_sql, as_columns = [], []
    for path, regexes in leaves.items():
        patterns = [sql_literal(java_regex(regex, case)) for regex, case in regexes]
        if None in patterns:
            counts = [match_count(F.col(_quoted(col)), regex, case) for regex, case in regexes]
            as_columns.append(reduce(add, counts).alias(names[path]))
        else:
            counts = " + ".join(f"regexp_count({_quoted(col)}, {p})" for p in patterns)
            as_sql.append(f"{counts} AS {names[path]}")
    counted = df.selectExpr("*", *as_sql).select("*", *as_columns)
    totals = [
        " + ".join(f"CAST({names[p]} AS BIGINT)" for p in paths) + f" AS {_quoted(node)}"
        for node, paths in nodes.items()
    ]
    return counted.selectExpr(*[_quoted(c) for c in df.columns], *totals)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _dictionary_rows(dictionary, level_cols, regex_col, case_col) -> list[tuple[Path, str, bool]]:
    needed = [*level_cols, regex_col, *([case_col] if case_col else [])]
    if isinstance(dictionary, DataFrame):
        # The dictionary becomes part of the plan, as the columns it asks for do.
        records = [r.asDict() for r in dictionary.select(*needed).collect()]
    else:
        records = list(dictionary)
    if any(r.get(c) is None for r in records for c in needed):
        raise ValueError("no undefined values allowed in the dictionary")
    validate([r[regex_col] for r in records])
    return [
        (tuple(str(r[c]) for c in level_cols), r[regex_col], bool(r[case_col]) if case_col else False)
        for r in records
    ]


def node_leaves(paths: Sequence[Path]) -> dict[str, list[Path]]:
    """Node name -> leaf paths it sums over, in order of appearance.

    A name may show up on two levels only where every deeper node sits directly under a node of that
    name; such a node and what is below it add no column of their own.
    """
    reachable = [_until_repeat(path) for path in paths]
    depth: dict[str, int] = {}
    for names in reachable:
        for level, name in enumerate(names):
            depth[name] = min(level, depth.get(name, level))

    nodes: dict[str, list[Path]] = {}
    for path, names in zip(paths, reachable):
        for level, name in enumerate(names):
            if depth[name] < level:
                raise ValueError(f"node {name!r} also stands on a higher level without being its own parent")
            nodes.setdefault(name, []).append(path)
    return nodes


def _until_repeat(path: Path) -> Path:
    for level in range(1, len(path)):
        if path[level] == path[level - 1]:
            return path[:level]
    return path
