"""Newick text to node tables and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RESERVED = re.compile(r"[\s()\[\],:;']")
_TOKEN = re.compile(r"\s*\[[^\]]*\]|\s*(?:('(?:[^']|'')*')|([(),;:])|([^\s(),;:'\[]+))")


def nodes_of(text: str) -> list[tuple[int, int | None, float | None, str | None, bool]]:
    """(node, parent, len, label, is_leaf) of one tree; nodes are numbered in post-order from 0.

    Quoted labels keep their spaces, bracketed comments are passed over, underscores stay. Anything
    but one whole tree raises.
    """
    kids: list[list[int]] = [[]]
    out: list[list] = []  # parent, len, label, is_leaf
    pending: dict = {"label": None, "len": None, "inner": []}
    at, after_colon, done = 0, False, False

    def close() -> None:
        node = len(out)
        out.append([None, pending["len"], pending["label"], not pending["inner"]])
        for k in pending["inner"]:
            out[k][0] = node
        kids[-1].append(node)
        pending.update(label=None, len=None, inner=[])

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError(f"no tree at {at}: {text[at:at + 20]!r}")
            break
        at = m.end()
        quoted, mark, word = m.groups()
        if quoted is None and mark is None and word is None:
            continue
        if done:
            raise ValueError("text after the tree")
        if mark == "(":
            kids.append([])
        elif mark == ",":
            close()
        elif mark == ")":
            close()
            if len(kids) < 2:
                raise ValueError("unbalanced parentheses")
            pending["inner"] = kids.pop()
        elif mark == ":":
            after_colon = True
        elif mark == ";":
            close()
            done = True
        elif after_colon:
            pending["len"], after_colon = float(word), False
        else:
            pending["label"] = quoted[1:-1].replace("''", "'") if quoted else word
    if not done:
        close()
    if len(kids) != 1 or len(kids[0]) != 1:
        raise ValueError("unbalanced parentheses")
    return [(k, p, length, label, leaf) for k, (p, length, label, leaf) in enumerate(out)]


def read_newick(trees: DataFrame) -> DataFrame:
    """(tree_id, node, parent, len, label, is_leaf) from (tree_id, newick): one tree per row."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree_id, text in zip(frame["tree_id"], frame["newick"], strict=True):
                rows = pd.DataFrame(nodes_of(text), columns=["node", "parent", "len", "label", "is_leaf"])
                yield rows.assign(tree_id=tree_id, parent=rows["parent"].astype("Int64"))[["tree_id", "node", "parent", "len", "label", "is_leaf"]]

    return trees.select("tree_id", "newick").mapInPandas(parse, f"tree_id {dict(trees.dtypes)['tree_id']}, node int, parent int, len double, label string, is_leaf boolean")


def to_newick(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(newick) of (node, parent, len, label), children in order of node, of any depth.

    With a tree_id column there is one row per tree. A tree's text is one row, so its nodes meet in
    one task, which goes through them without recursion. Labels with reserved characters are quoted.
    Nodes whose parent is missing raise, as do those deeper than ``depth`` levels if it is given.
    An empty table has no text.
    """

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        nodes = frame["node"].tolist()
        parent = dict(zip(nodes, [None if pd.isna(p) else int(p) for p in frame["parent"]], strict=True))
        tail = {n: _tail(label, length) for n, label, length in zip(nodes, frame["label"], frame["len"], strict=True)}
        kids: dict[int, list[int]] = {n: [] for n in nodes}
        for n in nodes:
            if parent[n] is not None:
                if parent[n] not in kids:
                    raise ValueError(f"node {n} hangs under {parent[n]}, which is missing")
                kids[parent[n]].append(n)
        done = 0
        texts = []
        for root in (n for n in nodes if parent[n] is None):
            out, stack = [], [(root, 0, 0)]  # node, its next child, its level
            while stack:
                n, k, level = stack.pop()
                if depth is not None and level > depth:
                    raise ValueError(f"nodes deeper than {depth} levels, below node {parent[n]}")
                done += k == 0
                if k < len(kids[n]):
                    out.append("(" if k == 0 else ",")
                    stack += [(n, k + 1, level), (kids[n][k], 0, level + 1)]
                else:
                    out.append(")" * bool(kids[n]) + tail[n])
            texts.append("".join(out) + ";")
        if done != len(nodes):
            raise ValueError("some nodes hang under each other in a ring")
        return pd.DataFrame({"newick": texts}) if "tree_id" not in frame else pd.DataFrame({"tree_id": frame["tree_id"].iloc[0], "newick": texts})

    if "tree_id" in tree.columns:
        kind = dict(tree.dtypes)["tree_id"]
        return tree.select("tree_id", "node", "parent", "len", "label").groupBy("tree_id").applyInPandas(compose, f"tree_id {kind}, newick string")
    return tree.select("node", "parent", "len", "label").groupBy(F.lit(0).alias("__tree")).applyInPandas(lambda frame: compose(frame), "newick string")


def _tail(label: str | None, length: float | None) -> str:
    text = "" if label is None or label != label else label
    if _RESERVED.search(text):
        text = "'" + text.replace("'", "''") + "'"
    return text if length is None or length != length else f"{text}:{length!r}".removesuffix(".0")
