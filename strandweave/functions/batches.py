"""Arrow batches of sequences, worked on in time linear in their symbols.

A batch is taken as one array of symbols and the bounds of its rows in it, about AT_ONCE symbols at a
time: bytes where all are ASCII, else code points. Null rows are null in what comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

GAP = ord("-")
#: Symbols that are worked on at once; steps take up to a hundred bytes for each.
AT_ONCE = 1 << 20


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bounds): row k's are those from bounds[k] to bounds[k + 1]; null rows are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if len(own) and own.max() > 127:
        bounds = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[bounds]
        own = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
    return own, bounds


def texts_of(symbols: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``symbols_of``."""
    if symbols.dtype != np.uint8:
        size = 1 + (symbols > 0x7F).astype(np.int64) + (symbols > 0x7FF) + (symbols > 0xFFFF)
        bounds = np.concatenate([[0], np.cumsum(size)])[bounds]
        symbols = np.frombuffer(symbols.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(symbols)))
    return _nulled(out, valid)


def _nulled(out: pa.Array, valid: np.ndarray | None) -> pa.Array:
    return out if valid is None or valid.all() else pc.if_else(pa.array(valid), out, pa.scalar(None, out.type))


def _valid(*arrays: pa.Array) -> np.ndarray:
    return np.logical_and.reduce([pc.is_valid(a).to_numpy(zero_copy_only=False) for a in arrays])


def _lists(values: pa.Array, bounds: np.ndarray, valid: np.ndarray) -> pa.Array:
    return _nulled(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values), valid)


def _upto(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set before each bound."""
    return np.concatenate([[0], np.cumsum(flags)])[bounds]


def _of_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of lists of integers; null ones are empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def within(bounds: np.ndarray) -> np.ndarray:
    """The place of each item in its row."""
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def in_parts(texts: pa.Array, *others: pa.Array) -> list[slice]:
    """Slices of rows of about AT_ONCE bytes of all their texts, one row at least."""
    sizes = [pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False) for t in (texts, *others) if pa.types.is_string(t.type) or pa.types.is_large_string(t.type)]
    size = np.cumsum(np.sum(sizes, axis=0, dtype=np.int64))
    out, first = [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + AT_ONCE, "right")))
        out.append(slice(first, last))
        first = last
    return out


def udf(kind: str, work: Callable[..., pa.Array]) -> Callable[..., Column]:
    """A column function of ``work``, whose first argument is a text: parts of a batch go to it in turn."""

    def run(texts, *others):
        parts = [work(texts[s], *[o[s] for o in others]) for s in in_parts(texts, *others)]
        whole = pa.concat_arrays(parts) if parts else work(texts, *others)
        # what parts have held goes back: several workers share an executor
        parts.clear()
        pa.default_memory_pool().release_unused()
        return whole

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def gap_runs(texts: pa.Array) -> pa.Array:
    own, bounds = symbols_of(texts)
    gap = own == GAP
    begins, ends = gap.copy(), gap.copy()
    begins[1:] &= ~gap[:-1]
    ends[:-1] &= ~gap[1:]
    # runs do not go on from row to row
    some = bounds[:-1][np.diff(bounds) > 0]
    begins[some] = gap[some]
    some = bounds[1:][np.diff(bounds) > 0] - 1
    ends[some] = gap[some]
    upto = _upto(begins, bounds)
    base = np.repeat(bounds[:-1], np.diff(upto))
    first, last = ((np.flatnonzero(x) - base).astype(np.int32) for x in (begins, ends))
    return _lists(pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"]), upto, _valid(texts))


def run_texts(texts: pa.Array) -> pa.Array:
    """Runs of gaps as ``first-last``, with spaces between them."""
    runs = gap_runs(texts)
    ends = [runs.flatten().field(k).cast(pa.string()) for k in (0, 1)]
    _, upto = _of_lists(runs)
    return _nulled(pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pc.binary_join_element_wise(*ends, "-")), " "), _valid(texts))


def compacted(texts: pa.Array) -> pa.Array:
    """Residues, and runs of gaps as texts."""
    own, bounds = symbols_of(texts)
    kept = own != GAP
    return pa.StructArray.from_arrays([texts_of(own[kept], _upto(kept, bounds), _valid(texts)), run_texts(texts)], ["residues", "runs"])


def places(but: str) -> Callable[[pa.Array], pa.Array]:
    """Where symbols other than those of ``but`` stand."""

    def work(texts: pa.Array) -> pa.Array:
        own, bounds = symbols_of(texts)
        kept = ~np.isin(own, [ord(c) for c in but])
        upto = _upto(kept, bounds)
        at = np.flatnonzero(kept) - np.repeat(bounds[:-1], np.diff(upto))
        return _lists(pa.array(at.astype(np.int32)), upto, _valid(texts))

    return work


def ordinals(symbol: str) -> Callable[[pa.Array], pa.Array]:
    """Where a row's residues are ``symbol``, counted among its residues."""

    def work(texts: pa.Array) -> pa.Array:
        own, bounds = symbols_of(texts)
        kept = own != GAP
        upto = _upto(kept, bounds)
        hit = own[kept] == ord(symbol)
        return _lists(pa.array(within(upto)[hit].astype(np.int32)), _upto(hit, upto), _valid(texts))

    return work


def restored(symbol: str) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """``symbol`` at the residues of those ordinals; those beyond a row's residues are passed over."""

    def work(texts: pa.Array, lists: pa.Array) -> pa.Array:
        own, bounds = symbols_of(texts)
        own = own.copy() if ord(symbol) < 128 else own.astype(np.uint32)
        residues = np.flatnonzero(own != GAP)
        upto = _upto(own != GAP, bounds)
        hits, of = _of_lists(lists)
        n = np.diff(of)
        fit = (hits >= 0) & (hits < np.repeat(np.diff(upto), n))
        own[residues[(hits + np.repeat(upto[:-1], n))[fit]]] = ord(symbol)
        return texts_of(own, bounds, _valid(texts))

    return work


def placed(texts: pa.Array, lists: pa.Array, widths: pa.Array) -> pa.Array:
    own, bounds = symbols_of(texts)
    to, of = _of_lists(lists)
    valid = _valid(texts, lists, widths)
    wide = np.where(valid, np.maximum(0, pc.fill_null(widths, 0).to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(ends[-1], GAP, own.dtype)
    n = np.where(valid, np.minimum(np.diff(bounds), np.diff(of)), 0)
    nth = within(np.concatenate([[0], np.cumsum(n)]))
    row = np.repeat(np.arange(len(n)), n)
    at = to[nth + of[row]]
    fit = at < wide[row]
    out[(at + ends[row])[fit]] = own[(nth + bounds[row])[fit]]
    return texts_of(out, ends, valid)


def numbers(texts: pa.Array) -> pa.Array:
    """The integers of a text with white space between them."""
    items = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    row = pc.list_parent_indices(items).to_numpy(zero_copy_only=False)
    some = pc.not_equal(items.flatten(), "")
    upto = np.concatenate([[0], np.cumsum(np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(texts)))])
    return _lists(items.flatten().filter(some).cast(pa.int32()), upto, _valid(texts))


def propagated(guides: pa.Array, targets: pa.Array) -> pa.Array:
    guide, bounds = symbols_of(guides)
    own, of = symbols_of(targets)
    residues, upto = np.flatnonzero(guide != GAP), _upto(guide != GAP, bounds)
    n = np.minimum(np.diff(upto), np.diff(of))
    nth = within(np.concatenate([[0], np.cumsum(n)]))
    row = np.repeat(np.arange(len(n)), n)
    out = np.full(bounds[-1], GAP, own.dtype)
    out[residues[nth + upto[row]]] = own[nth + of[row]]
    return texts_of(out, bounds, _valid(guides, targets))


def spread(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Residues around runs of gaps (``first-last``, both included): as long as both together."""
    own, bounds = symbols_of(texts)
    valid = _valid(texts, runs)
    items = pc.utf8_split_whitespace(pc.fill_null(runs, ""))
    # white space at the ends gives empty items
    row = pc.list_parent_indices(items).to_numpy(zero_copy_only=False)
    flat = items.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    row, flat = row[some], flat.filter(pa.array(some))
    pair = pc.split_pattern(flat, "-", max_splits=1)
    a, b = (pc.list_element(pair, k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in (0, 1)) if len(flat) else (np.zeros(0, np.int64),) * 2
    a, b = np.minimum(a, b), np.maximum(a, b)
    reach = np.zeros(len(texts), np.int64)
    np.maximum.at(reach, row, b + 1)
    base = np.concatenate([[0], np.cumsum(reach + 1)])
    edge = np.zeros(base[-1] + 1, np.int32)
    np.add.at(edge, base[row] + a, 1)
    np.add.at(edge, base[row] + b + 1, -1)
    gap = np.cumsum(edge)[: base[-1]] > 0
    wide = np.diff(bounds) + np.diff(_upto(gap, base))
    ends = np.concatenate([[0], np.cumsum(wide)])
    # gaps within the row's width; what is left takes the residues in order
    of = np.repeat(np.arange(len(texts)), reach + 1)[gap]
    at = np.flatnonzero(gap) - base[of]
    free = np.ones(ends[-1], bool)
    fit = at < wide[of]
    free[ends[of[fit]] + at[fit]] = False
    nth = within(bounds) + np.repeat(_upto(free, ends)[:-1], np.diff(bounds))
    out = np.full(ends[-1], GAP, own.dtype)
    out[np.flatnonzero(free)[nth]] = own
    return texts_of(out, ends, valid)


def moved(to: np.ndarray, width: int) -> Callable[[pa.Array], pa.Array]:
    """Each row's symbols at the columns ``to`` of ``width``; null rows are gaps."""

    def work(texts: pa.Array) -> pa.Array:
        own, bounds = symbols_of(texts)
        out = np.full(width * len(texts), GAP, own.dtype)
        nth = within(bounds)
        fit = nth < len(to)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        out[row[fit] * width + to[nth[fit]]] = own[fit]
        return texts_of(out, width * np.arange(len(texts) + 1))

    return work


def counts(df: DataFrame, column: str, wanted: Callable[[np.ndarray], np.ndarray], key: str | None = None) -> DataFrame:
    """([key,] col, n): how many rows have a symbol that meets ``wanted`` at each column that a row has, of
    all rows or by ``key``. Each task gives its own sums: its keys times their columns are what it holds."""
    kind = dict(df.dtypes)[key] if key else "int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            texts, of = batch.column(0), batch.column(1).dictionary_encode()
            names, groups = [*of.dictionary.to_pylist(), None], pc.fill_null(of.indices, len(of.dictionary)).to_numpy(zero_copy_only=False)
            for s in in_parts(texts):
                own, bounds = symbols_of(texts[s])
                known, group = np.unique(groups[s], return_inverse=True)
                wide = np.zeros(len(known), np.int64)
                np.maximum.at(wide, group, np.diff(bounds))
                base = np.concatenate([[0], np.cumsum(wide)])
                hit = wanted(own)
                found = np.bincount((within(bounds) + np.repeat(base[group], np.diff(bounds)))[hit], minlength=base[-1])
                for k, name in enumerate(known.tolist()):
                    new, old = found[base[k] : base[k + 1]], sums.get(names[name], found[:0])
                    both = np.zeros(max(len(old), len(new)), np.int64)
                    both[: len(old)] += old
                    both[: len(new)] += new
                    sums[names[name]] = both
        for name, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), types[0]), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["__key", "col", "n"])

    rows = df.select(column, (F.col(key) if key else F.lit(0)).alias("__key"))
    types = [to_arrow_type(rows.schema["__key"].dataType)]
    found = rows.mapInArrow(work, f"__key {kind}, col int, n long").groupBy("__key", "col").agg(F.sum("n").alias("n"))
    return found.withColumnRenamed("__key", key) if key else found.drop("__key")


def _groups(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's key, a row of each number); nulls are a key, and a struct's fields count one by one."""
    fields = [*keys.flatten(), pc.is_valid(keys)] if pa.types.is_struct(keys.type) else [keys]
    group, first = np.zeros(len(keys), np.int64), np.zeros(min(1, len(keys)), np.int64)
    for field in fields:
        own = _groups(field)[0] if pa.types.is_struct(field.type) else pc.fill_null(field.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        _, first, group = np.unique(group * (own.max(initial=0) + 1) + own, return_index=True, return_inverse=True)
    return group, first


def tallies(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, col, ch, n): how many rows of a key have each symbol at each column. A batch gives its own counts
    before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (groups, first) = batch.column(1), _groups(batch.column(0))
            for s in in_parts(texts):
                own, bounds = symbols_of(texts[s])
                known, symbol = np.unique(own, return_inverse=True)
                wide, n = int(np.diff(bounds).max(initial=0)), len(known)
                places = (np.repeat(groups[s], np.diff(bounds)) * wide + within(bounds)) * n + symbol
                if len(first) * wide * n <= 4 * len(places):
                    sums = np.bincount(places)
                    at = np.flatnonzero(sums)
                    sums = sums[at]
                else:
                    at, sums = np.unique(places, return_counts=True)
                if len(at):
                    names = pa.array([chr(x) for x in known.tolist()], pa.string())
                    columns = [batch.column(0).take(pa.array(first[at // n // wide])), pa.array((at // n % wide).astype(np.int32)), names.take(pa.array(at % n)), pa.array(sums.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["__key", "col", "ch", "n"])

    rows = df.select(F.col(key).alias("__key"), column)
    found = rows.mapInArrow(work, f"__key {rows.schema['__key'].dataType.simpleString()}, col int, ch string, n long")
    return found.groupBy(F.col("__key").alias(key), "col", "ch").agg(F.sum("n").alias("n"))


def masked(kept: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """The symbols of the columns whose flag is set; columns behind the last flag go."""

    def work(texts: pa.Array) -> pa.Array:
        own, bounds = symbols_of(texts)
        flag = np.append(kept, False)[np.minimum(within(bounds), len(kept))]
        return texts_of(own[flag], _upto(flag, bounds), _valid(texts))

    return work
