"""Benchmark decontamination over a distributed positional inverted index.

Training texts are indexed in segments of a few megabytes, each one row: for
every test term its sorted positions in the segment, and the range of positions
of every document. Terms of no test text are left out, so an index serves one
benchmark. Window lookups start from the window's rarest term in the
whole corpus and intersect the lists of the others, shifted by their offsets, in
order of rarity. With a slop the other terms may stand so many words off their
place, which gives proximity matches.

Only the benchmark side is held by the driver and sent to tasks; its size is
checked. The work on the corpus needs no shuffle but for the counts of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siltlog.llm import words as W
from siltlog.llm.rows import pack, unpack
from siltlog.session import broadcast_if_small, materialize

WINDOW = 10
MOST_SLOP = 32
TEST_BYTES = 32 << 20
SEGMENT_BYTES = 4 << 20
CANDIDATES = 1 << 20

FOUND = ("n_words", "n_hit", "items", "matches")

_INTS = T.ArrayType(T.IntegerType())
_INDEX = (
    "segment",
    T.StructType().add("base", T.ArrayType(T.LongType())).add("n_words", _INTS).add("terms", _INTS).add("counts", _INTS).add("positions", _INTS),
)
_MATCH = T.StructType().add("item_id", "string").add("start", "integer").add("length", "integer")


@dataclass(frozen=True)
class TestSet:
    """Distinct windows of the benchmark: ``windows[w]`` are term numbers, -1 behind
    the end of a short one; ``owners`` are pairs of window and item."""

    terms: np.ndarray
    windows: np.ndarray
    owners: np.ndarray
    items: list[str]


def test_set(benchmark: DataFrame, window: int = WINDOW) -> TestSet:
    """Collect the windows of ``item_id, text``, the small side of a search.

    An item of fewer words is one shorter window; null or wordless texts have
    none. Items that repeat an id are one item. The whole benchmark must be
    below ``TEST_BYTES`` of text: the driver and every task hold about 240 bytes a
    word of it. There is no way yet to search for a larger one in parts.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    if size > TEST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; split it into parts of {TEST_BYTES}")
    got = benchmark.select(F.col("item_id").cast("string"), "text").toArrow()
    names = got.column(0).to_pylist()
    data, bounds = W.text_buffer(got.column(1))
    values, at = W.hash_words(data, bounds, W.PLAIN)
    terms, numbers = np.unique(values, return_inverse=True)
    items = sorted({str(n) for n in names})
    place = {n: k for k, n in enumerate(items)}
    rows, owners = [], []
    for k, name in enumerate(names):
        own = numbers[at[k] : at[k + 1]]
        if not len(own):
            continue
        if len(own) < window:
            own = np.concatenate([own, np.full(window - len(own), -1)])
        cut = np.lib.stride_tricks.sliding_window_view(own, window)
        rows.append(cut)
        owners.append(np.full(len(cut), place[str(name)]))
    if not rows:
        return TestSet(terms, np.empty((0, window), dtype=np.int64), np.empty((0, 2), dtype=np.int64), items)
    windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
    return TestSet(terms, windows, pairs, items)


def _segments(terms: np.ndarray, gap: int):
    """Index batches of ``..., text``: one row per segment of whole documents.

    A small table over the top bits of a value leaves out most words that are no
    test term before they are looked up.
    """
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(terms >> np.uint64(48)).astype(np.int64)] = True

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = W.text_buffer(batch.column("text"))
            for first, last in W.row_groups(bounds, SEGMENT_BYTES):
                low, high = bounds[first], bounds[last]
                values, at = W.hash_words(data[low:high], bounds[first : last + 1] - low, W.PLAIN)
                rows = last - first
                base = at[:-1] + np.arange(rows) * gap
                place = np.flatnonzero(seen[(values >> np.uint64(48)).astype(np.int64)])
                found = np.searchsorted(terms, values[place])
                found[found == len(terms)] = 0
                hit = terms[found] == values[place] if len(terms) else np.zeros(0, dtype=bool)
                place, found = place[hit], found[hit]
                doc = np.searchsorted(at, place, side="right") - 1
                order = np.argsort(found, kind="stable")
                numbers, counts = np.unique(found, return_counts=True)
                positions = (place - at[doc] + base[doc])[order]
                segment = {
                    "base": base,
                    "n_words": np.diff(at).astype(np.int32),
                    "terms": numbers.astype(np.int32),
                    "counts": counts.astype(np.int32),
                    "positions": positions.astype(np.int32),
                }
                fields = [
                    pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in segment.values()
                ]
                keys = batch.drop_columns(["text"]).slice(first, rows)
                keys = pa.StructArray.from_arrays(keys.columns, names=keys.schema.names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), keys),
                        pa.StructArray.from_arrays(fields, names=list(segment)),
                    ],
                    names=["keys", "segment"],
                )

    return index


def build_index(docs: DataFrame, tests: TestSet) -> DataFrame:
    """The stored index of ``docs``: all columns but ``text`` are kept as ``keys``.

    Null texts are documents without words. A column with the name of one that a
    search adds is kept as ``input_<name>``.
    """
    W.bounded_batches(docs.sparkSession, W.TEXT_BATCH)
    clashing = {c: f"input_{c}" for c in docs.columns if c.lower() in FOUND}
    docs = docs.withColumnsRenamed(clashing)
    keys = docs.drop("text").schema
    schema = T.StructType().add("keys", T.ArrayType(keys)).add(*_INDEX)
    gap = tests.windows.shape[1] + 2 * MOST_SLOP
    return materialize(docs.mapInArrow(_segments(tests.terms, gap), schema), "positional-index")


def term_counts(index: DataFrame, tests: TestSet) -> np.ndarray:
    """Occurrences of each test term in the whole corpus."""
    zipped = index.select(F.explode(F.arrays_zip("segment.terms", "segment.counts")).alias("x"))
    out = np.zeros(len(tests.terms), dtype=np.int64)
    for term, n in zipped.groupBy("x.terms").agg(F.sum("x.counts")).collect():
        out[term] = n
    return out


def _list(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    column = batch.column("segment").field(name)
    low, high = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.int64)


def _lookup(tests: TestSet, counts: np.ndarray, slop: int):
    """Match batches of segments; one row per document."""
    frequency = np.where(tests.windows >= 0, counts[tests.windows], np.iinfo(np.int64).max)
    offsets = np.argsort(frequency, axis=1, kind="stable")
    ranked = np.take_along_axis(tests.windows, offsets, axis=1)
    length = (tests.windows >= 0).sum(axis=1)
    first_owner = np.searchsorted(tests.owners[:, 0], np.arange(len(tests.windows) + 1))

    def occurrences(posted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions they start at; ``posted`` is term and position in one number, sorted."""
        low = np.searchsorted(posted, ranked[:, 0] << 32)
        many = np.searchsorted(posted, (ranked[:, 0] + 1) << 32) - low
        ends = np.cumsum(many)
        out_w, out_at, w = [], [], 0
        while w < len(many):
            # As many windows at once as give a bounded number of candidates, one at least.
            stop = max(w + 1, int(np.searchsorted(ends, (ends[w - 1] if w else 0) + CANDIDATES, side="right")))
            own = many[w:stop]
            which = np.repeat(np.arange(w, stop), own)
            within = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
            at = (posted[low[which] + within] & 0xFFFFFFFF) - offsets[which, 0]
            for k in range(1, ranked.shape[1]):
                term = ranked[which, k]
                want = (term << 32) + at + offsets[which, k]
                found = np.searchsorted(posted, want - slop)
                near = posted[np.minimum(found, len(posted) - 1)]
                fits = (term < 0) | ((found < len(posted)) & (near <= want + slop))
                which, at = which[fits], at[fits]
                if not len(which):
                    break
            out_w.append(which)
            out_at.append(at)
            w = stop
        return np.concatenate(out_w), np.concatenate(out_at)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, n_words = _list(batch, row, "base"), _list(batch, row, "n_words")
                terms, n = _list(batch, row, "terms"), _list(batch, row, "counts")
                posted = (np.repeat(terms, n) << 32) + _list(batch, row, "positions")
                rows = len(base)
                n_hit = np.zeros(rows, dtype=np.int64)
                doc = start = item = size = np.empty(0, dtype=np.int64)
                if len(posted) and len(ranked):
                    which, at = occurrences(posted)
                    # The rarest term is in the document; with a slop the start may lie before it.
                    whose = np.searchsorted(base, at + offsets[which, 0], side="right") - 1
                    at, end = np.maximum(at, base[whose]), np.minimum(at + length[which], (base + n_words)[whose])
                    edge = np.zeros(int(base[-1] + n_words[-1]) + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, end, -1)
                    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
                    n_hit = covered[base + n_words] - covered[base]
                    owned = first_owner[which + 1] - first_owner[which]
                    pick = np.repeat(np.arange(len(which)), owned)
                    within = np.arange(len(pick)) - np.repeat(np.cumsum(owned) - owned, owned)
                    item = tests.owners[first_owner[which][pick] + within, 1]
                    doc, start, size = whose[pick], (at - base[whose])[pick], (end - at)[pick]
                    order = np.lexsort((start, item, doc))
                    doc, start, item, size = doc[order], start[order], item[order], size[order]
                upto = pa.array(np.searchsorted(doc, np.arange(rows + 1)), pa.int32())
                pairs = np.unique(np.stack([doc, item], axis=1), axis=0) if len(doc) else np.empty((0, 2), dtype=np.int64)
                per_doc = pa.array(np.searchsorted(pairs[:, 0], np.arange(rows + 1)), pa.int32())
                names = pa.array(tests.items, pa.string())
                spans = pa.StructArray.from_arrays(
                    [names.take(pa.array(item)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["item_id", "start", "length"],
                )
                keys = batch.column("keys")
                low, high = keys.offsets[row].as_py(), keys.offsets[row + 1].as_py()
                keys = keys.values.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        *keys.flatten(),
                        pa.array(n_words),
                        pa.array(n_hit),
                        pa.ListArray.from_arrays(per_doc, names.take(pa.array(pairs[:, 1]))),
                        pa.ListArray.from_arrays(upto, spans),
                    ],
                    names=[*[f.name for f in keys.type], "n_words", "n_hit", "items", "matches"],
                )

    return match


def search(index: DataFrame, tests: TestSet, slop: int = 0) -> DataFrame:
    """One row per indexed document: its keys, ``n_words``, ``n_hit`` (words inside a
    match), ``items`` (each once) and ``matches`` of item, first word and length.

    Without slop a match is an exact phrase. With it every term of the window
    must stand within ``slop`` words of its place behind the rarest term, in the
    same document; a match then covers the window's length from where it would
    start.
    """
    if not 0 <= slop <= MOST_SLOP:
        raise ValueError(f"slop must be 0 to {MOST_SLOP}")
    W.bounded_batches(index.sparkSession, W.TEXT_BATCH)
    schema = T.StructType([*index.schema["keys"].dataType.elementType.fields]).add("n_words", "long").add("n_hit", "long")
    schema = schema.add("items", T.ArrayType(T.StringType())).add("matches", T.ArrayType(_MATCH))
    return index.mapInArrow(_lookup(tests, term_counts(index, tests), slop), schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, slop: int = 0, window: int = WINDOW) -> DataFrame:
    """Index ``docs`` (``text`` and key columns) and search it for ``benchmark``."""
    tests = test_set(benchmark, window)
    return search(build_index(docs, tests), tests, slop)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, as they are.

    Rows are told apart by id and text, so a row that repeats the id of a
    contaminated one stays. The list of contaminated rows is broadcast only when
    it is counted to be short.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    found = overlaps(docs.select(key.alias("key"), F.col("text")), benchmark)
    bad = materialize(found.where("n_hit > 0").select("key").distinct(), "contaminated")
    return unpack(pack(docs, key=key).join(broadcast_if_small(bad, 1_000_000), "key", "left_anti"))
