"""Pairs of groups of notes whose rarest terms may reach a threshold, met a pair of blocks at a time.

A group travels as one row with the packed postings of its prefix; the groups of an entity are dealt to blocks of a bounded
number of postings, and a task meets two blocks.  What two groups share is summed up within the task: the terms at which
pairs meet are neither written nor shuffled, only pairs that may reach a threshold leave it.

Weights and norms are stored in 16 bits, rounded up, so that no sum falls short.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Shares of the thresholds that the terms behind a pair's zone may give: the smaller, the more terms meet and the fewer pairs stay.
OUTSIDE_COSINE, OUTSIDE_JACCARD = 0.965, 0.9
#: What sums of doubles, and of rounded products, may be short of.
SLACK, ROUNDING = 1e-9, 1e-4
#: A posting: hash of its term, terms of its group from it on, its weight, the squared norm from it on.
POSTING = np.dtype([("key", "<u4"), ("left", "<u4"), ("w", "<u2"), ("rest", "<u2")])
UNIT = 65535
#: Meeting terms that are summed up at a time.
AT_ONCE = 1 << 20
#: Postings of a block that are looked up in the other one at a time.
ASKED = 1 << 18

#: Groups that are packed at a time.
ROWS = 2048

TERMS = "entity_id string, bag string, size long, terms array<struct<term: string, tf: long>>"
MISSED = "gid long, entity_id string, at int, term string"
COUNTS = "entity_id string, gid long, bag string, size long, docs long, counts array<struct<df: long, term: string, tf: long>>"
COUNTED = f"{COUNTS}, n int, core int, postings binary"
PREFIX = "gid long, entity_id string, n int, core int, postings binary"
PAIR = "a long, b long"
SIMILAR = "entity_id string, bag_a string, bag_b string, cosine double, jaccard double, shared_tokens array<string>"
#: Common terms that a pair of similar groups names.
SHOWN = 15


def hand_back() -> None:
    """Give the memory that a worker's former tasks have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (entity_id, bag, size, text) to rows of TERMS: each word of a group once, with its count."""
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        words = pc.split_pattern(batch.column("text"), " ")
        n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        width = max(1, len(coded.dictionary))
        found, tf = np.unique(np.repeat(np.arange(len(n)), n) * width + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(found, np.arange(len(n) + 1) * width).astype(np.int32)
        term = coded.dictionary.take(pa.array(found % width))
        terms = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([term, pa.array(tf, pa.int64())], ["term", "tf"]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("entity_id", "bag", "size")), terms], ["entity_id", "bag", "size", "terms"])


@dataclass
class Known:
    """The df of frequent terms, by entity."""

    places: dict[str, tuple[int, int]]
    terms: pa.Array
    df: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Known:
        """From rows (entity_id, term, df)."""
        rows = rows.take(pc.sort_indices(rows.column("entity_id"))).combine_chunks()
        entity = rows.column("entity_id").to_numpy()
        starts = np.flatnonzero(entity[1:] != entity[:-1]) + 1 if len(entity) else np.zeros(0, np.int64)
        ends = [*starts.tolist(), len(entity)]
        places = {entity[a]: (a, b - a) for a, b in zip([0, *starts.tolist()], ends) if b > a}
        terms = rows.column("term")
        return cls(places, terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms, rows.column("df").to_numpy())

    def look(self, entity: str, terms: pa.Array) -> np.ndarray:
        """The df of each of the terms, 0 where it isn't known."""
        own = self.terms.slice(*self.places.get(entity, (0, 0)))
        found = pc.index_in(terms, value_set=own)
        known = pc.is_valid(found).to_numpy(zero_copy_only=False)
        first = self.places.get(entity, (0, 0))[0]
        df = np.zeros(len(terms), np.int64)
        df[known] = self.df[first + found.drop_null().to_numpy()]
        return df


@dataclass
class Listed:
    """The terms of the groups of one entity, end to end: their text, code, tf and group, and where groups begin."""

    rows: pa.Table
    n: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    coded: pa.DictionaryArray
    codes: np.ndarray
    tf: np.ndarray


def by_entity(rows: pa.Table) -> Iterator[tuple[str, Listed]]:
    """The rows of `terms` of each entity, of so many terms at a time as AT_ONCE, or of one group."""
    rows = rows.take(pc.sort_indices(rows.column("entity_id"))).combine_chunks()
    entity = rows.column("entity_id").to_numpy()
    total = np.cumsum(pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64))
    at = 0
    while at < rows.num_rows:
        end = at + int(np.argmax(entity[at:] != entity[at])) if (entity[at:] != entity[at]).any() else rows.num_rows
        while at < end:
            before = total[at - 1] if at else 0
            stop = min(end, max(at + 1, int(np.searchsorted(total, before + AT_ONCE, "right"))))
            part = rows.slice(at, stop - at)
            flat = pc.list_flatten(part.column("terms")).combine_chunks()
            n = pc.list_value_length(part.column("terms")).to_numpy().astype(np.int64)
            coded = pc.struct_field(flat, "term").dictionary_encode()
            yield entity[at], Listed(
                part, n, np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), coded, coded.indices.to_numpy(),
                pc.struct_field(flat, "tf").to_numpy())
            at = stop


def missed_terms(known: Callable[[], Known]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (gid, entity_id, terms) to the terms whose df isn't known, with their place in the group (MISSED)."""

    def run(batches):
        for batch in batches:
            for entity, x in by_entity(pa.Table.from_batches([batch])):
                out = np.flatnonzero(known().look(entity, x.coded.dictionary)[x.codes] == 0)
                gid = x.rows.column("gid").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gid[x.doc[out]]), pa.array([entity], pa.string()).take(pa.array(np.zeros(len(out), np.int64))),
                     pa.array((out - x.starts[x.doc[out]]).astype(np.int32)), x.coded.dictionary.take(pa.array(x.codes[out]))],
                    ["gid", "entity_id", "at", "term"])

    return run


def ordered_counts(known: Callable[[], Known], least: tuple[float, float] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From rows (entity_id, gid, bag, size, docs, terms) and (gid, at, df) of missed terms to rows of COUNTS, rarest term first.

    With the least cosine and Jaccard similarity, they have their prefix too (COUNTED).  A term that is neither known nor found
    is of one group only.
    """
    names_of = ["entity_id", "gid", "bag", "size", "docs", "counts", *(["n", "core", "postings"] if least else [])]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        hand_back()
        order = np.argsort(found.column("gid").to_numpy(), kind="stable")
        whose, place, df_there = (found.column(c).to_numpy()[order] for c in ("gid", "at", "df"))
        out = []
        for entity, x in by_entity(rows):
            names = x.coded.dictionary
            df = known().look(entity, names)[x.codes]
            gid = x.rows.column("gid").to_numpy()
            first, last = np.searchsorted(whose, gid), np.searchsorted(whose, gid, "right")
            n = last - first
            own = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            df[np.repeat(x.starts, n) + place[own]] = df_there[own]
            df = np.where(df == 0, x.rows.column("size").to_numpy()[x.doc], df)
            rank = np.empty(len(names), np.int64)
            rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            most, width = int(df.max(initial=0)) + 1, len(names)
            if len(gid) * most * width < 1 << 62:
                by = np.argsort((x.doc * most + df) * width + rank[x.codes])
            else:
                by = np.lexsort((rank[x.codes], df, x.doc))
            df, codes, tf = df[by], x.codes[by], x.tf[by]
            counts = pa.StructArray.from_arrays(
                [pa.array(df, pa.int64()), names.take(pa.array(codes)), pa.array(tf, pa.int64())], ["df", "term", "tf"])
            columns = [
                *(x.rows.column(c) for c in ("entity_id", "gid", "bag", "size", "docs")),
                pa.ListArray.from_arrays(pa.array(np.append(x.starts, len(df)).astype(np.int32)), counts)]
            if least:
                keys = np.fromiter((zlib.crc32(t.encode()) for t in names.to_pylist()), np.int64, len(names))
                w = unit_weights(tf, df, x.rows.column("docs").to_numpy(), x.doc)
                core, count, postings = packed(keys[codes], df, w, x.n, x.rows.column("size").to_numpy(), *least)
                columns += [pa.array(x.n, pa.int32()), pa.array(core, pa.int32()), binaries(count, postings)]
            out.append(pa.table(columns, names_of))
        if out:
            return pa.concat_tables(out)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("df", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array([], k) for k in kinds[: len(names_of)]], names_of)

    return run


def unit_weights(tf: np.ndarray, df: np.ndarray, docs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The weights of the vectors, as `unit_vectors` of the notes has them; docs by group, the others by term."""
    raw = tf * (np.log((1.0 + docs[doc]) / (1.0 + df)) + 1.0)
    return raw / np.sqrt(np.bincount(doc, raw * raw, len(docs)))[doc]


def packed(
    keys: np.ndarray, df: np.ndarray, w: np.ndarray, n: np.ndarray, size: np.ndarray, cosine: float, jaccard: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, postings kept of each group, postings) of groups of n terms each, rarest first.

    Kept are the postings that may be among the first common terms of a pair that reaches a threshold.  Terms of no other group
    are left out.  `core` is the least number of terms that hold cosine^2 of the squared norm.
    """
    outside = cosine * OUTSIDE_COSINE
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    square = w * w
    total = np.concatenate(([0.0], np.cumsum(square)))
    rest = total[ends[doc]] - total[:-1]
    left = ends[doc] - np.arange(len(doc))
    heaviest = square[np.lexsort((-square, doc))]
    sums = np.concatenate(([0.0], np.cumsum(heaviest)))
    inner = sums[:-1] - sums[(ends - n)[doc]] < cosine * cosine - SLACK
    core = np.bincount(doc[inner], minlength=len(n))
    kept = np.flatnonzero((df > size[doc]) & (
        (rest >= outside * outside - SLACK) | (left >= OUTSIDE_JACCARD * jaccard * n[doc] - SLACK)))
    postings = np.empty(len(kept), POSTING)
    postings["key"] = keys[kept].astype(np.int64) & 0xFFFFFFFF
    postings["left"] = left[kept]
    postings["w"] = np.minimum(np.ceil(w[kept] * UNIT), UNIT)
    postings["rest"] = np.clip(np.ceil(rest[kept] * UNIT), 1, UNIT)
    return core, np.bincount(doc[kept], minlength=len(n)), postings


def binaries(count: np.ndarray, postings: np.ndarray) -> pa.Array:
    """The postings of each group, of which `count` are its own."""
    starts = np.concatenate(([0], np.cumsum(count))) * POSTING.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(count), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(postings.tobytes())])


def pack_prefixes(cosine: float, jaccard: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (gid, entity_id, size, keys, df, w), terms rarest first, to rows of PREFIX; groups without postings go."""

    def run(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            keys, df, w = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("keys", "df", "w"))
            n = pc.list_value_length(batch.column("keys")).to_numpy(zero_copy_only=False).astype(np.int64)
            core, count, postings = packed(keys, df, w, n, batch.column("size").to_numpy(zero_copy_only=False), cosine, jaccard)
            some = np.flatnonzero(count)
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid").take(take), batch.column("entity_id").take(take), pa.array(n[some], pa.int32()),
                 pa.array(core[some], pa.int32()), binaries(count[some], postings)], ["gid", "entity_id", "n", "core", "postings"])

    return run


@dataclass
class Block:
    """The groups of a block and their postings, in order of the groups."""

    gid: np.ndarray
    n: np.ndarray
    core: np.ndarray
    postings: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        packed = rows.column("postings").combine_chunks()
        packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        count = np.diff(offsets) // POSTING.itemsize
        postings = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(POSTING)
        gid, n, core = (rows.column(c).to_numpy().astype(np.int64) for c in ("gid", "n", "core"))
        return cls(gid, n, core, postings, np.repeat(np.arange(len(gid), dtype=np.int32), count))

    def where(self, mask: np.ndarray) -> Block:
        return Block(self.gid, self.n, self.core, self.postings[mask], self.doc[mask])

    def parts(self) -> Iterator[Block]:
        """Some postings at a time, of whole groups."""
        at = 0
        while at < len(self.doc):
            stop = min(at + ASKED, len(self.doc))
            begun = np.searchsorted(self.doc, self.doc[stop - 1])  # of the last group, which may go on
            stop = int(np.searchsorted(self.doc, self.doc[stop - 1], "right")) if begun <= at else stop if stop == len(self.doc) else int(begun)
            yield Block(self.gid, self.n, self.core, self.postings[at:stop], self.doc[at:stop])
            at = stop


def found_in(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values from low to high lie in the sorted own; sorted questions are answered faster."""
    order = np.argsort(low)
    first, last = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
    first[order] = np.searchsorted(own, low[order])
    last[order] = np.searchsorted(own, high[order], "right")
    return first, np.maximum(first, last)


def meetings(a: Block, b: Block, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of postings of a and of b that meet, whole groups of a at a time.

    A posting of b meets a group once, so that there are at most as many for one group as b has postings.
    """
    count = last - first
    of_doc = np.cumsum(np.bincount(a.doc, count, len(a.gid)).astype(np.int64))
    places = np.searchsorted(a.doc, np.arange(len(a.gid) + 1))
    at = 0
    while at < len(a.gid):
        before = of_doc[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(of_doc, before + AT_ONCE, "right")))
        own = np.arange(places[at], places[stop])
        n = count[own]
        i = np.repeat(own, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
        at = stop
        if len(i):
            yield i, j


def reaching(key: np.ndarray, value: np.ndarray, least: float) -> np.ndarray:
    """The keys whose values sum up to at least `least`."""
    if not len(key):
        return key
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
    return key[starts[np.add.reduceat(value[order], starts) >= least]]


def by_cosine(a: Block, b: Block, same: bool, cosine: float) -> Iterator[np.ndarray]:
    """Pairs, as place in a * groups of b + place in b, that the terms of their zone let reach the cosine."""
    s = cosine * OUTSIDE_COSINE
    squared = int((s * s - SLACK) * UNIT * UNIT)
    a, b = (x.where(x.postings["rest"] >= squared // UNIT) for x in (a, b))
    place = (b.postings["key"].astype(np.int64) << 16) | (UNIT - b.postings["rest"].astype(np.int64))
    order = np.argsort(place)
    place, other, weight = place[order], b.doc[order], b.postings["w"][order]
    del order
    for part in a.parts():
        low = part.postings["key"].astype(np.int64) << 16
        needed = -(-squared // part.postings["rest"].astype(np.int64))
        first, last = found_in(place, low, low + UNIT - needed)
        last = np.where(needed > UNIT, first, last)
        for i, j in meetings(part, b, first, last):
            x, y = part.doc[i].astype(np.int64), other[j].astype(np.int64)
            fits = (a.n[x] >= b.core[y]) & (b.n[y] >= a.core[x])
            if same:
                fits &= x < y
            product = part.postings["w"][i] / UNIT * (weight[j] / UNIT)
            yield reaching((x * len(b.gid) + y)[fits], product[fits], cosine - s - ROUNDING)


def by_jaccard(a: Block, b: Block, same: bool, jaccard: float) -> Iterator[np.ndarray]:
    """The same for the Jaccard similarity."""
    a, b = (x.where(x.postings["left"] >= OUTSIDE_JACCARD * jaccard * x.n[x.doc] - SLACK) for x in (a, b))
    place = (b.postings["key"].astype(np.int64) << 31) | b.n[b.doc]
    order = np.argsort(place)
    place, other, behind = place[order], b.doc[order], b.postings["left"][order]
    del order
    for part in a.parts():
        key, n = part.postings["key"].astype(np.int64) << 31, a.n[part.doc]
        first, last = found_in(
            place, key + np.ceil(jaccard * n - SLACK).astype(np.int64), key + np.floor((n + SLACK) / jaccard).astype(np.int64))
        for i, j in meetings(part, b, first, last):
            x, y = part.doc[i].astype(np.int64), other[j].astype(np.int64)
            wanted = (a.n[x] + b.n[y]) * (jaccard / (1 + jaccard))
            fits = np.minimum(part.postings["left"][i], behind[j]) >= OUTSIDE_JACCARD * wanted - SLACK
            if same:
                fits &= x < y
            yield reaching((x * len(b.gid) + y)[fits], (1.0 / wanted)[fits], 1 - OUTSIDE_JACCARD - ROUNDING)


def meet_blocks(cosine: float, jaccard: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """For the rows of two blocks (key: entity, one, two; columns of PREFIX and `block`), their pairs (PAIR), a < b."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hand_back()
        one, two = key[1].as_py(), key[2].as_py()
        a = Block.of(rows.filter(pc.equal(rows.column("block"), one)))
        b = a if one == two else Block.of(rows.filter(pc.equal(rows.column("block"), two)))
        found = [*by_cosine(a, b, a is b, cosine), *by_jaccard(a, b, a is b, jaccard)]
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        width = max(1, len(b.gid))
        x, y = a.gid[pairs // width], b.gid[pairs % width]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def compare_pairs(cosine: float, jaccard: float, floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From groups (gid, entity_id, bag, docs, terms, df, tf) and pairs (a, b) of them to the similar ones (SIMILAR).

    Similar is a cosine of at least `cosine`, or a Jaccard similarity of at least `jaccard` with a cosine of at least `floor`.
    """

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        if rows.num_rows > ROWS // 2:
            hand_back()
        gid = rows.column("gid").to_numpy()
        by_gid = np.argsort(gid)
        x, y = (by_gid[np.searchsorted(gid, pairs.column(c).to_numpy(), sorter=by_gid)] for c in "ab")
        size = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        coded = pc.list_flatten(rows.column("terms")).combine_chunks().dictionary_encode()
        names = coded.dictionary.to_pylist()
        ranked = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[ranked] = np.arange(len(names))
        names = [names[i] for i in ranked]
        term = rank[coded.indices.to_numpy()]
        weight = unit_weights(
            *(pc.list_flatten(rows.column(c)).to_numpy() for c in ("tf", "df")), rows.column("docs").to_numpy(),
            np.repeat(np.arange(len(size)), size))
        entity, bag = rows.column("entity_id").to_pylist(), rows.column("bag").to_pylist()
        own = np.zeros(len(names))
        out: list[list] = [[] for _ in range(6)]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        for begin, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
            a = int(x[begin])
            mine = slice(first[a], first[a] + size[a])
            own[term[mine]] = weight[mine]
            at = begin
            while at < stop:  # as many partners at a time as have some number of terms
                after = max(at + 1, at + int(np.searchsorted(np.cumsum(size[y[at:stop]]), AT_ONCE, "right")))
                others = y[at:after]
                n = size[others]
                from_, which = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
                places = np.arange(len(which)) - from_[which] + first[others][which]
                met = own[term[places]]
                score = np.add.reduceat(met * weight[places], from_)
                common = np.add.reduceat((met > 0).astype(np.int64), from_)
                alike = common / (size[a] + n - common)
                for k in np.flatnonzero((score >= floor) & ((score >= cosine) | (alike >= jaccard))).tolist():
                    b = int(others[k])
                    theirs = term[places[from_[k] : from_[k] + n[k]]]
                    shown = np.sort(theirs[met[from_[k] : from_[k] + n[k]] > 0])[:SHOWN].tolist()
                    row = (entity[a], min(bag[a], bag[b]), max(bag[a], bag[b]), float(score[k]), float(alike[k]), [names[i] for i in shown])
                    for column, value in zip(out, row):
                        column.append(value)
                at = after
            own[term[mine]] = 0.0
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())]
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], ["entity_id", "bag_a", "bag_b", "cosine", "jaccard", "shared_tokens"])

    return run
