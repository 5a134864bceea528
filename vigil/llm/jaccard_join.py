"""Exact Jaccard similarity join of documents' word shingles, in a metric space.

Jaccard distance is a metric, so that pivots and the triangle inequality can divide the work.  At distance 1 from
nearly every other document, a document would lie on the border of all regions of a plain Voronoi diagram; therefore
the top regions take what is known of distances without computing them:

1. Documents with equal shingle sets are one class.  Every class counts which of its shingles other classes have; one
   that has too few of them can't be linked.  Of the others, two linked sets share a shingle of their first quarters,
   in an order of shingles from the rarest on, so that documents without a common one are known to be far apart.
2. Among the documents of each such shingle, the least digest is the pivot.  A region is
   a pivot with all documents near it in this sense; documents near several pivots are replicated to each, and
   every link lies within a region.
3. Regions are joined exactly: pivots within the region make Voronoi cells, a cell gets the documents within its
   triangle-inequality window, and cells are joined the same way until they are small.  Documents that are known to
   be of one component need no comparison.
4. A region that is too large for a task is dealt in chunks, each with all pivots of the region.  What these do not
   connect to the region's largest component is joined with all other chunks, block by block.

Shingles are looked at in tiers, to move fewer of them.  The wide tier has all sets of more than `small` shingles, and of
their shingles those of hash below `part` of the range: if a set of n shingles has u of them there, all but n - 75 % of n
of the u must be in a linked set.  The small tier has whole sets of up to 4/3 of `small`; the odd tier has the whole sets
of those few large ones whose u is too small to tell.  Two linked sets meet in one of the tiers.  Nothing is capped.

Edge cases: null or empty texts have no shingles, n_shingles 0, and are alone; with 1 to k - 1 words, the whole
sequence is one shingle; a row without a doc_id has component null and links nothing; rows that repeat a doc_id with
another text are other documents; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.components import components
from vigil.llm.shared import BROADCAST_IDS, checked_broadcast, let_go, scratch, stored, text_slices
from vigil.llm.words import shingle_sets


@dataclass(frozen=True)
class Join:
    """Shingle length and similarity in percent; tiers; then sizes of work.

    A shingle in more than `crowd` sets of one flush of `flush` shingles is dealt out by documents, not by shingles.
    A task joins about `leaf` documents or `leaf_shingles` shingles.
    """

    k: int = 5
    percent: int = 75
    part: float = 0.45
    small: int = 64
    crowd: int = 64
    flush: int = 2_000_000
    leaf: int = 256
    leaf_shingles: int = 1_500_000
    pivots: int = 6

    @property
    def limit(self) -> np.uint64:
        return np.uint64(min(int(self.part * 2**64), 2**64 - 1))


WIDE, SMALL, ODD = 0, 1, 2
CROWDED = 1 << 30
#: Cells from here down tell which sets have fewer numbers than shingles.
FEWER = -(1 << 40)


def least_overlap(n: np.ndarray | int, percent: int):
    return (percent * n + 99) // 100


def digest(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else ""


def short_name(whole: str) -> int:
    """The first 64 bits of a digest, signed."""
    return int.from_bytes(bytes.fromhex(whole[:16]), "big", signed=True)


def digested(docs: DataFrame, options: Join) -> DataFrame:
    """docs with the `digest` of their texts."""

    def run(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = [digest(x) or None for x in shingle_sets(part.column("text"), options.k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.string())], [*part.schema.names, "digest"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("digest", T.StringType())]))


def shingled(docs: DataFrame, options: Join) -> DataFrame:
    """(doc_id, n, wide, digest) of every row: shingles, those of the wide tier; the digest of an empty set is null."""

    def run(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = list(shingle_sets(part.column("text"), options.k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in own], pa.int64()),
                     pa.array([int(np.searchsorted(x, options.limit)) for x in own], pa.int64()),
                     pa.array([digest(x) or None for x in own], pa.string())], ["doc_id", "n", "wide", "digest"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n", "long").add("wide", "long").add("digest", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tiers(n: int, wide: int, options: Join) -> list[int]:
    """The tiers of a set: any two sets that can link have one in common in which they must meet."""
    found = []
    if n > options.small:
        found.append(WIDE)
        if wide <= n - least_overlap(n, options.percent):
            found.append(ODD)
    if n * options.percent <= options.small * 100:
        found.append(SMALL)
    return found


def by_cell(cells: np.ndarray):
    """The values of sorted cells, with their ranges."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
        yield int(cells[a]), slice(a, b)


ENTRY = np.dtype([("number", "<u8"), ("name", "<i8")])
PACKED = np.dtype([("low", "<u4"), ("name", "<i8")])


def shared_shingles(docs: DataFrame, total: int, options: Join) -> DataFrame:
    """(name, tier, number, sets): every shingle of a tier that at least two sets of it have; stored.

    A shingle's number is its hash shortened to a cell of the hash range and 32 bits, and the tier.  Two shingles of one
    number count as one; where they are of one set, a row with 0 `sets` tells in `number` how many numbers the set
    has less than shingles, so that its numbers are compared with its numbers.  Cells grow in number with the corpus.
    """
    bits = max(4, int(total // 1_000_000).bit_length())

    def emit(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        size = [len(x) for _, _, x in held]
        hashes = np.concatenate([x for _, _, x in held])
        rows = np.zeros(len(hashes), ENTRY)
        tier = np.repeat(np.array([t for _, t, _ in held], np.uint64), size)
        rows["number"] = (hashes >> np.uint64(32 - bits)) | (tier << np.uint64(62))
        rows["name"] = np.repeat(np.array([n for n, _, _ in held], np.int64), size)
        rows = rows[np.argsort(rows["number"], kind="stable")]
        number = rows["number"]
        starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        times = np.diff(np.append(starts, len(rows)))
        crowded = np.repeat(times > options.crowd, times)
        out = []
        if crowded.any():  # out of the cells, by document; a mark in the cell tells the others
            loose = rows[crowded]
            loose = loose[np.argsort(loose["name"], kind="stable")]
            for cell, part in by_cell(-1 - (loose["name"] & ((1 << bits) - 1)).astype(np.int64)):
                out.append((cell, loose[part].tobytes()))
            marks = rows[starts[times > options.crowd]].copy()
            rows = np.concatenate((rows[~crowded], marks))
            mark = np.concatenate((np.zeros((~crowded).sum(), bool), np.ones(len(marks), bool)))
        else:
            mark = np.zeros(len(rows), bool)
        cells = (rows["number"] >> np.uint64(32)).astype(np.int64)
        cells = (cells & ((1 << 30) - 1)) << 3 | (cells >> 30) << 1 | mark
        order = np.argsort(cells, kind="stable")
        packed = np.zeros(len(rows), PACKED)
        packed["low"], packed["name"] = rows["number"].astype(np.uint32), rows["name"]
        packed = packed[order]
        out += [(cell, packed[part].tobytes()) for cell, part in by_cell(cells[order])]
        return pa.RecordBatch.from_arrays(
            [pa.array([c >> 1 if c >= 0 else c for c, _ in out], pa.int64()), pa.array([c >= 0 and bool(c & 1) for c, _ in out], pa.bool_()),
             pa.array([r for _, r in out], pa.binary())], ["cell", "mark", "rows"])

    def scatter(batches):
        let_go()
        held, size, seen = [], 0, set()
        fewer: list[tuple[int, int, int]] = []
        for batch in batches:
            for part in text_slices(batch, "text"):
                for own in shingle_sets(part.column("text"), options.k):
                    if not len(own) or (whole := digest(own)) in seen:
                        continue
                    seen.add(whole)
                    wide = int(np.searchsorted(own, options.limit))
                    for tier in tiers(len(own), wide, options):
                        held.append((short_name(whole), tier, own[:wide] if tier == WIDE else own))
                        size += len(held[-1][2])
                        numbers = held[-1][2] >> np.uint64(32 - bits)  # in order
                        if (less := int((numbers[1:] == numbers[:-1]).sum())):
                            fewer.append((short_name(whole), tier, less))
                if size > options.flush:
                    yield emit(held)
                    held, size, seen = [], 0, set()
                if fewer:
                    yield told(fewer)
                    fewer.clear()
        if size:
            yield emit(held)

    def told(fewer: list[tuple[int, int, int]]) -> pa.RecordBatch:
        """How many numbers sets lack, below the cells of crowded shingles."""
        rows = [np.array([((tier << 62) | less, name)], ENTRY).tobytes() for name, tier, less in fewer]
        cells = [FEWER - (name & ((1 << bits) - 1)) for name, _, _ in fewer]
        return pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), pa.array([False] * len(rows), pa.bool_()), pa.array(rows, pa.binary())], ["cell", "mark", "rows"])

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        if cell < 0:
            rows = np.unique(np.frombuffer(b"".join(frame["rows"]), ENTRY))
            number, name = rows["number"], rows["name"]
            times = np.full(len(rows), CROWDED if cell > FEWER else 0)
        else:
            rows = np.unique(np.frombuffer(b"".join(frame["rows"][~frame["mark"]]), PACKED))
            marked = np.unique(np.frombuffer(b"".join(frame["rows"][frame["mark"]]), PACKED)["low"])
            low, at, times = np.unique(rows["low"], return_inverse=True, return_counts=True)
            times = np.where(np.isin(low, marked), CROWDED, times)[at]
            rows, times = rows[times > 1], times[times > 1]
            number = (np.uint64(cell >> 2) << np.uint64(32)) | (np.uint64(cell & 3) << np.uint64(62)) | rows["low"].astype(np.uint64)
            name = rows["name"]
        return pd.DataFrame({
            "name": name, "tier": (number >> np.uint64(62)).astype(np.int32), "number": number.view(np.int64),
            "sets": times.astype(np.int32)})

    rows = docs.select("text").mapInArrow(scatter, "cell long, mark boolean, rows binary")
    return stored(rows.groupBy("cell").applyInPandas(meet, "name long, tier int, number long, sets int"), "shared")


def regions(shared: DataFrame, classes: DataFrame, options: Join) -> DataFrame:
    """(pivot, member) by short names of digests: distinct, without a pivot's own row; stored."""
    sized = classes.select(name_of("digest").alias("name"), "n", "wide")
    # all but so many of a set's shingles are in a linked set, and so are all but so many of a tier's
    spare = F.col("n") - F.floor((options.percent * F.col("n") + 99) / 100)
    # the numbers of a set, which are fewer than its shingles if several have one
    low = F.col("number").bitwiseAND((1 << 62) - 1)
    fewer = F.coalesce(F.max(F.when(F.col("sets") == 0, low)), F.lit(0))
    counts = shared.groupBy("name", "tier").agg(F.count_if(F.col("sets") > 0).alias("common"), fewer.alias("fewer")).join(sized, "name")
    whole = F.when(F.col("tier") == WIDE, F.col("wide")).otherwise(F.col("n")) - F.col("fewer")
    shared = shared.where("sets > 0")
    able = stored(
        counts.where(F.col("common") >= F.greatest(F.lit(1), whole - spare))
        .select("name", "tier", (spare + 1 - (whole - F.col("common"))).alias("left")).where("left > 0"), "able")
    # a set's own shingles come first in the order; `left` of its common ones are still in its first quarter
    rarest = Window.partitionBy("name", "tier").orderBy("sets", "number")
    first = (
        shared.join(able, ["name", "tier"]).withColumn("rank", F.row_number().over(rarest))
        .where(F.col("rank") <= F.col("left")).select("name", "number"))
    first = stored(first, "first-shingles")
    pivots = first.groupBy("number").agg(F.min("name").alias("pivot"), F.count("*").alias("sets")).where("sets > 1").select("number", "pivot")
    met = first.join(pivots, "number").where("pivot != name")
    return stored(met.select("pivot", F.col("name").alias("member")).distinct(), "regions")


def name_of(column: str):
    return F.conv(F.substring(column, 1, 16), 16, -10).cast("long")


def candidate_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, options: Join) -> DataFrame:
    """(name, digest, n, shingles) of the classes of all members; stored."""
    wanted = classes.withColumn("name", name_of("digest")).join(members, "name", "left_semi")
    wanted = stored(wanted.select("name", "digest", "n", "least"), "candidates")
    ids = stored(wanted.select(F.col("least").alias("doc_id")).distinct(), "candidate-ids")

    def run(batches):
        let_go()
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = list(shingle_sets(part.column("text"), options.k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(x) or None for x in own], pa.string()), pa.array([x.tobytes() for x in own], pa.binary())],
                    ["found", "shingles"])

    rows = docs.select("doc_id", "text").join(checked_broadcast(ids, bound=BROADCAST_IDS), "doc_id", "left_semi")
    found = rows.select("text").mapInArrow(run, "found string, shingles binary")
    own = found.hint("merge").join(wanted, F.col("found") == F.col("digest"))
    return stored(own.select("name", "digest", "n", "shingles").dropDuplicates(["digest"]), "sets")


class Block:
    """Documents of one task: an exact join that skips what is known to be one component."""

    def __init__(self, shingles: list[np.ndarray], group: list[int], options: Join):
        self.options = options
        self.n = np.array([len(x) for x in shingles], np.int64)
        flat = np.concatenate(shingles)
        values, self.flat = np.unique(flat, return_inverse=True)
        self.start = np.cumsum(self.n) - self.n
        self.mask = np.zeros(len(values), bool)
        self.root = np.array(group)
        self.links: list[tuple[int, int]] = []

    def overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of document x with others."""
        own = self.flat[self.start[x] : self.start[x] + self.n[x]]
        self.mask[own] = True
        n = self.n[others]
        ends = np.cumsum(n)
        at = np.repeat(self.start[others] - (ends - n), n) + np.arange(ends[-1])
        out = np.add.reduceat(self.mask[self.flat[at]].astype(np.int64), ends - n)
        self.mask[own] = False
        return out

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances; links that they show are noted."""
        both = self.overlaps(x, others)
        either = self.n[x] + self.n[others] - both
        for y in others[100 * both >= self.options.percent * either].tolist():
            if self.root[x] != self.root[y]:
                self.links.append((x, y))
                self.root[self.root == self.root[y]] = self.root[x]
        return 1 - both / either

    def join(self, probes: np.ndarray, data: np.ndarray) -> None:
        """Find a spanning set of the links between probes and data."""
        reach = 1 - self.options.percent / 100 + 1e-9
        roots = self.root[np.concatenate((probes, data))]
        if not len(probes) or not len(data) or (roots == roots[0]).all():
            return
        if len(data) > 32 and len(probes) > self.options.pivots:
            pivots = probes[np.linspace(0, len(probes) - 1, self.options.pivots).astype(int)]
            everyone = np.union1d(probes, data)
            far = np.array([self.distances(p, everyone) for p in pivots.tolist()])
            column = {d: i for i, d in enumerate(everyone.tolist())}
            own = np.array([column[d] for d in probes.tolist()])
            there = np.array([column[d] for d in data.tolist()])
            home = far[:, own].argmin(0)
            for cell, pivot in enumerate(pivots.tolist()):
                mine = (home == cell) & (probes != pivot)
                if not mine.any():
                    continue
                at = far[cell, own[mine]]
                window = (far[cell, there] <= at.max() + reach) & (far[cell, there] >= at.min() - reach)
                inside, near = probes[mine], data[window]
                if len(inside) <= 0.7 * len(probes) or len(near) <= 0.7 * len(data):
                    self.join(inside, near)
                else:
                    self.compare(inside, near, far[:, own[mine]], far[:, there[window]], reach)
            return
        self.compare(probes, data, None, None, reach)

    def compare(self, probes, data, far_probes, far_data, reach) -> None:
        percent = self.options.percent
        for i, x in enumerate(probes.tolist()):
            fits = (self.root[data] != self.root[x]) & (100 * np.minimum(self.n[data], self.n[x]) >= percent * np.maximum(self.n[data], self.n[x]))
            if far_probes is not None:
                fits &= (np.abs(far_data - far_probes[:, i : i + 1]) <= reach).all(0)
            if fits.any():
                self.distances(x, data[fits])


def joined(tasks: DataFrame, sets: DataFrame, options: Join) -> DataFrame:
    """Links (a, b) by digest of tasks (task, name, probe, body, component): probes are joined with the body."""

    def solve(rows: list[tuple]) -> list[tuple[str, str]]:
        number: dict[str, int] = {}
        group = [number.setdefault(r[3], len(number)) for r in rows]
        block = Block([np.frombuffer(r[4], np.uint64) for r in rows], group, options)
        probes = np.flatnonzero([r[1] for r in rows])
        block.join(probes, np.flatnonzero([r[2] for r in rows]))
        return [(rows[x][0], rows[y][0]) for x, y in block.links]

    def run(batches):
        task, rows = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("task", "digest", "probe", "body", "component", "shingles")]
            for name, *row in zip(*columns):
                if name != task:
                    if len(rows) > 1:
                        found += solve(rows)
                    task, rows = name, []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["a", "b"])
        if len(rows) > 1:
            found = solve(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["a", "b"])

    whole = tasks.join(sets.select("name", "digest", "shingles"), "name").select(
        "task", "digest", "probe", "body", "component", "shingles")
    return whole.repartition("task").sortWithinPartitions("task", "digest").mapInArrow(run, "a string, b string")


def links(docs: DataFrame, classes: DataFrame, total: int, options: Join) -> DataFrame:
    """(a, b): links between digests that connect what is connected; stored."""
    near = regions(shared_shingles(docs, total, options), classes, options)
    near = near.union(near.select("pivot", F.col("pivot").alias("member")).distinct())
    sets = candidate_sets(docs, classes, near.select(F.col("member").alias("name")).distinct(), options)
    sized = near.join(sets.select(F.col("name").alias("member"), "n"), "member")
    whole = sized.groupBy("pivot").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    chunks = F.greatest(F.ceil(F.col("size") / options.leaf), F.ceil(F.col("shingles") / options.leaf_shingles))
    # only regions of several chunks have to be told to their members: few rows, sent to all tasks up to a counted bound
    several = stored(whole.select("pivot", chunks.cast("int").alias("several")).where("several > 1"), "large-regions")
    dealt = stored(sized.select("pivot", "member").join(checked_broadcast(several), "pivot", "left").select(
        "pivot", "member", F.coalesce("several", F.lit(1)).alias("chunks")), "dealt")
    chunk = F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")
    first = dealt.select("pivot", "member", "chunks", chunk.alias("chunk"))
    task = F.concat_ws(":", F.col("pivot").cast("string"), F.col("chunk").cast("string"))
    yes, no = F.lit(True), F.lit(False)
    own = first.select(task.alias("task"), F.col("member").alias("name"), yes.alias("probe"), yes.alias("body"))
    large = first.where("chunks > 1").select("pivot", "chunks").distinct()
    visits = large.select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    guests = visits.select(task.alias("task"), F.col("pivot").alias("name"), yes.alias("probe"), no.alias("body"))
    alone = own.union(guests).withColumn("component", F.concat_ws(":", "task", F.col("name").cast("string"), "body"))
    found = stored(joined(alone, sets, options), "links")
    if large.isEmpty():
        return found
    # second round, for large regions: what is not in a region's largest component meets all chunks
    groups = components(found)
    named = sets.select("name", "digest").join(groups, F.col("digest") == F.col("node"), "left").select(
        F.col("name").alias("member"), F.coalesce("component", "digest").alias("component"))
    placed = stored(first.where("chunks > 1").join(named, "member"), "placed")
    sizes = placed.groupBy("pivot", "component").agg(F.count("*").alias("size"))
    most = stored(sizes.groupBy("pivot").agg(F.max_by("component", F.struct("size", "component")).alias("main")), "main-components")
    rest = placed.join(checked_broadcast(most), "pivot").where("component != main")
    widths = checked_broadcast(stored(
        rest.groupBy("pivot").agg(F.ceil(F.count("*") / options.leaf).cast("int").alias("blocks")), "widths"))
    rest = rest.join(widths, "pivot").withColumn("block", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")).cast("int"))
    name = F.concat_ws(":", F.col("pivot").cast("string"), F.col("chunk").cast("string"), F.col("block").cast("string"))
    body = placed.join(widths, "pivot").select(
        "pivot", "member", "component", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    probe = rest.select(
        "pivot", "member", "component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    columns = (name.alias("task"), F.col("member").alias("name"))
    again = body.select(*columns, no.alias("probe"), yes.alias("body"), "component").union(
        probe.select(*columns, yes.alias("probe"), no.alias("body"), "component"))
    return found.union(stored(joined(again, sets, options), "links"))


def class_components(docs: DataFrame, rows: DataFrame, options: Join) -> DataFrame:
    """(class, component_id, root) for each digest of rows (as of `shingled`), root being one digest a component; stored."""
    classes = stored(
        rows.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("wide").alias("wide")), "classes")
    total = classes.agg(F.sum("n")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame(
            [], T.StructType([T.StructField("class", T.StringType()), T.StructField("component_id", classes.schema["least"].dataType),
                              T.StructField("root", T.StringType())]))
    groups = stored(components(links(docs, classes, total, options)), "groups")
    grouped = classes.join(groups, F.col("digest") == F.col("node"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = grouped.select(F.col("digest").alias("moved"), "component").join(lowest, "component")
    return stored(
        classes.join(moved, F.col("digest") == F.col("moved"), "left")
        .select(F.col("digest").alias("class"), F.coalesce("component_id", "least").alias("component_id"),
                F.coalesce("component", "digest").alias("root")),
        "class-components", keep=True)


def near_groups(docs: DataFrame, options: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, digest) for each row of docs (columns doc_id, text).

    component_id is the smallest doc_id that links lead to, its own included.
    """
    return rooted_groups(docs, options).drop("root")


def rooted_groups(docs: DataFrame, options: Join) -> DataFrame:
    """The columns of `near_groups`, and `root`: one digest of each component."""
    rows = stored(shingled(docs, options), "shingled")
    with scratch(docs.sparkSession):
        named = class_components(docs, rows, options)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.hint("merge").join(named, F.col("digest") == F.col("class"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "digest", "root")


def keep_one(docs: DataFrame, options: Join = Join()) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id, and of the least digest among its texts.

    Rows that repeat a doc_id and a text, or one with the same shingles, are one document; rows of one doc_id with other
    texts are judged each by its own text.  Texts without a shingle and rows without a doc_id stay.
    """
    names = docs.columns
    groups = stored(rooted_groups(docs, options), "near-groups")
    gone = stored(groups.where("component_id != doc_id").select(F.col("doc_id").alias("other_id")).distinct(), "gone")
    same = F.col("doc_id") == F.col("other_id")
    twice = stored(
        groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("other_id")).count().where("count > 1")
        .select("other_id"), "repeated")
    if twice.isEmpty():
        return docs.join(checked_broadcast(gone, bound=BROADCAST_IDS), same, "left_anti").select(names)
    twice = checked_broadcast(twice, bound=BROADCAST_IDS)
    once = docs.join(twice, same, "left_anti").join(checked_broadcast(gone, bound=BROADCAST_IDS), same, "left_anti")
    first = stored(
        groups.join(twice, same, "left_semi").where("component_id = doc_id and digest is not null")
        .groupBy("root", F.col("doc_id").alias("other_id")).agg(F.min("digest").alias("first")).select("other_id", "first"), "first")
    repeated = docs.join(twice, same, "left_semi").select(F.col("doc_id"), "text", F.struct(*names).alias("row"))
    repeated = digested(repeated, options)
    chosen = repeated.join(checked_broadcast(first), same & (F.col("digest") == F.col("first")), "left_semi")
    # one row of each text, whichever it is; of texts with the same shingles the least
    chosen = chosen.groupBy("doc_id", "digest").agg(F.min_by("row", "text").alias("row"))
    empty = repeated.where("digest is null").dropDuplicates(["doc_id", "text"])
    return once.select(names).union(chosen.select("row.*")).union(empty.select("row.*")).select(names)
