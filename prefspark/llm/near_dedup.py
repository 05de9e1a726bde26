"""Operator 10: near-duplicate documents by Order MinHash, verified by banded alignment.

Equal texts are one class from the start (a digest, pre-aggregated), so copies cost nothing
further. Each distinct text gives occurrence-labelled 5-word shingles. For each of SLOTS hash
orders the WIDTH minimal ones are taken, put back in text order and hashed; ROWS of these
tuples make a band. Distinct texts that share a band are all compared, unless they are in one
class already: a first round pairs each with two of the band's members and with a neighbour (see
``pairs_in_bands``); in bands that then still hold several components, all pairs across them are
tried (see ``band_components``). A pair holds if the
longest common subsequence L of the two shingle sequences, by an alignment within a band around
the diagonal, gives L / (n + m - L) >= THRESHOLD. The band begins narrow and widens up to the
width that any such alignment can need, so the verdict is exact. Components of verified pairs
are the classes.

Edge cases: a text of fewer than five words is one shingle; texts without words are one class
(equal after white space), apart from nothing else; null text is the empty text; a class's id is
its least doc_id (null only if all are); rows that repeat id and text share one row's fate in
``classes``, and one of them stays in ``keep_one``; an empty table gives an empty result. Only
the id and text columns are read, and ``keep_one`` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.blocks import settle
from prefspark.llm.components import components
from prefspark.llm.shingles import mix, shingles, unit_starts, words

THRESHOLD = 0.8
BANDS, ROWS, WIDTH = 16, 2, 2
SLOTS = BANDS * ROWS
CELLS = 2_000_000  # of the alignments done at once
TILE = 2048  # members of a band handled against as many others in one group of rows
TILE_BYTES = 8_000_000  # and so many bytes of their sequences
STEP = 1024  # members whose overlaps are counted at once
DENSE = 64  # a token that more than one pair in so many has is counted by a matrix product
PAIRS = 256  # verified at once, between looks at what they have joined


def digest(text: Column) -> Column:
    """Sixteen bytes that stand for a text (null: the empty text)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def occurrence_labelled(h: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Hashes in which the second, third, ... equal shingle of a unit differs from the first."""
    if len(h) < 2:
        return h
    near = np.sort((unit.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    suspects = np.unique(near[1:][near[1:] == near[:-1]] >> np.uint64(40))
    at = np.flatnonzero(np.isin(unit, suspects.astype(unit.dtype)))
    if not len(at):
        return h
    order = at[np.lexsort((at, h[at], unit[at]))]
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (unit[order][1:] == unit[order][:-1])])
    runs = np.flatnonzero(~same)
    number = np.arange(len(order)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(order)]])))
    out = h.copy()
    out[order] = np.where(number > 0, mix(h[order] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h[order])
    return out


def sketch(h: np.ndarray, unit: np.ndarray, slots: int = SLOTS, width: int = WIDTH) -> np.ndarray:
    """(units, slots) tuple hashes of the occurrence-labelled shingles ``h``, given in text order.

    A shingle's place goes below its value in the slot's order, so one minimum gives both.
    """
    starts = unit_starts(unit)
    out = np.empty((len(starts), slots), np.uint64)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << max(26, len(h).bit_length())) - 1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(slots):
        odd = np.uint64((2 * s + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF | 1)
        order = ((h ^ (odd >> np.uint64(3))) * odd & ~low) | place
        chosen = []
        for _ in range(width):
            least = np.minimum.reduceat(order, starts)
            at = (least & low).astype(np.int64)
            chosen.append(np.where(least == none, chosen[-1], at) if chosen else at)  # too few: the last one again
            order[chosen[-1]] = none
        tuple_hash = np.full(len(starts), s, np.uint64)
        for at in np.sort(np.stack(chosen), axis=0):
            tuple_hash = mix(tuple_hash * np.uint64(0x94D049BB133111EB) + h[at])
        out[:, s] = tuple_hash
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, bands (array<long>) and another sketch of each text that has words."""
    for batch in batches:
        for w in words(batch.column(1)):
            h, unit = shingles(w.hashes, w.row)
            if not len(h):
                continue
            slots = sketch(occurrence_labelled(h, unit), unit)
            bands = np.zeros((len(slots), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(0xBF58476D1CE4E5B9) + slots[:, r::ROWS])
            bands += np.arange(BANDS, dtype=np.uint64)
            rows = pa.array(unit[unit_starts(unit)] + w.first_row)
            bands_column = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), bands_column], names=["key", "bands"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (band, sketch, key) in order: pairs of neighbours with the same band."""
    last_band, last_key = None, None
    for batch in batches:
        if not len(batch):
            continue
        band, keys = batch.column(0).to_numpy(), batch.column(2)
        same = np.flatnonzero(band[1:] == band[:-1])
        left, right = keys.take(pa.array(same)).to_pylist(), keys.take(pa.array(same + 1)).to_pylist()
        if last_band is not None and last_band == band[0]:
            left.append(last_key)
            right.append(keys[0].as_py())
        last_band, last_key = band[-1], keys[-1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(left, keys.type), pa.array(right, keys.type)], names=["a", "b"])


def spread_bands(rows: DataFrame) -> DataFrame:
    """(band, key, other) of each key of ``rows`` (key, text; equal texts have equal keys)."""
    bands = rows.select("key", "text").mapInArrow(_sketches, "key binary, bands array<bigint>")
    bands = settle(bands.dropDuplicates(["key"]), "near-bands")
    spread = bands.select("key", F.explode("bands").alias("band"), F.element_at("bands", 1).alias("b1"), F.element_at("bands", BANDS).alias("b2"))
    return spread.select("key", "band", F.when(F.col("band") == F.col("b1"), F.col("b2")).otherwise(F.col("b1")).alias("other"))


def shared_bands(spread: DataFrame) -> DataFrame:
    """Distinct rows (band, key, other: a second sketch of the key) of the bands of several keys, with their number n and the least key."""
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    return settle(spread.join(sizes, "band"), "shared-bands")


def pairs_in_bands(spread: DataFrame) -> DataFrame:
    """Pairs (a < b) of ``shared_bands`` to verify first.

    A band's keys are paired with three of their number: with the key that meets
    most keys over all its bands (an original meets its copies more often than these meet one
    another), with the least key, and with the neighbour in the order of ``other``.
    """
    weights = spread.groupBy("key").agg(F.sum("n").alias("weight"))
    spread = spread.join(weights, "key")
    pivots = spread.groupBy("band").agg(F.max(F.struct("weight", "key"))["key"].alias("pivot"))
    star = spread.join(pivots, "band").select("key", F.explode(F.array("pivot", "least")).alias("to")).where("key != to").select(F.col("key").alias("a"), F.col("to").alias("b"))
    kind = spread.schema["key"].dataType.simpleString()
    ordered = spread.select("band", "other", "key").repartitionByRange("band", "other", "key").sortWithinPartitions("band", "other", "key")
    chain = ordered.mapInArrow(_neighbours, f"a {kind}, b {kind}")
    return star.unionByName(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the shingles of each text in order, as 32-bit hashes."""
    for batch in batches:
        for w in words(batch.column(1)):
            h, unit = shingles(w.hashes, w.row)
            starts = unit_starts(unit)
            ends = np.concatenate([starts[1:], [len(h)]]).astype(np.int64)
            low = (h >> np.uint64(32)).astype("<u4")
            rows = pa.array(unit[starts] + w.first_row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["key", "sequence"])


def common_in_band(left: list[np.ndarray], right: list[np.ndarray], half: int) -> np.ndarray:
    """Longest common subsequence of each pair, with |i - j| <= ``half`` for matched places."""
    n, m = max(map(len, left)), max(map(len, right))
    size = 2 * half + 1
    a = np.full((len(left), n), -1, np.int64)
    b = np.full((len(left), max(m, n) + size), -2, np.int64)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        a[k, : len(x)] = x
        b[k, half : half + len(y)] = y
    best = np.zeros((len(left), size), np.int32)  # column c: j = i + c - half
    for i in range(n):
        best += b[:, i : i + size] == a[:, i : i + 1]  # one diagonal step, with a match or without
        # from the row above, same j: it was one column to the right
        np.maximum(best[:, :-1], before[:, 1:], out=best[:, :-1]) if i else None
        np.maximum.accumulate(best, axis=1, out=best)
        before = best.copy()
    return best.max(axis=1)


def _similarity(common: int, n: int, m: int) -> float:
    return common / (n + m - common) if n + m > common else 1.0


def verify(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> list[bool]:
    """Whether each pair of sequences aligns to at least ``threshold``; exact."""
    verdict = [False] * len(pairs)
    waiting = []
    for k, (x, y) in enumerate(pairs):
        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
            continue
        if not len(x):
            verdict[k] = True
            continue
        (u, cu), (v, cv) = (np.unique(z, return_counts=True) for z in (x, y))
        both, iu, iv = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if _similarity(int(np.minimum(cu[iu], cv[iv]).sum()), len(x), len(y)) >= threshold:  # no alignment has more matches
            waiting.append(k)
    half = 8
    while waiting:
        waiting.sort(key=lambda k: len(pairs[k][0]))
        later, at = [], 0
        while at < len(waiting):
            to = at + 1
            while to < len(waiting) and (to - at + 1) * (len(pairs[waiting[to]][0]) + 2 * half) <= CELLS and len(pairs[waiting[to]][0]) <= 2 * len(pairs[waiting[at]][0]) + 50 and to - at < 256:
                to += 1
            group = waiting[at:to]
            for k, common in zip(group, common_in_band([pairs[k][0] for k in group], [pairs[k][1] for k in group], half), strict=True):
                n, m = len(pairs[k][0]), len(pairs[k][1])
                if _similarity(int(common), n, m) >= threshold:
                    verdict[k] = True
                elif half < (1 - threshold) / (1 + threshold) * (n + m):  # unmatched places bound the drift from the diagonal
                    later.append(k)
            at = to
        waiting, half = later, half * 4
    return verdict


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        holds = pa.array(verify(pairs), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(holds), batch.column(1).filter(holds)], names=["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of common elements of sets."""
    out = np.zeros((len(left), len(right)))
    tokens, owners = zip(*[(np.concatenate(side), np.repeat(np.arange(len(side)), list(map(len, side)))) for side in (left, right)], strict=True)
    ids = np.intersect1d(*tokens)
    if not len(ids):
        return out
    entries = []
    for t, o in zip(tokens, owners, strict=True):
        at = np.minimum(np.searchsorted(ids, t), len(ids) - 1)
        hit = ids[at] == t
        order = np.argsort(at[hit], kind="stable")
        entries.append((at[hit][order], o[hit][order]))
    counts = [np.bincount(at, minlength=len(ids)) for at, _ in entries]
    meetings = counts[0] * counts[1]
    often = meetings * DENSE > out.size
    columns = np.flatnonzero(often)
    for c in range(0, len(columns), STEP):
        some = columns[c : c + STEP]
        sides = []
        for (at, owner), n in zip(entries, out.shape, strict=True):
            s, e = np.searchsorted(at, [some[0], some[-1] + 1])
            mine = often[at[s:e]]
            matrix = np.zeros((n, len(some)), np.float32)
            matrix[owner[s:e][mine], np.searchsorted(some, at[s:e][mine])] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    rows = np.flatnonzero(~often[entries[0][0]])
    at, owner = entries[0][0][rows], entries[0][1][rows]
    first = np.cumsum(counts[1]) - counts[1]  # of each token's entries on the right
    done = np.cumsum(counts[1][at])
    s = 0
    while s < len(at):
        e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + CELLS, "right")))
        n = counts[1][at[s:e]]
        partner = np.repeat(first[at[s:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(owner[s:e], n) * out.shape[1] + entries[1][1][partner], minlength=out.size).reshape(out.shape)
        s = e
    return out


Verify = Callable[[list[tuple[np.ndarray, np.ndarray]]], list[bool]]


def links_in_group(side: list[int], roots: list, sequences: list[np.ndarray], same: bool, verify_pairs: Verify, threshold: float) -> list[tuple[int, int]]:
    """Verified pairs of places that join all similar members with different roots; ``side`` is 0 or 1 if two tiles meet.

    No alignment has more matches than the multisets of shingles, so pairs below that bound are left out.
    """
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    parent = np.arange(len(number))
    root = np.array([number[r] for r in roots])

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array(list(map(len, sequences)), np.int64)
    labelled = occurrence_labelled(np.concatenate(sequences).astype(np.uint64) << np.uint64(32), np.repeat(np.arange(len(sequences)), sizes))
    tokens = np.split(labelled, np.cumsum(sizes)[:-1])
    # Members of nearly one size are next to one another, so that whole blocks can fail the size filter.
    places = np.argsort(sizes, kind="stable")
    sides = np.array(side)
    first = places[sides[places] == 0]
    second = first if same else places[sides[places] == 1]
    found = []
    for i in range(0, len(first), STEP):
        for j in range(i if same else 0, len(second), STEP):
            a, b = first[i : i + STEP], second[j : j + STEP]
            if sizes[a[-1]] < threshold * sizes[b[0]] or sizes[b[-1]] < threshold * sizes[a[0]]:
                continue
            here = np.array([find(x) for x in range(len(parent))])[root]
            apart = here[a][:, None] != here[b][None, :]
            if same and i == j:
                apart &= np.triu(np.ones(apart.shape, bool), 1)
            rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(rows):
                continue
            a, b = a[rows], b[columns]
            common = overlaps([tokens[k] for k in a], [tokens[k] for k in b])
            likely = apart[np.ix_(rows, columns)] & (common * (1 + threshold) >= threshold * (sizes[a][:, None] + sizes[b][None, :]) - 1e-6)
            pairs = np.argwhere(likely)
            for at in range(0, len(pairs), PAIRS):
                waiting = [(a[x], b[y]) for x, y in pairs[at : at + PAIRS] if find(root[a[x]]) != find(root[b[y]])]
                for (x, y), holds in zip(waiting, verify_pairs([(sequences[x], sequences[y]) for x, y in waiting]), strict=True):
                    if holds and find(root[x]) != find(root[y]):
                        parent[find(root[x])] = find(root[y])
                        found.append((int(x), int(y)))
    return found


def _band_links(verify_pairs: Verify, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (band, i, j, side, key, root, sequence), sorted by group: links (a, b) between different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: tuple, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            found = links_in_group([r[0] for r in rows], [r[2] for r in rows], [np.frombuffer(r[3], "<u4") for r in rows], group[1] == group[2], verify_pairs, threshold)
            return pa.RecordBatch.from_arrays([pa.array([rows[pair[k]][1] for pair in found], kind) for k in (0, 1)], names=["a", "b"])

        group, rows, kind = None, [], None
        for batch in batches:
            kind = batch.column(4).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group:
                    if rows:
                        yield done(group, rows, kind)
                    group, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield done(group, rows, kind)

    return run


def band_components(shared: DataFrame, links: DataFrame, sequences: DataFrame, verify_pairs: Verify, threshold: float) -> DataFrame:
    """(node, root) of the components that all similar pairs of ``shared_bands`` make.

    ``links`` (a, b) are the pairs that the first round has verified, ``sequences`` (key, sequence) the
    shingles of every key. Bands whose members are still in several components are compared whole, in
    tiles if they are large; only pairs across components can change anything.
    """
    roots = components(links)
    members = shared.where("n > 2").select("band", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    mixed = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    members = settle(members.join(mixed, "band").join(sequences.select("key", F.length("sequence").alias("size")), "key"), "mixed-bands")
    if not members.head(1):
        return roots
    tiles = members.groupBy("band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("size") / TILE_BYTES)).cast("int").alias("tiles"))
    dealt = members.join(tiles, "band").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("band", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "key", "root")
    grouped = dealt.join(sequences, "key").select("band", "i", "j", "side", "key", "root", "sequence").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = shared.schema["key"].dataType.simpleString()
    more = grouped.mapInArrow(_band_links(verify_pairs, threshold), f"a {kind}, b {kind}")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def linked(rows: DataFrame) -> DataFrame:
    """(node, root) of the classes of keys of ``rows`` (key, doc_id, text; equal texts have equal keys)."""
    shared = shared_bands(spread_bands(rows))
    pairs = settle(pairs_in_bands(shared), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # One row of each text goes on: that with the least id.
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first")).join(ends, "key", "left_semi")
    r, f = rows.alias("r"), first.alias("f")
    chosen = r.join(f, (F.col("r.key") == F.col("f.key")) & F.col("r.doc_id").eqNullSafe(F.col("f.first")), "left_semi")
    sequences = chosen.select("key", "text").mapInArrow(_sequences, "key binary, sequence binary").dropDuplicates(["key"])
    sequences = settle(sequences, "near-sequences")
    left = pairs.join(sequences.select(F.col("key").alias("a"), F.col("sequence").alias("x")), "a")
    both = left.join(sequences.select(F.col("key").alias("b"), F.col("sequence").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verified, "a binary, b binary")
    return band_components(shared, links, sequences, verify, THRESHOLD)


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, number of such rows, class_id, class_size and whether one of them is the one to keep."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), digest(text).alias("key"), text.alias("text"))
    keys = rows.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    roots = linked(rows).select(F.col("node").alias("key"), "root")
    rooted = settle(keys.join(roots, "key", "left").select("key", "doc_id", "n", F.coalesce("root", "key").alias("root")), "near-roots")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    classes = rooted.groupBy("root").agg(first.alias("first"), F.sum("n").alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return rooted.join(classes, "root").select("key", "doc_id", "n", F.col("first.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size, kept (one row of each class)."""
    decided = _decided(docs, id_col, text_col)
    each = decided.select("doc_id", "class_id", "class_size", "kept", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select("doc_id", "class_id", "class_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without all but one row of each class."""
    decided = settle(_decided(docs, id_col, text_col), "near-decisions")
    names = {c: f"near_{i}" for i, c in enumerate(docs.columns)}  # no clash with the decision's columns
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()]).withColumn("key", digest(F.col(names[text_col])))
    same = rows["key"].eqNullSafe(decided["key"]) & rows[names[id_col]].eqNullSafe(decided["doc_id"])
    out = rows.join(decided.where("not kept"), same, "left_anti")
    repeated = decided.where("kept and n > 1")
    if repeated.head(1):  # rows that repeat the kept one
        several = out.join(repeated, same, "left_semi").dropDuplicates(["key", names[id_col]])
        out = out.join(repeated, same, "left_anti").unionByName(several)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
