"""Operator 7: line dedup by an exact set-similarity join.

A line's tokens are its words, numbered by occurrence (the second "the" is another token than the
first). They are ordered by rarity: by how often their word's bucket of a fixed-size count table,
made over all lines, was met, then by hash. Two lines with a Jaccard of at least THRESHOLD share
one of the first size - ceil(THRESHOLD * size) + 1 tokens of either, so lines are matched on these
prefixes only.

1. Count table over all lines, and which words (by a hash of WORD_BITS) occur once.
2. Prefix entries (token, class of equal sets, size, position, parity bits, token before),
   in columnar blocks by token; none for words that occur once. Within a token's group, a task keeps the entries that have a
   partner which passes the length filter, the positional filter (the tokens that are left after
   it bound the overlap) and the parity filter (each token that only one of two lines has flips
   one bit at most, so the bits that differ bound the difference); lines that have the same
   token before this one share an earlier token, where their pair is looked for instead. Groups
   over SCAN entries are kept by length alone.
3. A token's group goes by its least class, then by the least such class of its lines: near copies
   share many tokens, whose groups then are one, and a line's set travels once for each group.
4. Within a group (split in tiles, by lines or by bytes) overlaps are counted by matrix products
   and no pair is written. A pair counts in the least group that both lines are in, and holds by
   its exact Jaccard.

A line is removed if an earlier line (by document id, nulls last, the text's hash, and line)
is similar to it; earlier lines count whether or not they are removed themselves.

Edge cases: ids are cast to long; lines without words are no lines here and stay; null text has none and stays null;
rows that repeat id and text are one document and share its decisions; equal sets in another
order of words are similar; an empty table gives an empty result. Further columns of the input
stay, under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm import blocks
from prefspark.llm.lines import cut_lines, document_hash, line_units
from prefspark.llm.shingles import Words, mix, unit_starts, words

THRESHOLD = 0.8
LEAST_TOKENS = 4  # smaller sets are similar to at least 0.8 only if they are equal
COUNT_BITS = 20
WORD_BITS = 24  # of the table that tells words met once
COUNT_PARTS = 64
TILE = 4096  # lines of a group handled against as many others in one group of rows
TILE_BYTES = 8 << 20  # of their tokens
PARITY_WORDS = 4  # of 64 bits; enough to tell apart lines of up to some 500 tokens
SCAN = 4096  # entries of a token's group that are tried pair by pair before their sets are fetched
CELLS = 8_000_000  # of a matrix


def _packed(flags: np.ndarray) -> list[bytes]:
    return [np.packbits(part).tobytes() for part in flags.reshape(COUNT_PARTS, -1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the coarse buckets, and which fine buckets were met once, and more than once, by part of the table."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    once, twice = np.zeros(1 << WORD_BITS, bool), np.zeros(1 << WORD_BITS, bool)
    for batch in batches:
        for w in words(batch.column(0)):
            counts += np.bincount((w.hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
            met = np.sort((w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
            twice[met[1:][met[1:] == met[:-1]]] = True
            twice[met[once[met]]] = True
            once[met] = True
    parts = np.minimum(counts, 0xFFFF).astype("<u2").reshape(COUNT_PARTS, -1)
    binary = [pa.array(c, pa.binary()) for c in ([p.tobytes() for p in parts], _packed(once), _packed(twice))]
    yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), *binary], names=["part", "counts", "once", "twice"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, once, twice = np.frombuffer(raw[0], "<u2").astype(np.int64), *(np.frombuffer(r, np.uint8) for r in raw[1:])
            if part in total:
                n, met, again = total[part]
                counts, once, twice = n + counts, met | once, again | twice | (met & once)
            total[part] = [counts, once, twice]
    columns = [[np.minimum(n, 2**32 - 1).astype("<u4").tobytes() for n, _, _ in total.values()], [t.tobytes() for _, _, t in total.values()]]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "counts", "twice"])


def rarity(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Seven-bit rank of each coarse bucket of words (its count on a logarithmic scale), and which fine buckets were met more than once, packed."""
    rows = texts.mapInArrow(_count, "part int, counts binary, once binary, twice binary").repartition("part").mapInArrow(_add, "part int, counts binary, twice binary")
    counts = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS))
    twice = np.zeros((COUNT_PARTS, (1 << WORD_BITS) // COUNT_PARTS // 8), np.uint8)
    for row in rows.collect():  # 2**COUNT_BITS counts and 2**WORD_BITS bits in all
        counts[row["part"]], twice[row["part"]] = np.frombuffer(row["counts"], "<u4"), np.frombuffer(row["twice"], np.uint8)
    return np.minimum(4 * np.log2(counts.ravel() + 1), 127).astype(np.uint8), twice.ravel()


def _token_sets(w: Words, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, rarest first, start of each line's tokens, first word of each line, 128-bit keys of the sets, the tokens' words)."""
    unit, word_starts = line_units(w)
    h = w.hashes
    number = np.cumsum(np.concatenate([[0], (unit[1:] != unit[:-1]).astype(np.int64)])) if len(h) else unit
    rarity_of = rank[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    order = None
    if len(h) and number[-1] < 1 << 21:  # line, rank and the hash's upper 36 bits in one integer
        key = (number.astype(np.uint64) << np.uint64(43)) | (rarity_of.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(key)
        k, v = key[order], h[order]
        if ((k[1:] == k[:-1]) & (v[1:] != v[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((h, rarity_of, number))
    h, number = h[order], number[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(fresh)
    occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
    word, again = h.copy(), occurrence > 0
    h[again] = mix(h[again] + occurrence[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    starts = unit_starts(number)
    keys = np.empty((len(starts), 2), np.uint64)
    if len(starts):
        keys[:, 0] = mix(np.add.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), starts))
        keys[:, 1] = mix(np.add.reduceat(mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)), starts))
    return h, starts, word_starts, keys, word


def _least_overlap(sizes: np.ndarray) -> np.ndarray:
    return np.ceil(THRESHOLD * sizes - 1e-9).astype(np.int64)


def _parity(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """PARITY_WORDS x 64 bits of each line: each token flips one."""
    flip, word = np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63)), (h >> np.uint64(26)) % np.uint64(PARITY_WORDS)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == c, flip, np.uint64(0)), starts) for c in range(PARITY_WORDS)], axis=1)


def _prefix_blocks(rarity_of: Callable[[], tuple[np.ndarray, np.ndarray]], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, twice = rarity_of()
        shared = np.unpackbits(twice).astype(bool)
        for batch in batches:
            for w in words(batch.column(0)):
                h, starts, _, keys, word = _token_sets(w, rank)
                sizes = np.diff(np.concatenate([starts, [len(h)]]))
                _, distinct = np.unique(keys[:, 0], return_index=True)  # equal lines of a slice give their entries once
                distinct = distinct[sizes[distinct] >= LEAST_TOKENS]
                if not len(distinct):
                    continue
                parity = _parity(h, starts)[distinct]
                starts, sizes, key = starts[distinct], sizes[distinct], keys[distinct, 0]
                n = sizes - _least_overlap(sizes) + 1
                place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                at, line = np.repeat(starts, n) + place, np.repeat(np.arange(len(n)), n)
                # A word that the whole corpus has once is in no other line.
                met = shared[(word[at] >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
                at, place, line = at[met], place[met], line[met]
                # The bucket comes from the token's lower half, so the upper half is enough within it.
                bucket = ((h[at] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                before = np.where(place > 0, h[np.maximum(at - 1, 0)] >> np.uint64(32), 0).astype("<u4")
                columns = [(h[at] >> np.uint64(32)).astype("<u4"), key[line], sizes[line].astype("<u4"), np.minimum(place, 0xFFFF).astype("<u2"), parity[line], before]
                yield blocks.packed(bucket, columns, ["token", "key", "size", "place", "parity", "before"])

    return run


class Entries(NamedTuple):
    """Entries of a prefix, sorted by token and size; ``before`` is the token ahead of it in the line (0 at the line's first)."""

    token: np.ndarray
    size: np.ndarray
    place: np.ndarray
    parity: np.ndarray
    before: np.ndarray


def may_be_similar(e: Entries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of entries of one token pass the positional and the parity filter, and may have it as their first common token."""
    total = e.size[i] + e.size[j]
    rest = np.minimum(e.size[i] - e.place[i], e.size[j] - e.place[j])
    differ = np.bitwise_count(e.parity[i] ^ e.parity[j]).sum(axis=1, dtype=np.int64)
    first = (e.before[i] != e.before[j]) | (e.place[i] == 0) | (e.place[j] == 0)
    return first & (rest * (1 + THRESHOLD) >= THRESHOLD * total - 1e-9) & (differ * (1 + THRESHOLD) <= (1 - THRESHOLD) * total + 1e-9)


def with_partner(e: Entries) -> np.ndarray:
    """Which of the sorted entries have one that they may be similar to in their token's group."""
    n, size = len(e.token), e.size
    starts = unit_starts(e.token)
    counts = np.diff(np.concatenate([starts, [n]]))
    ends, count = np.repeat(starts + counts, counts), np.repeat(counts, counts)
    out = np.zeros(n, bool)
    i, step = np.arange(n), 0
    while len(i):
        step += 1
        i = i[i + step < ends[i]]
        i = i[size[i] >= _least_overlap(size[i + step])]  # a larger partner fails, too
        if step == 1:
            far = count[i] > SCAN
            out[i[far]] = out[i[far] + 1] = True
            i = i[~far]
        open_ = i[~(out[i] & out[i + step])]
        hit = open_[may_be_similar(e, open_, open_ + step)]
        out[hit] = out[hit + step] = True
    return out


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, first half of a key, size) of the entries that may have a similar partner in their token's group."""
    buckets, held = [], []
    for batch in batches:
        held.append(batch)
        buckets.append(np.repeat(batch.column(0).to_numpy(), [len(raw) // 4 for raw in batch.column(1).to_pylist()]))
    token, key, size, place, parity, before = blocks.unpacked(held, ["<u4", "<u8", "<u4", "<u2", "<u8", "<u4"])
    token = token.astype(np.uint64) | (np.concatenate([*buckets, np.zeros(0, np.int32)]).astype(np.uint64) << np.uint64(32))
    order = np.lexsort((key, size, token))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (token[order][1:] != token[order][:-1]) | (key[order][1:] != key[order][:-1])
    order = order[fresh]
    entries = Entries(token[order], size[order].astype(np.int64), place[order].astype(np.int64), parity.reshape(-1, PARITY_WORDS)[order], before[order])
    kept = with_partner(entries)
    token, key, size = entries.token[kept], key[order][kept].view(np.int64), entries.size[kept]
    starts = unit_starts(token)
    group = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.concatenate([starts, [len(key)]]))) if len(key) else key
    order = np.lexsort((key, group))
    order = order[np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])])] if len(order) else order
    yield pa.RecordBatch.from_arrays([pa.array(group[order]), pa.array(key[order]), pa.array(size[order])], names=["group", "k1", "size"])


def _lines(rarity_of: Callable[[], tuple[np.ndarray, np.ndarray]], wanted: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every line: document, line, key; tokens (32 bits each, rarest first) of those that may be in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hit = rarity_of()[0], wanted()
        for batch in batches:
            for w in words(batch.column(2)):
                h, starts, word_starts, keys, _ = _token_sets(w, rank)
                if not len(starts):
                    continue
                ends = np.concatenate([starts[1:], [len(h)]])
                low = (h >> np.uint64(32)).astype("<u4")
                take = pa.array(w.row[word_starts] + w.first_row)
                sets: list[bytes | None] = [None] * len(starts)
                for k in np.flatnonzero(hit[(keys[:, 0] & np.uint64(len(hit) - 1)).astype(np.int64)]):
                    sets[k] = low[starts[k] : ends[k]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(w.line[word_starts], pa.int32()), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(keys[:, 1].copy().view(np.int64)), pa.array(sets, pa.binary())],
                    names=["doc_id", "doc", "line", "k1", "k2", "tokens"],
                )

    return run


def _matrix(parts: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Which of the sorted ``ids`` each part has."""
    out = np.zeros((len(parts), len(ids)), np.float32)
    if len(ids):
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        values = np.concatenate(parts)
        at = np.searchsorted(ids, values)
        at[at == len(ids)] = 0
        met = ids[at] == values
        out[row[met], at[met]] = 1
    return out


def _shared(parts: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Values that occur on both sides."""
    return np.intersect1d(np.concatenate([*parts, np.zeros(0, parts[0].dtype)]), np.concatenate([*others, np.zeros(0, parts[0].dtype)]))


def similar_in_group(left: list[np.ndarray], right: list[np.ndarray], left_groups: list[np.ndarray], right_groups: list[np.ndarray]) -> np.ndarray:
    """(left, right) booleans: Jaccard at least THRESHOLD, and none of the lesser groups given is shared."""
    sizes = [np.array(list(map(len, side))) for side in (left, right)]
    total = sizes[0][:, None] + sizes[1][None, :]
    ids = _shared(left, right)
    common = (_matrix(left, ids) @ _matrix(right, ids).T).astype(np.float64)
    out = common * (1 + THRESHOLD) >= THRESHOLD * total - 1e-6
    lesser = _shared(left_groups, right_groups)
    if len(lesser):
        out &= _matrix(left_groups, lesser) @ _matrix(right_groups, lesser).T < 0.5
    return out


def _group_links(side: list[int], order: list[tuple], tokens: list[np.ndarray], lesser: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row and whether one goes to an earlier row; ``side`` is 0 or 1 if two tiles meet."""
    links, earlier = np.zeros(len(side), np.int64), np.zeros(len(side), bool)
    ranked = np.empty(len(side), np.int64)
    ranked[sorted(range(len(side)), key=order.__getitem__)] = np.arange(len(side))
    first = [k for k, s in enumerate(side) if s == 0]
    second = first if same else [k for k, s in enumerate(side) if s == 1]
    step = max(16, min(1024, CELLS // max(1, max(map(len, tokens)) * 64)))
    for i in range(0, len(first), step):
        for j in range(i if same else 0, len(second), step):
            a, b = first[i : i + step], second[j : j + step]
            holds = similar_in_group([tokens[k] for k in a], [tokens[k] for k in b], [lesser[k] for k in a], [lesser[k] for k in b])
            if same and i == j:
                holds &= ~np.eye(len(a), dtype=bool)
            before = ranked[b][None, :] < ranked[a][:, None]
            links[a] += holds.sum(axis=1)
            earlier[a] |= (holds & before).any(axis=1)
            if not (same and i == j):
                links[b] += holds.sum(axis=0)
                earlier[b] |= (holds & ~before).any(axis=0)
    return links, earlier


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, i, j, side, k1, k2, unnamed, doc_id, doc, line, tokens, groups), sorted by (group, i, j): links of each key in each group."""

    def done(key: tuple, rows: list[tuple]) -> list[tuple]:
        group, i, j = key
        lesser = [np.array([g for g in r[8] if g < group], np.int64) for r in rows]
        links, earlier = _group_links([r[0] for r in rows], [r[3:7] for r in rows], [np.frombuffer(r[7], "<u4") for r in rows], lesser, i == j)
        return [(*rows[k][1:3], int(links[k]), bool(earlier[k])) for k in np.flatnonzero(links)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k1", "k2", "links", "earlier"])

    group, rows, out = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != group:
                if rows:
                    out += done(group, rows)
                group, rows = row[:3], []
            rows.append(row[3:])
        yield batch_of(out)
        out = []
    if rows:
        yield batch_of(done(group, rows))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with words: doc_id, doc (hash of the text), line (from 0), class_id (of lines with equal token sets),
    n_links (similar lines of other classes, each class once) and removed."""
    spark = docs.sparkSession
    text = docs[text_col]
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), document_hash(text).alias("doc"), text.alias("text")).where("text is not null")
    rank = spark.sparkContext.broadcast(rarity(texts.select("text")))  # 2**COUNT_BITS bytes and 2**WORD_BITS bits
    buckets = blocks.n_buckets(spark)
    entries = texts.select("text").mapInArrow(_prefix_blocks(lambda: rank.value, buckets), "bucket int, token binary, key binary, size binary, place binary, parity binary, before binary")
    active = entries.repartition("bucket").mapInArrow(_active, "group bigint, k1 bigint, size bigint")
    active = blocks.settle(active.groupBy("group", "k1").agg(F.max("size").alias("size")), "line-entries")
    # Groups that share a line go by the least group of their lines, so that near copies are in one group mostly.
    least = active.join(active.groupBy("k1").agg(F.min("group").alias("least")), "k1").groupBy("group").agg(F.min("least").alias("least"))
    active = active.join(least, "group").groupBy(F.col("least").alias("group"), "k1").agg(F.max("size").alias("size"))
    active = blocks.settle(active, "line-active")
    wanted = spark.sparkContext.broadcast(blocks.bitmap(active, "k1"))  # 2**BITMAP_BITS bytes
    schema = "doc_id bigint, doc bigint, line int, k1 bigint, k2 bigint, tokens binary"
    lines = blocks.settle(texts.mapInArrow(_lines(lambda: rank.value, lambda: wanted.value), schema), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc", "line")
    # Only lines that equal another one, or may be similar to one, have anything to decide.
    classes = lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.col("tokens").isNotNull()).alias("may"))
    classes = blocks.settle(classes.where("n > 1 or may"), "line-classes")
    groups = active.groupBy("k1").agg(F.sort_array(F.collect_list("group")).alias("groups"))  # at most a prefix's length
    sets = lines.where("tokens is not null").select("k1", "k2", "tokens").dropDuplicates(["k1", "k2"]).join(groups, "k1")
    sets = blocks.settle(sets.join(classes.select("k1", "k2", "first"), ["k1", "k2"]), "line-sets")
    # Tiles: each member of a group meets all its tiles, of about TILE lines or TILE_BYTES.
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("size") * 4 / TILE_BYTES)).cast("int")
    sizes = active.groupBy("group").agg(tiles.alias("tiles")).where("tiles > 1")
    members = sets.withColumn("group", F.explode("groups")).join(sizes, "group", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = members.withColumn("tile", F.pmod(F.xxhash64("k1", "k2"), F.col("tiles")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = members.select(
        "group", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "k1", "k2",
        F.col("first.unnamed").alias("unnamed"), F.coalesce("first.doc_id", F.lit(0)).alias("doc_id"), F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "tokens", "groups",
    )
    found = grouped.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_verified, "k1 bigint, k2 bigint, links bigint, earlier boolean")
    found = blocks.settle(found.groupBy("k1", "k2").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier")), "line-links")
    decided = classes.select("k1", "k2", "first").join(found, ["k1", "k2"], "left")
    out = lines.drop("tokens").join(decided, ["k1", "k2"], "left")
    removed = F.coalesce("earlier", F.lit(False)) | F.coalesce(place != F.col("first"), F.lit(False))
    return out.select("doc_id", "doc", "line", F.col("k1").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), removed.alias("removed"))


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the removed lines cut from the text column."""
    return cut_lines(docs, joined(docs, id_col, text_col).where("removed").select("doc_id", "doc", "line"), id_col, text_col)
