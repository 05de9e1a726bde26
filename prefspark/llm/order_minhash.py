"""Operator 3: document fingerprints by Order MinHash, in DataFrame functions only.

A text's words give k-mers; equal k-mers are told apart by an occurrence number. Each labelled
k-mer has a hash, and each of ``slots`` orders is a rotation of the hash ring: it begins at the
slot's own point. A slot takes the ``width`` minimal k-mers in its order, puts them back in text
order and hashes the tuple. Likeness is the share of slots that agree, so it falls with every
edit and with every change of order.

The hash and the position travel in one long (hash above, position in the low POSITION_BITS), so
sorting is a sort of primitive longs; positions beyond 2**POSITION_BITS count as tied, then the
hash decides the order. All loops are array functions over one row: nothing is exploded.

Edge cases: a text of fewer than k words is one k-mer, an empty or null one has none and a
fingerprint of its own (likeness 1 among such). Rows that repeat id and text are one document
for the order of documents, and each of the rows gets its result; equal ids with different texts
are ordered by the text's hash; a null id comes last. An empty table gives an empty result. Only
the id and text columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

K = 5
SLOTS = 64
WIDTH = 2
POSITION_BITS = 23
_LOW = (1 << POSITION_BITS) - 1
_SPACE = " \t\n\r\f\x0b"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (an expression inside a lambda would run for each element)."""
    return F.transform(F.array(value), body)[0]


def _halving(n: Column) -> Column:
    """Powers of two from the least one not under ``n`` down to 1."""
    bits = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    return F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))


def _pack(h: Column, i: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.least(i, F.lit(_LOW)).cast("long"))


def _hash_of(p: Column) -> Column:
    return F.shiftright(p, POSITION_BITS)


def _packed_kmers(text: Column, k: int) -> Column:
    """Sorted longs: hash of the k-mer above, its position below."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\r\\f\\x0b]+"))

    def kmers(h: Column) -> Column:
        n = F.size(h)
        places = F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))))
        # Beyond the end of a text of fewer than k words the elements are null, which the hash skips.
        return F.transform(places, lambda i: _pack(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i))

    return F.sort_array(_let(F.transform(words, lambda w: F.xxhash64(w)), kmers))


def _labelled(sorted_kmers: Column) -> Column:
    """The sorted longs with a hash that also depends on the occurrence number, if it isn't the first.

    Equal k-mers are neighbours in text order, so the number is the distance to the first of
    them, found by halving steps.
    """

    def label(s: Column) -> Column:
        def number(p: Column, i: Column) -> Column:
            def further(done: Column, step: Column) -> Column:
                back = i - done - step
                return F.when((back >= 0) & (_hash_of(F.get(s, F.greatest(back, F.lit(0)))) == _hash_of(p)), done + step).otherwise(done)

            return F.aggregate(_halving(i), F.lit(0), further)

        def one(p: Column, i: Column) -> Column:
            repeated = (i > 0) & (_hash_of(F.get(s, F.greatest(i - 1, F.lit(0)))) == _hash_of(p))
            return F.when(repeated, _pack(F.xxhash64(_hash_of(p), number(p, i)), p.bitwiseAND(F.lit(_LOW)).cast("int"))).otherwise(p)

        return F.transform(s, one)

    return F.sort_array(_let(sorted_kmers, label))


def signature(text: Column, k: int = K, slots: int = SLOTS, width: int = WIDTH) -> Column:
    """array<int> of ``slots`` tuple hashes; empty for a text without words."""
    points = F.array(*[F.lit(((2 * j + 1) << 63) // slots - (1 << 63)) for j in range(slots)])

    def slot(e: Column, steps: Column, point: Column) -> Column:
        n = F.size(e)
        # Number of entries below the point: where the slot's order begins.
        start = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(e, at + step - 1) < point), at + step).otherwise(at))
        chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(width), n) - 1), lambda j: F.get(e, (start + j) % n))
        by_place = F.sort_array(F.transform(chosen, lambda p: F.shiftleft(p.bitwiseAND(F.lit(_LOW)), 40).bitwiseOR(F.shiftrightunsigned(p, 24))))
        return F.xxhash64(F.transform(by_place, lambda p: p.bitwiseAND(F.lit((1 << 40) - 1)))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def slots_of(e: Column) -> Column:
        return _let(_halving(F.size(e)), lambda steps: F.transform(points, lambda p: slot(e, steps, p)))

    entries = _labelled(_packed_kmers(F.coalesce(text, F.lit("")), k))
    return _let(entries, lambda e: F.when(F.size(e) < 1, F.array().cast("array<int>")).otherwise(slots_of(e)))


def fingerprint(sig: Column) -> Column:
    """The signature as text: eight hexadecimal digits a slot; ``-`` for a text without words."""
    return F.when(F.size(sig) < 1, F.lit("-")).otherwise(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree; 1 if neither text has words, 0 if only one has."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    return F.when((F.size(a) < 1) & (F.size(b) < 1), F.lit(1.0)).when((F.size(a) < 1) | (F.size(b) < 1), F.lit(0.0)).otherwise(agree / F.greatest(F.size(a), F.lit(1)))


def _links(docs: DataFrame) -> DataFrame:
    """For each distinct (id, text hash): that of the next document by descending id, in a ring, and its own length.

    Keys are range-partitioned and numbered within their partition; only the first key of each
    partition is looked at across partitions.
    """
    keys = docs.select("id", "h", F.length("text").alias("n")).distinct()
    keys = keys.repartitionByRange(F.desc_nulls_last("id"), "h").withColumn("part", F.spark_partition_id())
    keys = materialize(keys, "omh-keys")  # the parts must not change when they are read twice
    within = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"), "h")
    chained = keys.select("id", "h", "n", "part", F.row_number().over(within).alias("at"), F.lead(F.struct("id", "h")).over(within).alias("next"))
    firsts = chained.where("at = 1").select("part", F.struct("id", "h").alias("first"))  # a row for each partition
    ring = Window.orderBy("part")
    whole = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("following"))
    nexts = F.coalesce("next", "following")
    return chained.join(F.broadcast(firsts), "part").select("id", "h", F.floor(F.col("n") / 3).cast("int").alias("moved"), nexts["id"].alias("next_id"), nexts["h"].alias("next_h"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n / 3) code points replaced by the first as many of the
    next document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    links = _links(rows)
    base = rows.withColumn("sig", signature(F.col("text"), k, slots, width))
    b, l = base.alias("b"), links.alias("l")
    # Each document sends the beginning that the one before it takes over, and its signature.
    sent = b.join(l, F.col("b.id").eqNullSafe(F.col("l.next_id")) & (F.col("b.h") == F.col("l.next_h"))).select(
        F.col("l.id").alias("to_id"), F.col("l.h").alias("to_h"), "moved", F.substring(F.col("b.text"), F.lit(1), F.col("moved")).alias("taken"), F.col("b.sig").alias("next_sig")
    )
    sent = sent.dropDuplicates(["to_id", "to_h"])  # repeated rows send the same
    got = b.join(sent, F.col("b.id").eqNullSafe(F.col("to_id")) & (F.col("b.h") == F.col("to_h")))
    n = F.length("b.text")
    edited = F.concat(F.substring(F.col("b.text"), F.lit(1), n - F.col("moved")), F.col("taken"))
    out = got.select(F.col("b.id").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("b.sig").alias("sig"), "next_sig")
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", signature(F.col("edited"), k, slots, width).alias("edited_sig"), "next_sig")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
