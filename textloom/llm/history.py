"""Problem 5: new batches against all that was accepted before.

The metric is the Jaccard distance between sets of runs of three words. An item's row in the history table has its distances
to fixed pivots: the size of its set (its distance to the empty set) and the counts in ``PIVOTS`` hash classes of runs (up to a
constant its symmetric difference to each class). By the triangle inequality the sum of the count differences is no more
than the symmetric difference of two sets, which a similarity of s bounds by (1 - s) / (1 + s) of both sizes: pairs beyond
are pruned without their texts.

Pivot distances alone can't find the candidates here: distances between texts of one language crowd together just below 1,
so no range of 0.3 about any pivot excludes much (figures in the README). So the table also has, for each of ``BANDS``
groups of ``WIDTH`` minimum hashes, one key, and items that share a key are candidates: a pair of similarity s is missed with
probability (1 - s ** WIDTH) ** BANDS, 1e-6 at 0.7. Along with a key go the lowest bits of ``SKETCH`` minimum hashes, of which a
pair of similarity s has (1 + s) / 2 in common: a candidate with fewer than ``LEAST_BITS`` is dropped in the join, which loses a
pair of similarity 0.7 with a probability under 2e-6. Every candidate left is verified on the whole texts.

Only keys that occur twice leave the scans of the tables (bit maps decide, sized by the batch and joined as a tree), and texts
are read for the pairs that are left only. ``History`` keeps the accepted items' ids, pages and sets as tables: a batch is judged
against these, its own keys and fingerprints being sent to the scans of the history, and what is new is appended. No text of the
history is cut or hashed again, and no row of it is shuffled that shares nothing with the batch.

Items with equal sets of runs are one class; like classes are linked. An item meets others by its class, by the classes linked
with it, by its doc_id and by its page. In each of these groups each item repeats each other, so a group needs one holder: no
members are paired with each other, nor members with links.

Order: batch_no, then item_id; items of the history come before all. An item is new if nothing that it's like is in the
history or new before it; this is settled in rounds, each of which settles every item that is first in all its groups and those that
repeat it. Rounds end when no item is open: there are as many as the longest chain of items each like the next only.

Defined results: null or empty doc_ids and urls match nothing, as do null texts and those of under three words; several
rows of one item_id are one item with all of their texts; a null batch_no comes after all batches; rows of null item_id take no part; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flat import LETTER, NUMBER, Flat, flatten
from ..plans.runtime import at_most, lookup, written

SIMILARITY = 0.7
RUN = 3
PIVOTS = 32
BANDS, WIDTH = 75, 5
SKETCH, LEAST_BITS = 128, 89
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
#: Least and most bits of a slot in the maps of keys.
MAP_BITS = (20, 27)
#: At most so many ids or hashes are sent to all tasks.
MOST_KEYS = 500_000
#: Rows of a group beyond which it's too large for one task.
HOT_GROUP = 200_000


def page_of(url: Column) -> Column:
    """What page a url names: without scheme, leading www., the scheme's default port, closing slash, fragment and tracking
    parameters, and with the host in lower case. Null for null and empty urls; other than http urls, and those of a port that can't
    be, name themselves."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^(\w+):", 1))
    place = F.regexp_extract(u, r"^\w+://([^/?#]*)", 1)
    user, host = F.regexp_extract(place, r"^(.*@)", 1), F.regexp_replace(place, r"^.*@", "")
    port = F.regexp_extract(host, r":([^:\]]*)$", 1)
    number = F.when(port.rlike(r"^[0-9]{1,5}$"), port.cast("int"))
    bad = (port != "") & ~F.coalesce(number < 65536, F.lit(False)) | (F.contains(place, F.lit("[")) != F.contains(place, F.lit("]")))
    default = (port == "") | (number == F.when(scheme == "http", 80).otherwise(443))
    name = F.regexp_replace(F.lower(F.regexp_replace(host, r":[^:\]]*$", "")), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^\w+://[^/?#]*([^?#]*)", 1), r"/$", "")
    given = F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(given, lambda p: (p != "") & ~p.rlike(r"(?s)^(utm_[^=]*|fbclid|gclid)(=.*)?$")), "&")
    out = F.concat(user, name, F.when(default, "").otherwise(F.concat(F.lit(":"), number.cast("string"))), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(u == "", None).when(~u.rlike(r"(?i)^https?://") | bad, u).otherwise(out)


def _runs(f: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of three words of each row, sorted by row."""
    ws, we = f.runs((f.cls == LETTER) | (f.cls == NUMBER))
    h, row = f.hashes(ws, we), f.rows_of(ws)
    n = len(h) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for k in range(1, RUN):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : n + k]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    ok = row[:n] == row[RUN - 1 :]
    d = pd.DataFrame({"r": row[:n][ok], "h": x[ok]}).drop_duplicates()
    return d["r"].to_numpy(), d["h"].to_numpy()


_rng = np.random.default_rng(20240605)
_A = _rng.integers(0, 1 << 32, BANDS * WIDTH, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * WIDTH, dtype=np.uint32)


def _signatures(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, pivot counts, the two halves of the set's fingerprint, band keys and the two halves of the sketch of each row."""
    size = np.bincount(row, minlength=rows)
    pivots = np.bincount(row * PIVOTS + (h & np.uint64(PIVOTS - 1)).astype(np.int64), minlength=rows * PIVOTS).reshape(rows, PIVOTS)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    keys = np.zeros((rows, BANDS), np.uint64)
    prints, sketch = np.zeros((rows, 2), np.uint64), np.zeros((rows, 2), np.uint64)
    has = np.flatnonzero(size)
    if not len(has):
        return size, pivots, prints, keys, sketch
    at = start[has]
    with np.errstate(over="ignore"):
        prints[has, 0] = np.add.reduceat(h * np.uint64(0x9E3779B97F4A7C15), at)
        prints[has, 1] = np.add.reduceat((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93), at)
        low = (h >> np.uint64(32)).astype(np.uint32)
        v = np.empty_like(low)
        for b in range(BANDS):
            key = np.full(len(has), np.uint64(b + 1) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
            for k in range(b * WIDTH, (b + 1) * WIDTH):
                np.multiply(low, _A[k], out=v)
                np.add(v, _B[k], out=v)
                v ^= v >> np.uint32(15)
                np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
                m = np.minimum.reduceat(v, at)
                if k < SKETCH:
                    sketch[has, k // 64] |= (m & np.uint32(1)).astype(np.uint64) << np.uint64(k % 64)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + m
            keys[has, b] = key ^ (key >> np.uint64(32))
    return size, pivots, prints, keys, sketch


def history_table(items: DataFrame) -> DataFrame:
    """(item_id, a, b, size, pivots, x, y, keys): a row for each item with a text of three words or more; a, b fingerprint the
    set, x, y are its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, to, f in flatten(batch.column("text"), nfc=True, lower=True, chunk=PIECE):
                row, h = _runs(f)
                size, pivots, prints, keys, sketch = _signatures(row, h, to - lo)
                has = np.flatnonzero(size)
                off = pa.array((np.arange(len(has) + 1) * BANDS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(lo, to - lo).take(pa.array(has)), pa.array(prints[has, 0].view(np.int64)), pa.array(prints[has, 1].view(np.int64)), pa.array(size[has], pa.int64()),
                    pa.array([p.tobytes() for p in pivots[has].astype(np.int32)], pa.binary()), pa.array(sketch[has, 0].view(np.int64)), pa.array(sketch[has, 1].view(np.int64)), pa.ListArray.from_arrays(off, pa.array(keys[has].reshape(-1).view(np.int64)))],
                    ["item_id", "a", "b", "size", "pivots", "x", "y", "keys"])

    key = items.schema["item_id"].dataType.simpleString()
    return items.where("item_id is not null and text is not null").select("item_id", "text").mapInArrow(run, f"item_id {key}, a long, b long, size long, pivots binary, x long, y long, keys array<long>")


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _bit(packed: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _map_bits(items: int) -> int:
    """Bits of a slot for the keys of so many items: eight slots a key, within bounds that a worker can hold. In a fuller map more
    keys leave the scans; the result is the same."""
    return int(np.clip(np.ceil(np.log2(max(1, items) * BANDS * 8)), *MAP_BITS))


def _slot_maps(rows: DataFrame, column: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of 2 ** bits slots the keys fall in at least once, and at least twice. Tasks send their maps in pieces; pieces are
    joined as a tree, some tasks' first; the driver gets two maps."""
    width = 1 << min(bits, 19)
    pieces, lots = (1 << bits) // width, 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 8, np.uint8)

        def put(into: np.ndarray, slot: np.ndarray) -> None:  # sorted slots, each once
            byte = slot >> 3
            at = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])[: len(byte)])
            if len(at):
                into[byte[at]] |= np.bitwise_or.reduceat((128 >> (slot & 7)).astype(np.uint8), at)

        for b in batches:
            c = b.column(0)
            keys = np.asarray(c.flatten() if pa.types.is_list(c.type) else c)
            for i in range(0, len(keys), 1 << 18):
                slot, times = np.unique(_slots(keys[i : i + (1 << 18)], bits), return_counts=True)
                put(two, slot[(times > 1) | _bit(one, slot)])
                put(one, slot)
        one, two = one.reshape(pieces, -1), two.reshape(pieces, -1)
        lot = TaskContext.get().partitionId() % lots
        for i in np.flatnonzero(one.any(1)):
            yield pa.RecordBatch.from_pydict({"piece": [i], "lot": [lot], "one": [one[i].tobytes()], "two": [two[i].tobytes()]}, schema)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)
        for x, y in zip(pdf["one"], pdf["two"]):
            x = np.frombuffer(x, np.uint8)
            two |= np.frombuffer(y, np.uint8) | (one & x)
            one |= x
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "lot": pdf["lot"].iloc[:1], "one": [one.tobytes()], "two": [two.tobytes()]})

    schema = pa.schema([("piece", pa.int64()), ("lot", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])
    kind = "piece long, lot long, one binary, two binary"
    parts = rows.select(column).mapInArrow(run, kind).groupBy("piece", "lot").applyInPandas(join, kind)
    got = parts.groupBy("piece").applyInPandas(join, kind).toPandas()
    out = np.zeros((2, pieces, width // 8), np.uint8)
    for piece, x, y in zip(got["piece"], got["one"], got["two"]):
        out[0, piece], out[1, piece] = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return out[0].reshape(-1), out[1].reshape(-1)


def _exploded(table: DataFrame, packed, bits: int, kind: str) -> DataFrame:
    """(class, key, x, y) of the keys whose slot is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.asarray(b.column("keys").flatten())
            hit = np.flatnonzero(_bit(packed.value, _slots(keys, bits)))
            at = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(at), pa.array(keys[hit]), b.column("x").take(at), b.column("y").take(at)], ["class", "key", "x", "y"])

    return table.select("item_id", "x", "y", "keys").mapInArrow(run, f"class {kind}, key long, x long, y long")


def _semi(left: DataFrame, some: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` that are in ``some``, or with ``left_anti`` that aren't; without a shuffle of ``left`` if ``some`` is small."""
    some = some.select(on)
    return left.join(F.broadcast(some) if at_most(some, MOST_KEYS) else some, on, how)


def _near(similarity: float):
    """Filter of candidate pairs by the pivot table."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x = np.frombuffer(b"".join(p["pivots_a"]), np.int32).reshape(-1, PIVOTS)
                y = np.frombuffer(b"".join(p["pivots_b"]), np.int32).reshape(-1, PIVOTS)
                yield p[np.abs(x - y).sum(1) <= share * (p["size_a"] + p["size_b"]).to_numpy() + 1e-9][["class_a", "class_b"]]

    return run


def _verify(similarity: float):
    """Filter of pairs of texts by the similarity of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for side in ("text_a", "text_b"):
                got: list[np.ndarray] = []
                for lo, to, f in flatten(b.column(side), nfc=True, lower=True, chunk=PIECE):
                    row, h = _runs(f)
                    got += np.split(h, np.cumsum(np.bincount(row, minlength=to - lo))[:-1])
                sets.append(got)
            keep = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["class_a", "class_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def copies_of(history: DataFrame, batch: DataFrame) -> DataFrame:
    """(item_id, class): items of sets that several have of which the batch has one, with the first of them: of the history before
    the batch, then by item_id."""
    prints = written(batch.select("a", "b").distinct(), "prints")
    old = _semi(history.select("item_id", "a", "b"), prints.select("a").distinct(), "a")
    both = written(old.select("item_id", "a", "b", F.lit(False).alias("new")).unionByName(batch.select("item_id", "a", "b", F.lit(True).alias("new"))), "same-print")
    first = both.groupBy("a", "b").agg(F.min(F.struct("new", "item_id")).alias("f"), F.count(F.lit(1)).alias("rows"), F.max("new").alias("any")).where("rows > 1 and any")
    first = written(first.select("a", "b", F.col("f.item_id").alias("class"), "rows"), "several")
    return lookup(both, first, ["a", "b"], "rows", "inner").select("item_id", "class")


def like_classes(history: DataFrame, batch: DataFrame, texts: DataFrame, copies: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(class_a, class_b): like sets of the batch and of history or batch, where class_b is in the batch. ``history`` and
    ``batch`` are history tables, ``texts`` has (item_id, text) of all their items, ``copies`` is what ``copies_of`` gives. A class is
    named by its first item."""
    kind = batch.schema["item_id"].dataType.simpleString()
    sc = batch.sparkSession.sparkContext
    again = written(copies.where("item_id <> class").select("item_id").distinct(), "again")
    mine, old = (_semi(t, again, "item_id", "left_anti") for t in (batch, history))
    bits = _map_bits(batch.count())
    once, twice = _slot_maps(mine, "keys", bits)
    old = written(_exploded(old, sc.broadcast(once), bits, kind), "old-keys")  # maps have at most 2 ** 24 bytes
    mine = written(_exploded(mine, sc.broadcast(_slot_maps(old, "key", bits)[0] | twice), bits, kind), "new-keys")
    side = lambda df, x: df.select(F.col("class").alias(f"class_{x}"), "key", F.col("x").alias(f"x_{x}"), F.col("y").alias(f"y_{x}"))
    pairs = side(old.unionByName(mine), "a").join(side(mine, "b"), "key").where("class_a <> class_b")
    differ = F.bit_count(F.col("x_a").bitwiseXOR(F.col("x_b"))) + F.bit_count(F.col("y_a").bitwiseXOR(F.col("y_b")))
    pairs = written(pairs.where(differ <= SKETCH - LEAST_BITS).select("class_a", "class_b").distinct(), "candidates")
    ends = lambda p: p.select(F.col("class_a").alias("item_id")).unionByName(p.select(F.col("class_b").alias("item_id"))).distinct()
    table = history.select("item_id", "size", "pivots").unionByName(batch.select("item_id", "size", "pivots"))
    table = written(_semi(table, written(ends(pairs), "ends"), "item_id"), "pivots")
    side = lambda x: table.select(F.col("item_id").alias(f"class_{x}"), F.col("size").alias(f"size_{x}"), F.col("pivots").alias(f"pivots_{x}"))
    pairs = pairs.join(side("a"), "class_a").join(side("b"), "class_b").where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9)
    pairs = written(pairs.mapInPandas(_near(similarity), f"class_a {kind}, class_b {kind}").distinct(), "pairs")
    t = written(_semi(texts.select("item_id", "text"), written(ends(pairs), "ends"), "item_id"), "needed")
    text = lambda x: t.select(F.col("item_id").alias(f"class_{x}"), F.col("text").alias(f"text_{x}"))
    return pairs.join(text("a"), "class_a").join(text("b"), "class_b").select("class_a", "class_b", "text_a", "text_b").mapInArrow(_verify(similarity), f"class_a {kind}, class_b {kind}")


def names_of(items: DataFrame) -> DataFrame:
    """(item_id, g): by what an item is known besides its text: its doc_id and its page."""
    names = F.array_compact(F.array(F.when(F.col("doc_id") != "", F.concat(F.lit("d"), "doc_id")), F.concat(F.lit("u"), "page")))
    return items.select("item_id", F.explode(names).alias("g"))


def _plain(items: DataFrame) -> DataFrame:
    """(item_id, doc_id, page, text) as the history keeps them; the page is made once, where this is written."""
    return items.where("item_id is not null").select("item_id", F.col("doc_id").cast("string").alias("doc_id"), page_of(F.col("url")).alias("page"), "text")


def judge(items: DataFrame, texts: DataFrame, sets: DataFrame, incoming: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(item_a, item_b): item_b of incoming repeats item_a, which is in the history or new and earlier. ``items`` (item_id, doc_id,
    page), ``texts`` (item_id, text) and ``sets`` are the history's tables."""
    place = F.struct(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch"), "item_id")
    mine = written(_plain(incoming).drop("text"), "batch-items")
    new = written(history_table(incoming), "batch")
    order = written(incoming.where("item_id is not null").select("item_id", place.alias("place")).groupBy("item_id").agg(F.min("place").alias("place")), "order")
    copies = written(copies_of(sets, new), "copies")
    edges = written(like_classes(sets, new, texts.select("item_id", "text").unionByName(incoming.select("item_id", "text")), copies, similarity), "edges")
    links = edges.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionByName(edges.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
    links = written(links.distinct(), "links")
    member = copies.unionByName(links.select(F.col("class").alias("item_id"), "class")).distinct()
    member = written(member.join(order, "item_id", "left"), "members")  # place is null in the history
    # Groups: an item's names and its class. The history's names are looked up by the hashes of the batch's.
    mine = written(names_of(mine).distinct().join(order, "item_id"), "names")
    hashed = names_of(items).withColumn("h", F.xxhash64("g"))
    known = _semi(hashed, written(mine.select(F.xxhash64("g").alias("h")).distinct(), "hashes"), "h")
    known = known.select("g", "item_id").join(mine.select("g").distinct(), "g", "left_semi")
    by_class = member.select("item_id", "place", F.concat(F.lit("t"), F.col("class").cast("string")).alias("g"))
    place_type = order.schema["place"].dataType.simpleString()
    held = written(known.unionByName(by_class.where("place is null").select("g", "item_id")).select("g", F.col("item_id").alias("item_a"), F.lit(None).cast(place_type).alias("place_a")), "held")
    name = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    links = written(links.select(name("class").alias("g"), name("other").alias("other")), "linked")
    every = mine.select("item_id", "place", "g").unionByName(by_class.where("place is not null"))
    sizes = every.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    alone = sizes.where("rows = 1").select("g").join(held.select("g").distinct(), "g", "left_anti").join(links.select("g").distinct(), "g", "left_anti")
    groups = written(every.join(alone, "g", "left_anti"), "groups")
    sizes = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    hot = (sizes.agg(F.max("rows")).first()[0] or 0) > HOT_GROUP

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """Groups' items with what stands for their group once; a group too large for a task is spread over all."""
        return lookup(left, right.join(sizes, "g"), ["g"], "rows", "inner").drop("rows") if hot else left.join(right, "g")

    near = lambda x: x.select("g").unionByName(links.join(x.select(F.col("g").alias("other")), "other").select("g")).distinct()
    done = meet(groups, near(held)).select("item_id").distinct()
    open_ = groups.select("item_id", "place").distinct().join(done, "item_id", "left_anti")
    fresh_all = order.limit(0)
    while True:
        open_ = written(open_, "open")
        if open_.isEmpty():
            break
        now = written(groups.join(open_.select("item_id"), "item_id", "left_semi"), "now")
        first = now.groupBy("g").agg(F.min("place").alias("first"))
        around = first.unionByName(links.join(first.withColumnRenamed("g", "other"), "other").select("g", "first")).groupBy("g").agg(F.min("first").alias("first"))
        beaten = meet(now, around).where("first < place").select("item_id").distinct()
        fresh = written(open_.join(beaten, "item_id", "left_anti"), "fresh")
        fresh_all = fresh_all.unionByName(fresh)
        settled = meet(now, near(now.join(fresh.select("item_id"), "item_id", "left_semi"))).select("item_id").distinct()
        open_ = open_.join(settled.unionByName(fresh.select("item_id")), "item_id", "left_anti")
    # Each item of the batch with the holders of its groups and of the groups linked with them.
    holders = held.unionByName(groups.join(fresh_all.select("item_id"), "item_id", "left_semi").select("g", F.col("item_id").alias("item_a"), F.col("place").alias("place_a")))
    holders = holders.unionByName(links.join(holders.withColumnRenamed("g", "other"), "other").select("g", "item_a", "place_a"))
    out = groups.join(holders, "g").where((F.col("item_a") != F.col("item_id")) & (F.col("place_a").isNull() | (F.col("place_a") < F.col("place"))))
    return out.select("item_a", F.col("item_id").alias("item_b")).distinct()


class History:
    """Accepted items as tables in a folder: ``items`` (item_id, doc_id, page, text) and ``sets``, to which parts are appended. A part that
    is written again replaces itself, so a job that failed can be repeated."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, items: DataFrame, part: str) -> None:
        """Takes items (item_id, doc_id, text, url); only their texts are cut and hashed."""
        plain = _plain(items)
        plain.write.mode("overwrite").parquet(f"{self.path}/items/part={part}")
        history_table(plain).write.mode("overwrite").parquet(f"{self.path}/sets/part={part}")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items").drop("part")

    def sets(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sets").drop("part")

    def repeats(self, batch: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
        """(item_a, item_b) of a batch (item_id, doc_id, text, url[, batch_no]) against the history and its own earlier items."""
        batch = batch if "batch_no" in batch.columns else batch.withColumn("batch_no", F.lit(0))
        return judge(self.items().drop("text"), self.items(), self.sets(), batch, similarity)

    def take(self, batch: DataFrame, part: str, similarity: float = SIMILARITY) -> DataFrame:
        """The repeats of a batch; what repeats nothing is appended. The part isn't read while its own batch is judged."""
        pairs = written(self.repeats(batch, similarity), "repeats")
        self.append(batch.join(pairs.select(F.col("item_b").alias("item_id")).distinct(), "item_id", "left_anti"), part)
        return pairs


def repeats(accepted: DataFrame, incoming: DataFrame, similarity: float = SIMILARITY, table: DataFrame | None = None) -> DataFrame:
    """(item_a, item_b): item_b of incoming repeats item_a, which is accepted or new and earlier. ``table``: the history
    table of accepted, if it's there already. Items: (item_id, doc_id, text, url), and batch_no in incoming."""
    items = written(_plain(accepted).drop("text"), "items")
    return judge(items, accepted, table if table is not None else written(history_table(accepted), "history"), incoming, similarity)


def repeats_by_batch(accepted: DataFrame, incoming: DataFrame, path: str, similarity: float = SIMILARITY) -> DataFrame:
    """The same, one batch after the other through a ``History`` in the folder, as batches arrive."""
    history = History(accepted.sparkSession, path)
    history.append(accepted, "0")
    out = None
    for n, r in enumerate(incoming.select("batch_no").distinct().orderBy(F.asc_nulls_last("batch_no")).toLocalIterator(), 1):
        got = history.take(incoming.where(F.col("batch_no").eqNullSafe(F.lit(r[0]))), str(n), similarity)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else repeats(accepted, incoming, similarity)


def new_items(accepted: DataFrame, incoming: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of incoming that repeat nothing."""
    return incoming.join(repeats(accepted, incoming, similarity).select(F.col("item_b").alias("item_id")).distinct(), "item_id", "left_anti")
