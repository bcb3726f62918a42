"""Problem 9: items of varying length in containers of fixed capacity.

Variable-capacity best fit: items of a group are taken by falling size; each goes into the open bin it fills best. If none holds
it, a bin is opened, and the permitted lengths are weighed against each other: a length costs itself and ``OVERHEAD``, and can
be filled by the item and by those still to come that fit beside it; the one of the least cost a filled token is opened, the
largest among equals. At the end every bin shrinks to the least permitted length that holds its contents. An item above the
largest capacity is cut into full containers and a rest, which is packed like any other item.

While small items are left the largest length is the cheapest; where only items are left that can't share it (all of 700 or of
1,100 tokens, say) shorter ones are.

Parts of items are spread over groups of about ``GROUP`` parts by a hash, so neither equal keys or sizes nor one item of any
length make a large group; each group leaves about one bin partly empty.

Defined results: items of null or no size take no container; every other item comes out once, or once a part if cut;
rows with equal ids are items of their own; ties between bins go to the one opened first; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import written

GROUP = 20_000
#: Permitted lengths; the largest is the capacity above which an item is cut.
LENGTHS = (256, 512, 768, 1024, 1280, 1536, 1792, 2048)
#: Cost of a bin besides its length.
OVERHEAD = 32


def pack(sizes: np.ndarray, lengths=LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and length of each bin. All sizes are from 1 to the largest length."""
    lengths = sorted(lengths)
    top = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(top + 1)]  # open bins by free room, first opened last
    some = 0  # bit r is set if a bin has room r
    filled: list[int] = []
    into = np.zeros(len(sizes), np.int64)
    falling = sizes[order].astype(np.int64)
    fitting = np.searchsorted(-falling, -np.arange(top + 1)).tolist()  # the first item of at most so many tokens
    falling = falling.tolist()

    def fill(gap: int, at: int) -> int:
        """About how much of a gap the items from ``at`` on can fill: the largest that fit, as often as they fit. Each step halves
        the gap at least."""
        got = 0
        at = max(at, fitting[gap])
        while gap and at < len(falling):
            n = min(gap // falling[at], len(falling) - at)
            got, gap = got + n * falling[at], gap - n * falling[at]
            at = max(at + n, fitting[gap])
        return got

    for at, i in enumerate(order.tolist()):
        s = int(sizes[i])
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, least = 0, np.inf
            for c in lengths:
                if c >= s:
                    cost = (c + overhead) / (s + fill(c - s, at + 1))
                    if cost <= least:
                        r, least = c, cost
            b = len(filled)
            filled.append(0)
        filled[b] += s
        into[i] = b
        if r > s:
            room[r - s].append(b)
            some |= 1 << (r - s)
    return into, np.array(lengths)[np.searchsorted(lengths, np.array(filled, np.int64))] if filled else np.zeros(0, np.int64)


def pack_items(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """(bin_id, capacity, doc_id, part_no, start, tokens) of items (doc_id, tokens). ``start`` counts tokens from the
    beginning of the item."""
    top = max(lengths)
    rows = written(items.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), F.monotonically_increasing_id().alias("_row")), "sizes")
    n = rows.agg(F.sum(F.floor((F.col("tokens") - 1) / top) + 1)).first()[0] or 0
    groups = max(1, -(-n // group))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / top))).alias("part_no")
    parts = rows.select("doc_id", "tokens", "_row", part).select(
        "doc_id", "part_no", (F.col("part_no") * top).alias("start"), F.least(F.col("tokens") - F.col("part_no") * top, F.lit(top)).alias("tokens"),
        F.pmod(F.xxhash64("_row", "part_no"), F.lit(groups)).alias("_g"), "_row")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "part_no"], kind="stable")
        into, size = pack(pdf["tokens"].to_numpy(), lengths)
        g = int(pdf["_g"].iloc[0])
        return pd.DataFrame({"bin_id": (g << 32) + into, "capacity": size[into], "doc_id": pdf["doc_id"], "part_no": pdf["part_no"], "start": pdf["start"], "tokens": pdf["tokens"]})

    key = items.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("_g").applyInPandas(one, f"bin_id long, capacity long, doc_id {key}, part_no long, start long, tokens long")
