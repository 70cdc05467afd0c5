"""Near-duplicates by SimHash, linked through a grid over segment bit counts.

A fingerprint is cut into 32 segments of two bits, and each segment is mapped to its number of set bits. The Manhattan distance of
two such vectors is a lower bound of the fingerprints' Hamming distance. With the counts written in unary (0, 1, 11) that distance is
the Hamming distance of the codes, so vectors and bound are plain integer operations.

The 32 coordinates are dealt into bands. At a distance of at most ``bits``, all but ``bits`` of the bands are equal, so two
fingerprints within reach share a cell of the grid of at least one choice of bands. The cells are joined, the Manhattan bound is
tested, then the exact Hamming distance. A pair counts in its first common cell only. More fingerprints get more bands, hence finer cells,
so that a cell holds about one by chance at any size; the pairs found are the same. Equal fingerprints are one point, so copies never
meet in pairs.

deduplicated() goes further for pipelines: it confirms links by the similarity of shingle sets, and finds pairs that whole fingerprints
set too far apart by fingerprints of parts. Texts of a part that its hub does not link meet again over their rarest shingles: texts that are
similar to ``least`` have one in common among the first share 1 - ``least`` of each, whatever the order of shingles, if it is one for all.

Edge cases: a NULL, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle of all of them; a shingle counts as often as it stands in the text; rows may repeat, and each gets its row in the result; a
component whose ids are all NULL has a NULL id; an empty table gives an empty result. Only the id and text columns are read;
deduplicated() passes the other columns on, whatever their names.

Joins are merges by hint: Spark goes by the size of files, and lists of parts that many texts share, or texts that are nearly equal, take
far more memory than disk, so tables that it takes for small would fill the driver. What picked() broadcasts is counted first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from samewise.llm import textbytes as tb
from samewise.operators.components import components
from samewise.sources.shared import written

WORDS, BITS, SEED = 4, 4, 42
KEYS = 32  # parts of a text that get a fingerprint
PART_FROM, LEVEL_EDGE = 6, 0.17  # least shingles of a part, on average; the edge covers lengths that differ by a fifth
SEGMENTS = 32
SEGMENT_BITS = 1.415  # by which the count of a random segment tells two apart: -log2(1/16 + 1/4 + 1/16)
SPREAD = 16
MAX_IDS = 1 << 18  # rows of 16 bytes that are broadcast
LANES = 8  # longs of an odd sketch
HELD = 1 << 20  # bytes of text whose shingles a worker holds at once
LOWERED = tb.byte_table(space_only=True, lower=True)
_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of so many words of the text, A-Z lowered, joined by one space."""
    joined = b" ".join(text.encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    k = min(words, len(starts))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(starts) - k + 1)


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each stretch of so many numbers, the bits that are set in over half of them.

    Bits of one place in each byte are counted together: up to 255 numbers add up in byte lanes without overflow.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    bits = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LOW, cuts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), np.cumsum(parts) - parts, axis=0)
        for lane in range(8):
            bits |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + j)
    out[full] = bits
    return out


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a signed long."""

    @arrow_udf("long")
    def column(texts: pa.Array) -> pa.Array:
        found, waiting, held = [], [], 0

        def counted() -> np.ndarray:
            return majority(np.concatenate([*waiting, np.zeros(0, np.uint64)]), np.array([len(x) for x in waiting], np.int64))

        for text in pc.fill_null(texts, ""):
            waiting.append(shingle_hashes(text.as_py(), words))
            held += len(waiting[-1])
            if held > 1 << 18:
                found.append(counted())
                waiting, held = [], 0
        found.append(counted())
        return pa.array(np.concatenate(found).view(np.int64))

    return column(text)


def unary_counts(print_: Column) -> Column:
    """Each two-bit segment's number of set bits, in unary."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(print_, 1)
    return print_.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(print_.bitwiseAND(high).bitwiseAND(odd), 1))


def cells(agree: int, bits: int) -> list[int]:
    """Masks of the choices of ``agree`` bands out of agree + bits."""
    bands = agree + bits
    edge = [SEGMENTS * i // bands * 2 for i in range(bands + 1)]
    masks = [sum(((1 << edge[b + 1]) - 1) ^ ((1 << edge[b]) - 1) for b in chosen) for chosen in combinations(range(bands), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bands_to_agree(points: int, bits: int) -> int:
    """How many bands must agree for the least work: a row per mask and point, and as many pairs again as share a cell by chance."""

    def work(agree: int) -> float:
        return math.comb(agree + bits, agree) * (1 + points / 2 ** (SEGMENT_BITS * SEGMENTS * agree / (agree + bits)))

    return min(range(2, 13), key=work)


def links(points: DataFrame, count: int, bits: int = BITS) -> DataFrame:
    """All pairs of the distinct fingerprints in column ``print``, of which there are ``count``, that differ in at most ``bits`` bits, as (src, dst).

    Spark takes the grid to be as small as the points, of which it has many rows each; unless told to merge, it broadcasts the grid.
    """
    masks = cells(bands_to_agree(count, bits), bits)
    code = unary_counts(F.col("print"))
    cell = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), code.bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(masks)]))
    grid = points.select("print", cell.alias("at")).select("print", "at.t", "at.cell")
    a, b = grid.alias("a"), grid.alias("b")
    apart = unary_counts(F.col("a.print")).bitwiseXOR(unary_counts(F.col("b.print")))
    first = F.when(F.lit(False), F.lit(-1))
    for t, m in enumerate(masks):
        first = first.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t))
    near = (
        (F.col("a.t") == F.col("b.t"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.print") < F.col("b.print"))
        & (F.bit_count(apart) <= bits)
        & (F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= bits)
        & (first == F.col("a.t"))
    )
    return a.join(b.hint("merge"), near).select(F.col("a.print").alias("src"), F.col("b.print").alias("dst"))


def clustered(marks: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows of (key, print) with ``component``: the smallest key among the prints reachable over links."""
    points = written(marks.groupBy("print").agg(F.min(key).alias("least")), "simhash-points")
    found = components(links(points.select("print"), points.count(), bits))
    placed = written(points.join(found.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("hub", F.coalesce("component", "print")), "simhash-placed")
    named = written(placed.groupBy("hub").agg(F.min("least").alias("least")), "simhash-named")  # apart from the join, which then splits
    by_print = written(placed.select("print", "hub").join(named.hint("merge"), "hub").select("print", F.col("least").alias("component")), "simhash-components")
    return marks.join(by_print.hint("merge"), "print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per row of docs: key, print (a signed long) and component."""
    marks = written(docs.select(F.col(key), fingerprint(F.col(text), words).alias("print")), "simhash")
    return clustered(marks, key, bits)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For stretches of texts, the distinct hashes of their shingles in order, and where each text's begin and end."""
    for _, _, data, offsets in tb.pieces(texts, HELD):
        w = tb.words(data, offsets, LOWERED)
        sizes = np.diff(w.first)
        runs = tb.runs_of(w.hash, words)
        at = np.arange(len(runs))
        owner = np.searchsorted(w.first, at, "right") - 1
        inside = at + words <= w.first[owner + 1] if len(at) else np.zeros(0, bool)
        few = np.flatnonzero((sizes > 0) & (sizes < words))
        short = [tb.runs_of(w.hash[w.first[d] : w.first[d + 1]], int(sizes[d]))[0] + np.uint64(sizes[d]) for d in few.tolist()]
        h = np.concatenate([runs[inside], np.array(short, np.uint64)])
        owner = np.concatenate([owner[inside], few])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield h, np.searchsorted(owner, np.arange(len(sizes) + 1))


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of n texts from values and whose they are."""
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(n + 1)), pa.int32()), pa.array(values[order].view(np.int64)))


def partial_keys(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the fingerprints over parts of each text's distinct shingles.

    Shingles are dealt by hash into 2 ** level parts, as often as it takes to have KEYS of them. The level grows with the text, so that a
    part has PART_FROM shingles to twice as many at any length: enough to tell texts apart that share a passage, and few enough for
    copies with some changed words to keep some parts whole. Near the edge of two levels a text has both.
    """
    sizes = np.diff(cuts)
    at = np.log2(np.maximum(sizes, 2 * PART_FROM) / PART_FROM)
    low, high = (np.maximum(1, np.floor(at + d)).astype(np.int64) for d in (-LEVEL_EDGE, LEVEL_EDGE))
    text = np.repeat(np.arange(len(sizes)), sizes)
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for level in np.unique(np.concatenate([low, high])).tolist():
        mine = ((low == level) | (high == level))[text]
        x, t = h[mine], text[mine]
        for deal in range(-(-KEYS // (1 << level))):
            number = (tb.mixed(x + np.uint64(deal)) >> np.uint64(64 - level)).astype(np.int64) + (deal << level)
            some = number < KEYS
            slot = t[some] * KEYS + number[some]
            order = np.argsort(slot, kind="stable")
            slot, part = slot[order], x[some][order]
            begin = np.flatnonzero(np.diff(slot, prepend=-1))
            prints = majority(part, np.diff(np.append(begin, len(slot))))
            owners.append(slot[begin] // KEYS)
            keys.append(tb.paired((slot[begin] % KEYS + level * KEYS).astype(np.uint64), prints))
    return np.concatenate(owners), np.concatenate(keys)


def odd_sketch(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """64 * LANES bits for each text, each set if an odd number of its shingles fall to it. Two sketches differ in at most as many bits
    as there are shingles that one text has and the other has not."""
    sizes = np.diff(cuts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = (tb.mixed(h + np.uint64(77)) >> np.uint64(32)).astype(np.int64) % (64 * LANES)
    odd = np.zeros((len(sizes), LANES), np.uint64)
    np.bitwise_xor.at(odd, (text, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return odd


def apart_at_least(a: Column, b: Column) -> Column:
    """A lower bound of the number of shingles that one of two texts has, from their odd sketches."""
    out = F.lit(0)
    for i in range(LANES):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def sketched(text: Column, words: int) -> Column:
    """A struct of the number of distinct shingles, their fingerprint, the keys of partial ones, and their odd sketch."""
    kind = pa.struct([("n", pa.int32()), ("print", pa.int64()), ("parts", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    @arrow_udf("struct<n:int,print:long,parts:array<long>,odd:array<long>>")
    def column(texts: pa.Array) -> pa.Array:
        out = []
        for h, cuts in shingle_sets(texts, words):
            sizes = np.diff(cuts)
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * LANES, pa.int32()), pa.array(odd_sketch(h, cuts).view(np.int64).ravel()))
            out.append(pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(majority(h, sizes).view(np.int64)), _lists(*partial_keys(h, cuts), len(sizes)), odd], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return column(text)


def similarity(a: Column, b: Column, words: int) -> Column:
    """The Jaccard similarity of the sets of shingles; 1 for two texts without any."""

    @arrow_udf("double")
    def column(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        held = np.cumsum([pc.fill_null(pc.binary_length(side), 0).to_numpy().astype(np.int64) for side in (left, right)], axis=1).sum(axis=0)
        i = 0
        while i < len(left):  # at least a pair, and no more than fit into HELD bytes
            end = max(i + 1, int(np.searchsorted(held, (held[i - 1] if i else 0) + HELD, "right")))
            sets = [[h[a:b] for h, cuts in shingle_sets(side[i:end], words) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] for side in (left, right)]
            for p, q in zip(*sets, strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - common
                out.append(common / union if union else 1.0)
            i = end
        return pa.array(out, pa.float64())

    return column(a, b)


def similar(pairs: DataFrame, bodies: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts in bodies (node, text, n, odd) are similar to ``least``. Sketches are compared before texts."""
    side = lambda x, *cs: bodies.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cs]).hint("merge")
    sketch = pairs.join(side("a", "n", "odd"), "a").join(side("b", "n", "odd"), "b")
    close = sketch.where(apart_at_least(F.col("odd_a"), F.col("odd_b")) <= (1 - least) / (1 + least) * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b")
    both = written(close, "simhash-close").join(side("a", "text"), "a").join(side("b", "text"), "b")
    return both.select("a", "b", similarity(F.col("text_a"), F.col("text_b"), words).alias("s")).where(F.col("s") >= least).select("a", "b")


def shingles(text: Column, words: int) -> Column:
    """The hashes of the text's distinct shingles."""

    @arrow_udf("array<long>")
    def column(texts: pa.Array) -> pa.Array:
        out = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64))) for h, cuts in shingle_sets(texts, words)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return column(text)


def rare_parts(bodies: DataFrame, words: int, least: float) -> DataFrame:
    """(part, node, n, m, odd): of the n shingles of each text, m of which others have too, those rarest ones of which it shares one with any text
    that is similar to ``least``. Such a text has ``least`` * n of them at least; so one is among the m - ceil(least * n) + 1 rarest
    of both, by one order for all texts. What is gathered by node is one text's."""
    sets = written(bodies.select("node", "n", shingles(F.col("text"), words).alias("s")), "simhash-sets")
    each = sets.select("node", "n", F.explode("s").alias("part"))
    often = written(each.groupBy("part").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "simhash-often")
    listed = each.join(often.hint("merge"), "part").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "part"))).alias("l")).withColumn("m", F.size("l"))
    needed = F.ceil(least * F.col("n") - 1e-9).cast("int")
    some = listed.where(F.col("m") >= needed).select("node", "n", "m", F.explode(F.slice("l", F.lit(1), F.col("m") - needed + 1)).alias("x"))
    return written(shared_parts(some.select("x.part", "node", "n", "m")).drop("hub").join(bodies.select("node", "odd").hint("merge"), "node"), "simhash-rare")


def shared_parts(keyed: DataFrame) -> DataFrame:
    """(part, node, hub) of the parts that two nodes or more have; the hub is the part's smallest node."""
    hubs = written(keyed.groupBy("part").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "hub"), "simhash-parts")
    return written(keyed.join(hubs.hint("merge"), "part"), "simhash-members")


def linked(members: DataFrame, bodies: DataFrame, words: int, least: float) -> DataFrame:
    """(node, component) of the links between texts that share a part. members has part, node and hub.

    A part's hub is compared with its other members, which settles most parts. The texts of parts that end in several components meet
    again over their rarest shingles, which no link between them escapes.
    """
    pairs = members.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = written(similar(written(pairs, "simhash-pairs"), bodies, words, least), "simhash-near")
    found = components(near, "a", "b")
    split = members.join(found.hint("merge"), "node", "left").groupBy("part").agg(F.min(F.coalesce("component", "node")).alias("lo"), F.max(F.coalesce("component", "node")).alias("hi")).where("lo < hi").select("part")
    open_ = written(members.join(split.hint("merge"), "part").select("node").distinct(), "simhash-open")
    if open_.limit(1).count() == 0:
        return found
    rest = written(bodies.join(open_.hint("merge"), "node", "left_semi"), "simhash-rest")
    return settled(rare_parts(rest, words, least), rest, words, least, found)


def settled(members: DataFrame, bodies: DataFrame, words: int, least: float, found: DataFrame) -> DataFrame:
    """(node, component) after the links that make the components ``found``, and all links within the parts of (part, node, n, m, odd).

    Two texts have at most the smaller m in common, and differ at least by what their odd sketches differ; pairs that are too far apart by
    either for their sizes are never made. So variants that strayed too far from an original fall out. In a part whose members are in several components, the member with the fewest
    words of its own, as originals have, is the first hub; then, in each round up to SPREAD times as many as before, those outside the
    largest component are. Each hub is compared with the members of other components that have not been hubs. A part is left when all that
    have not been are in one component. So groups of copies cost about as many comparisons as they have texts, also where most copies are
    similar to the original only, and no pair of a part stays unknown.
    """
    share = least / (1 + least)  # of the sum of two sizes, that similar texts have in common
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_, hubs_of = members.withColumn("done", F.lit(False)), 1
    while True:
        placed = open_.join(found.hint("merge"), "node", "left").select("part", "node", "n", "m", "odd", "done", F.coalesce("component", "node").alias("c"))
        counts = placed.groupBy("part", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if(~F.col("done")).alias("left"), F.min("n").alias("n"))
        largest = F.max_by("c", F.struct("k", "c")).alias("largest")
        split = counts.groupBy("part").agg(largest, F.count_if(F.col("left") > 0).alias("left"), F.min("n").alias("least_n"))
        split = written(split.where("left > 1").select("part", "largest", "least_n"), "simhash-split")
        hopeful = F.col("m") >= share * (F.col("n") + F.col("least_n")) - 1e-9
        placed = written(placed.join(split.hint("merge"), "part").where(hopeful).drop("least_n"), "simhash-open")
        bucket = F.pmod(F.xxhash64("node", F.lit(hubs_of)), F.lit(hubs_of))
        best = F.min(F.struct((-F.col("m") / F.col("n")).alias("own"), "node", "n", "m", "c", "odd")).alias("h")
        outside = ~F.col("done") & (F.lit(hubs_of == 1) | (F.col("c") != F.col("largest")))
        hubs = placed.where(outside).groupBy("part", bucket.alias("bucket")).agg(best)
        hubs = written(hubs.select("part", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.m").alias("hub_m"), F.col("h.c").alias("hub_c"), F.col("h.odd").alias("hub_odd")), "simhash-hubs")
        if hubs.limit(1).count() == 0:
            return found
        both = F.col("n") + F.col("hub_n")
        enough = (F.least("m", "hub_m") >= share * both - 1e-9) & (apart_at_least(F.col("odd"), F.col("hub_odd")) <= (1 - 2 * share) * both + 1e-9)
        met = placed.where(~F.col("done")).join(hubs.hint("merge"), "part").where((F.col("c") != F.col("hub_c")) & enough).select(F.col("hub").alias("a"), F.col("node").alias("b"))
        pairs = written(met.select(*ordered).distinct(), "simhash-pairs")
        more = written(similar(pairs, bodies, words, least), "simhash-near")
        if more.limit(1).count():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
        chosen = hubs.select("part", F.col("hub").alias("node"), F.lit(True).alias("now"))
        open_ = placed.join(chosen.hint("merge"), ["part", "node"], "left").select("part", "node", "n", "m", "odd", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        hubs_of *= SPREAD


def picked(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the column ``row``; the ids are broadcast if they are few, and else both sides are shuffled."""
    few = ids.limit(MAX_IDS + 1).count() <= MAX_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), "row", how)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, bits: int = BITS) -> DataFrame:
    """The rows of docs that stay when each group keeps one: that with the smallest key; of rows with equal keys and texts, one.

    Groups are components of links between texts whose shingles are similar to ``least``. Texts meet over equal fingerprints, whole ones
    within ``bits`` bits, from the grid, and equal partial ones; every link is confirmed on whole texts. Of two texts that meet, either
    both end in one group, or they are not similar: see linked(). Equal texts are one. Similar texts that share no
    fingerprint are missed; that is rare, but not excluded.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    column = F.col(f"`{key}`")
    node = F.unhex(F.md5(whole.cast("binary")))
    row = F.unhex(F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), column.isNull().cast("string"), F.hex(node)).cast("binary")))  # equal for equal keys and texts
    own = docs.select(column.alias("key"), whole.alias("text"), node.alias("node"), row.alias("row"))
    marks = written(own.select("key", "node", "row", sketched(F.col("text"), words).alias("s")).select("key", "node", "row", "s.*"), "simhash-marks")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    nodes = written(marks.groupBy("node").agg(first.alias("f"), *[F.first(c).alias(c) for c in ("n", "print", "parts", "odd")]), "simhash-nodes")

    named = written(nodes.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "simhash-prints")
    close = written(links(named.select("print"), named.count(), bits), "simhash-links").select(F.xxhash64(F.lit("near"), "src", "dst").alias("part"), F.explode(F.array("src", "dst")).alias("print"))
    by_part = nodes.select("node", F.explode("parts").alias("part"))
    by_print = nodes.join(named.where("n > 1").hint("merge"), "print").select("node", F.xxhash64(F.lit("equal"), "print").alias("part"))
    by_grid = nodes.join(close.hint("merge"), "print").select("node", "part")
    members = shared_parts(by_part.unionByName(by_print).unionByName(by_grid))

    ends = written(members.select("node").distinct().join(nodes.select("node", "f.row", "n", "odd").hint("merge"), "node"), "simhash-ends")
    texts = picked(own.select("row", "text"), ends.select("row"), "left_semi").dropDuplicates(["row"])
    bodies = written(texts.join(ends.hint("merge"), "row").select("node", "text", "n", "odd"), "simhash-texts")
    found = linked(members, bodies, words, least)

    grouped = nodes.select("node", "f").join(found.hint("merge"), "node", "left").withColumn("hub", F.coalesce("component", "node"))
    stays = written(grouped.groupBy("hub").agg(F.min("f").alias("f")).select("f.row"), "simhash-stays")
    times = marks.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    left_out = written(times.join(stays.withColumn("stays", F.lit(True)).hint("merge"), "row", "left").where("stays IS NULL OR n > 1"), "simhash-left-out")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), row.alias("row"))
    once = picked(marked, left_out.select("row"), "left_anti")
    repeated = picked(marked, left_out.where("stays").select("row"), "left_semi").dropDuplicates(["row"])
    return once.unionByName(repeated).select("own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
