"""Passages that stand in more than one place, found with suffix automata over shards of reference text.

A window is a run of ``words`` consecutive words. All windows are wanted whose word sequence also starts elsewhere.

1. Every window has an anchor: the run of GRAM words inside it with the least hash, the leftmost of equal ones. Equal windows have
   equal anchors at the same place. Only anchors that occur twice in the corpus can belong to repeated windows, so most text is out
   after counting one short hash for every dozen words or so.
2. Neighbouring windows with one anchor make a region, the text that holds just these windows. Equal regions are one with a count.
   Regions with anchors of more than HOT places are cut into single windows before, so that the many different surroundings of a
   passage that everyone quotes fall apart into texts of their own, and the passage itself into few that are equal.
3. Regions are dealt out by their anchor into reference shards of bounded size. A shard's suffix automaton counts the places of each run
   of words; the regions are streamed through it, and a window is repeated if the state of its matching statistics, cut to
   ``words`` words, has two places or more. Equal windows are in one shard, so each region meets one automaton instead of all.
   Broadcasting automata of all shards to all documents would be work in the square of the corpus. A shard of one region needs no automaton.
4. The windows found go back to the texts, where they merge into spans.

Texts that are equal are handled once, with their number of copies. Words are compared as they are in step 3; hashes only choose what
is compared.

Edge cases: a NULL or empty text has no words; texts shorter than a window lose nothing; a text that stands twice, as rows of the same
id or not, is removed whole if it has a window; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from samewise.llm import textbytes as tb
from samewise.llm.automaton import SuffixAutomaton
from samewise.sources.shared import written

WORDS = 35
GRAM = 8
HOT = 1000  # places of an anchor
SHARD_WORDS = 50_000
SPANS = "array<struct<start:int,end:int>>"
REGIONS = "array<struct<key:bigint,at:int,print:bigint,region:string>>"


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of each n neighbours, the leftmost of equal ones."""
    at, size = np.arange(len(values)), 1
    while 2 * size <= n:
        a, b = at[:-size], at[size:]
        at = np.where(values[b] < values[a], b, a)
        size *= 2
    if n > size:
        a, b = at[: len(at) - (n - size)], at[n - size :]
        at = np.where(values[b] < values[a], b, a)
    return at


def anchored(w: tb.Words, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of the anchor, first window, last window) of each region; windows are numbered by their first word in w."""
    n = len(w.hash) - words + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none.astype(np.uint64), none, none
    grams = tb.runs_of(w.hash, GRAM)
    anchor = least_of(grams, words - GRAM + 1)
    window = np.arange(n)
    text = np.searchsorted(w.first, window, "right") - 1
    window = window[window + words <= w.first[text + 1]]
    if not len(window):
        return none, none.astype(np.uint64), none, none
    text, anchor = text[window], anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return text[first], grams[anchor[first]], window[first], window[last]


def _joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def marked(text: Column, words: int) -> Column:
    """A struct of n_words, the SHA-256 of all words, and the anchors with their number of places in the text."""
    kind = pa.struct([("n_words", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.struct([("hash", pa.int64()), ("places", pa.int32())])))])

    @arrow_udf("struct<n_words:bigint,sha:string,anchors:array<struct<hash:bigint,places:int>>>")
    def column(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in tb.pieces(texts):
            w = tb.words(data, offsets, tb.SPACED)
            owner, hashes, _, _ = anchored(w, words)
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            at = np.flatnonzero(new)
            places = np.diff(np.append(at, len(owner)))
            cuts = np.searchsorted(owner[at], np.arange(len(offsets)))
            pairs = pa.StructArray.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(places, pa.int32())], ["hash", "places"])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)
            raw = data.tobytes()
            shas = [hashlib.sha256(_joined(raw[a:b])).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(w.first), pa.int64()), pa.array(shas), lists], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return column(text)


def regions(text: Column, repeated: Column, words: int, with_text: bool) -> Column:
    """The regions with repeated anchors: key (that equal windows share), at (first word), print (a hash of the region), region.

    ``repeated`` is a map from an anchor's hash to whether it is hot.
    """

    @arrow_udf(REGIONS)
    def column(texts: pa.Array, repeated: pa.Array) -> pa.Array:
        parts = []
        keys, flags = repeated.keys.to_numpy(), repeated.items.to_numpy(zero_copy_only=False).astype(bool)
        where = repeated.offsets.to_numpy()
        for a, b, data, offsets in tb.pieces(texts):
            w = tb.words(data, offsets, tb.SPACED)
            owner, hashes, first, last = anchored(w, words)
            hashes = hashes.view(np.int64)
            keep, hot = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
            cuts = np.searchsorted(owner, np.arange(b - a + 1))
            for d in range(b - a):
                known, mine = keys[where[a + d] : where[a + d + 1]], slice(cuts[d], cuts[d + 1])
                if len(known) and cuts[d] < cuts[d + 1]:
                    order = np.argsort(known)
                    slot = np.minimum(np.searchsorted(known[order], hashes[mine]), len(known) - 1)
                    keep[mine] = known[order][slot] == hashes[mine]
                    hot[mine] = keep[mine] & flags[where[a + d] : where[a + d + 1]][order][slot]
            single = _singled(hot, keep, owner, hashes, first, last)
            lists = _region_lists(w, single, words, with_text, b - a)
            parts.append(lists)
        return pa.concat_arrays(parts)

    return column(text, repeated)


def _singled(hot: np.ndarray, keep: np.ndarray, owner: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, first, last window, hot) with one row for each window of the hot regions; their key is still the anchor's."""
    owner, hashes, first, last, hot = (x[keep] for x in (owner, hashes, first, last, hot))
    times = np.where(hot, last - first + 1, 1)
    row = np.repeat(np.arange(len(times)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    begin = first[row] + nth
    return owner[row], hashes[row], begin, np.where(hot[row], begin, last[row]), hot[row]


def _region_lists(w: tb.Words, rows: tuple[np.ndarray, ...], words: int, with_text: bool, n_texts: int) -> pa.Array:
    owner, keys, first, last, hot = rows
    size = last - first + words
    windows = tb.runs_of(w.hash, words)
    prints = tb.paired(tb.paired(windows[first], windows[last]), size.astype(np.uint64))  # the two overlap, so they hold the whole region
    keys = np.where(hot, prints.view(np.int64), keys)
    text: list[str | None] = [None] * len(first)
    if with_text:
        raw = w.data.tobytes().replace(b"\xff", b"\x00")
        starts, ends = w.start.tolist(), w.end.tolist()
        text = [_between(raw, starts, ends, i, n) for i, n in zip(first.tolist(), size.tolist(), strict=True)]
    at = first - w.first[owner] if len(owner) else first
    pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(prints.view(np.int64)), pa.array(text, pa.string())], ["key", "at", "print", "region"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_texts + 1)), pa.int32()), pairs)


def _between(raw: bytes, starts: list[int], ends: list[int], i: int, n: int) -> str:
    return " ".join(raw[a:b].decode() for a, b in zip(starts[i : i + n], ends[i : i + n], strict=True))


def repeated_in(shard: list[tuple[int, int, str, int]], words: int) -> Iterator[tuple[int, int, list[dict[str, int]]]]:
    """Of (key, print, region, count) rows, those with repeated windows: key, print, the words that such windows cover."""
    if len(shard) == 1:
        key, mark, region, count = shard[0]
        if count > 1:
            yield key, mark, [{"start": 0, "end": region.count(" ") + 1}]
        return
    automaton, texts = SuffixAutomaton(), [region.split(" ") for _, _, region, _ in shard]
    ends = [automaton.add(text) for text in texts]
    places = [0] * len(automaton.next)
    for states, (_, _, _, count) in zip(ends, shard, strict=True):
        for s in states:
            places[s] += count
    link, length, after = automaton.link, automaton.length, automaton.next
    for s in automaton.longest_first():
        places[link[s]] += places[s]
    for text, (key, mark, _, _) in zip(texts, shard, strict=True):
        state, spans = 0, []
        for i, word in enumerate(text):
            state = after[state][word]
            while length[link[state]] >= words:
                state = link[state]
            if i + 1 >= words and places[state] > 1:
                start = i + 1 - words
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = i + 1
                else:
                    spans.append({"start": start, "end": i + 1})
        if spans:
            yield key, mark, spans


def _judged(words: int):
    kind = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("covered", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key. Groups of one row stand alone; the others fill shards up to SHARD_WORDS, whole groups each."""
        out: list[tuple] = []
        shard: list[tuple] = []
        group: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal held
            if len(group) == 1:
                out.extend(repeated_in(group, words))
            elif group:
                shard.extend(group)
                held += sum(r[2].count(" ") + 1 for r in group)
            group.clear()
            if held >= SHARD_WORDS:
                out.extend(repeated_in(shard, words))
                shard.clear()
                held = 0

        def flushed() -> pa.RecordBatch:
            rows = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), kind.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, schema=kind)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                group.append(row)
            if len(out) > 5000:
                yield flushed()
        close()
        out.extend(repeated_in(shard, words) if shard else ())
        yield flushed()

    return judge


def kept(text: Column, spans: Column) -> Column:
    """A struct of the spans merged, the number of words in them, and the SHA-256 of the words outside, joined by one space."""
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    @arrow_udf(f"struct<spans:{SPANS},n_removed:bigint,kept_sha256:string>")
    def column(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, found in zip(pc.fill_null(texts.cast(pa.large_string()), "").to_pylist(), spans.to_pylist(), strict=True):
            split = text.encode().split()
            gone = np.zeros(len(split), bool)
            for s in found or ():
                gone[s["start"] : s["end"]] = True
            starts, ends = tb.spans_of(gone)
            rest = b" ".join(split[i] for i in np.flatnonzero(~gone).tolist())
            rows.append({"spans": [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(rest).hexdigest()})
        return pa.array(rows, kind)

    return column(text, spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, hot: int = HOT) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_sha256 and the spans of words removed."""
    if words < GRAM:
        raise ValueError(f"words must be {GRAM} or more")
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))  # two seeds, so 128 bits
    marks = written(keyed.withColumn("m", marked(F.col("text"), words)).select("id", "k1", "k2", "m.n_words", "m.sha", "m.anchors"), "passages-marks")

    anchors = marks.select("k1", "k2", F.explode("anchors").alias("a")).select("k1", "k2", "a.hash", "a.places")
    often = anchors.groupBy("hash").agg(F.sum("places").alias("places")).where("places > 1").select("hash", (F.col("places") > hot).alias("hot"))
    repeated = anchors.select("k1", "k2", "hash").join(often, "hash").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("hash", "hot"))).alias("repeated"))
    alike = marks.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    chosen = alike.join(repeated, ["k1", "k2"])
    on = [keyed.k1 == chosen.k1, keyed.k2 == chosen.k2, keyed.id.eqNullSafe(chosen.id)]
    texts = written(keyed.join(chosen, on).select(keyed.k1, keyed.k2, "text", "copies", "repeated"), "passages-texts")

    def placed(with_text: bool) -> DataFrame:
        return texts.select("k1", "k2", "copies", F.explode(regions(F.col("text"), F.col("repeated"), words, with_text)).alias("r"))

    distinct = placed(True).groupBy("r.key", "r.print", "r.region").agg(F.sum("copies").alias("count")).select("key", "print", "region", "count")
    by_key = distinct.repartition("key").sortWithinPartitions("key")
    covered = written(by_key.mapInArrow(_judged(words), f"key bigint, print bigint, covered {SPANS}"), "passages-covered")
    back = placed(False).select("k1", "k2", "r.at", "r.key", "r.print").join(covered, ["key", "print"])
    moved = F.transform("covered", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    spans = back.select("k1", "k2", moved.alias("s")).groupBy("k1", "k2").agg(F.flatten(F.collect_set("s")).alias("spans"))
    changed = texts.select("k1", "k2", "text").join(spans, ["k1", "k2"]).select("k1", "k2", kept(F.col("text"), F.col("spans")).alias("c")).select("k1", "k2", "c.*").dropDuplicates(["k1", "k2"])
    changed = written(changed, "passages-changed")  # apart from the join below, which then splits where one text has very many copies
    return marks.select("id", "k1", "k2", "n_words", "sha").join(changed, ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM d WHERE len(w) >= {WORDS})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT rid, unnest(range(i, i + {WORDS})) AS p FROM rep),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
rest AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM (SELECT * FROM word ANTI JOIN cov USING (rid, p)) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN rest USING (rid)
"""
