"""Mixing of sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed by cell of source, language and topic. The cells' weights are raked: each sweep scales them to the targets of one
dimension after the other, and never above the tokens that a cell has, until no weight moves by more than CONVERGED of itself or SWEEPS are done. A document's probability is its cell's weight over its cell's
tokens, and it is taken if a number drawn from the hash of its key is below it, so a repeated run takes the same documents.

The targets of a level are its share of the budget: the share given for it, or its tokens to the power TEMPER, which lifts small levels.
Cells are sums that combine before the shuffle. Up to MAX_CELLS of them are raked on the driver, a few numbers each, in plain arithmetic,
and broadcast to the documents; beyond it, level sums are aggregations, every sweep is written to the shared folder, and the cells are joined by shuffle.
The two ways do the same steps. residuals() tells how far the levels are from their targets, which caps can leave out of reach.

Topics come from a column if there is one; else from the first of a list of patterns that the text holds.

Edge cases: NULL levels are a level of their own; a NULL or empty text has no tokens; a cell without tokens has the budget as its
probability; levels without a given share get none; a NULL key draws as the empty string; rows with equal keys are taken together;
an empty table gives an empty result. Result columns replace input columns of the same names.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from math import fsum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm.sharding import uniform
from samewise.sources.shared import written

DIMENSIONS = ("source", "lang", "topic")
BUDGET = 0.7  # of all tokens
TEMPER = 0.7
SWEEPS = 20
CONVERGED = 1e-12
MAX_CELLS = 50_000
NONE = "(none)"
# Topics and the patterns that show them, the first that fits counts.
TOPICS = (("legal", "[Ll]icen[sc]e"), ("contact", "@|[+][0-9]"), ("data", "[0-9]|[|]"))
OTHER_TOPIC = "prose"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for name, pattern in TOPICS:
        found = found.when(text.rlike(pattern), F.lit(name))
    return found.otherwise(OTHER_TOPIC)


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add tokens, and topic where there is none, and make NULL levels a level."""
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic_of(F.coalesce(F.col(text), F.lit(""))))
    for d in DIMENSIONS:
        docs = docs.withColumn(d, F.coalesce(F.col(d).cast("string"), F.lit(NONE)))
    return docs.withColumn("tokens", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))


def targets_of(cells: DataFrame, dimension: str, budget: float, given: Mapping[str, float] | None) -> DataFrame:
    """(level, target) in tokens."""
    sums = cells.groupBy(dimension).agg(F.sum("n").alias("n"))
    if given is None:
        raw = F.when(F.col("n") > 0, F.pow("n", F.lit(TEMPER))).otherwise(0.0)
    else:
        raw = F.when(F.lit(False), F.lit(0.0))
        for level, share in given.items():
            raw = raw.when(F.col(dimension) == level, F.lit(float(share)))
        raw = raw.otherwise(0.0)
    parts = sums.select(dimension, "n", raw.alias("raw"))
    n, shares = parts.agg(F.sum("n"), F.sum("raw")).first()
    return parts.select(dimension, (budget * F.lit(n or 0.0) * F.col("raw") / F.lit(shares) if shares else F.lit(0.0)).alias("target"))


def raked(cells: DataFrame, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with tokens n, with their weight w in tokens."""
    cells = written(cells, "mixing-cells")
    few = cells.select(*DIMENSIONS, "n").limit(MAX_CELLS + 1).collect()
    if len(few) <= MAX_CELLS:
        return _raked_here(cells.sparkSession, [tuple(r) for r in few], budget, targets or {}, sweeps)
    wanted = {d: written(targets_of(cells, d, budget, (targets or {}).get(d)), "mixing-targets") for d in DIMENSIONS}
    cells = cells.withColumn("w", F.col("n") * budget)
    for _ in range(sweeps):
        cells = cells.withColumn("w0", F.col("w"))
        for d in DIMENSIONS:
            sums = cells.groupBy(d).agg(F.sum("w").alias("s")).join(wanted[d], d)
            scale = sums.select(d, F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0).alias("scale"))
            cells = cells.join(scale, d).select(*DIMENSIONS, "n", "w0", F.least("n", F.col("w") * F.col("scale")).alias("w"))
        cells = written(cells, "mixing-cells")
        moved = cells.where(F.abs(F.col("w") - F.col("w0")) > CONVERGED * F.greatest("w", "w0")).limit(1).count()
        cells = cells.drop("w0")
        if not moved:
            break
    return cells


def _raked_here(spark: SparkSession, cells: list[tuple], budget: float, targets: Mapping[str, Mapping[str, float]], sweeps: int) -> DataFrame:
    """The same for cells (source, lang, topic, n) that the driver holds."""
    n = [c[3] for c in cells]
    total = fsum(n)
    level = [[c[i] for c in cells] for i in range(len(DIMENSIONS))]
    wanted = []
    for names, d in zip(level, DIMENSIONS, strict=True):
        sums = _level_sums(names, n)
        raw = {x: (v**TEMPER if v > 0 else 0.0) if targets.get(d) is None else float(targets[d].get(x, 0.0)) for x, v in sums.items()}
        shares = fsum(raw.values())
        wanted.append({x: budget * total * v / shares if shares else 0.0 for x, v in raw.items()})
    w = [x * budget for x in n]
    for _ in range(sweeps):
        before = w
        for names, goal in zip(level, wanted, strict=True):
            sums = _level_sums(names, w)
            scale = {x: goal[x] / s if s > 0 else 0.0 for x, s in sums.items()}
            w = [min(most, x * scale[name]) for most, x, name in zip(n, w, names, strict=True)]
        if all(abs(a - b) <= CONVERGED * max(a, b) for a, b in zip(w, before, strict=True)):
            break
    rows = json.dumps([dict(zip((*DIMENSIONS, "n", "w"), (*c, x), strict=True)) for c, x in zip(cells, w, strict=True)])
    schema = f"array<struct<{', '.join(f'{d}:string' for d in DIMENSIONS)}, n:double, w:double>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), schema)).alias("c")).select("c.*")


def _level_sums(names: list[str], values: list[float]) -> dict[str, float]:
    parts: dict[str, list[float]] = {}
    for name, value in zip(names, values, strict=True):
        parts.setdefault(name, []).append(value)
    return {name: fsum(x) for name, x in parts.items()}


def residuals(cells: DataFrame, budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(dimension, level, target, reached) in tokens, of raked cells."""
    out = None
    for d in DIMENSIONS:
        reached = cells.groupBy(d).agg(F.sum("w").alias("reached")).join(targets_of(cells, d, budget, (targets or {}).get(d)), d)
        part = reached.select(F.lit(d).alias("dimension"), F.col(d).alias("level"), "target", "reached")
        out = part if out is None else out.unionByName(part)
    return out


def mixed(docs: DataFrame, cells_of: DataFrame | None = None, key: str = "doc_id", budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None, seed: str = "mix") -> DataFrame:
    """Add probability and selected to described documents; cells_of are the same rows, if they can be had cheaper."""
    sums = (docs if cells_of is None else cells_of).groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("n"))
    cells = raked(sums, budget, targets)
    chance = cells.select(*DIMENSIONS, F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(budget).alias("probability"))
    few = chance.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    drawn = uniform(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(seed))
    return docs.drop("probability").join(F.broadcast(chance) if few else chance, list(DIMENSIONS)).withColumn("selected", drawn < F.col("probability"))


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: float = BUDGET, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The rows of docs that are taken, as they are."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")
    known = [F.col(d) for d in DIMENSIONS if d in docs.columns]
    rows = described(docs.select(own, F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), *known), "__text").drop("__text")
    return mixed(rows, key="__key", budget=budget, targets=targets).where("selected").select("__own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with tempered targets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    rows = written(described(docs).drop("text"), "mixing-rows")
    return mixed(rows).select("doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"), "selected")


def _sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    parts = [
        "t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)",
        f"d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM t)",
        f"c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n, sum(tokens)::DOUBLE * {BUDGET} AS w FROM d GROUP BY ALL)",
    ]
    for x in DIMENSIONS:
        parts.append(f"t_{x} AS (SELECT {x}, {BUDGET} * sum(n) OVER () * pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER () AS target FROM (SELECT {x}, sum(n) AS n FROM c0 GROUP BY {x}))")
    for i in range(SWEEPS * 3):
        x = DIMENSIONS[i % 3]
        parts.append(f"c{i + 1} AS (SELECT source, lang, topic, n, least(n, CASE WHEN s > 0 THEN w * (target / s) ELSE 0 END) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {x}) AS s FROM c{i}) JOIN t_{x} USING ({x}))")
    draw = "((('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496"
    chance = f"CASE WHEN n > 0 THEN w / n ELSE {BUDGET} END"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, round({chance}, 6) AS probability, {draw} < {chance} AS selected FROM d JOIN c{SWEEPS * 3} USING (source, lang, topic)"


SQL = _sql()
