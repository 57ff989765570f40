"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. Token weights of the cells are raked: in turn, each
dimension's factors are set so that its marginal meets the target, until all three hold to ``TOLERANCE``; where
they can't, the error left is reported as a warning. A document is then
kept with the probability that its cell's weight has changed by, at most 1, decided by a hash of its id; what
a cell is short of beyond that stays as the kept documents' weight.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the corpus's own marginals to this power, unless they are given: large classes weigh less.
TEMPER = 0.7
#: Cycles that are always taken; the SQL takes just these.
CYCLES = 8
#: Largest error of a class's share, relative to its target, at which raking ends; it also ends when ``STALL`` cycles
#: together haven't taken a hundredth off the error, as when targets conflict.
TOLERANCE, STALL = 1e-6, 10
#: Cues of the topics that texts are told apart by, first match first.
CUES = [
    ("legal", r"(?i)licen[cs]e|copyright|warrant"),
    ("contact", r"@[A-Za-z0-9]|https?://|\+[0-9]{2}"),
    ("tables", r"\|[^|\n]*\|"),
    ("figures", r"[0-9]{3}"),
]
OTHER = "prose"


def topic_of(text: Column) -> Column:
    found = F.lit(OTHER)
    for name, cue in reversed(CUES):
        found = F.when(text.rlike(cue), name).otherwise(found)
    return found


def uniform(id_: Column, seed: int) -> Column:
    """In [0, 1), from 32 bits of a digest: the same for an id in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def cells(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("unknown"))
    # a token is taken for four bytes; every document weighs at least one
    tokens = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")
    return docs.select(F.col(id_col).alias("id"), named(source_col).alias("source"), named(lang_col).alias("lang"), topic.alias("topic"), tokens.alias("tokens"))


def tempered(table: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Target shares of a dimension's values: their own shares to the power ``temper``."""
    own = table.groupBy(dimension).agg(F.sum("w").alias("own")).select(dimension, F.pow("own", F.lit(temper)).alias("t"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("t").alias("all")))).select(dimension, (F.col("t") / F.col("all")).alias("target"))


def marginal_error(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest error of a class's share, relative to its target; 1 for a target class without weight. Targets of a
    dimension count as shares of their sum. All dimensions are summed in one pass; a row for each is collected."""
    classes = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS)))
    parts = fitted.select(classes.alias("of"), "fitted").select("of.dimension", "of.value", F.col("fitted").alias("now"), F.lit(0.0).alias("target"))
    for d in DIMENSIONS:
        parts = parts.union(targets[d].select(F.lit(d), F.col(d).cast("string"), F.lit(0.0), F.coalesce(F.col("target").cast("double"), F.lit(0.0))))
    met = parts.groupBy("dimension", "value").agg(F.sum("now").alias("now"), F.sum("target").alias("target"))
    gain = F.when(F.col("target") > 0, F.col("now") / F.col("target"))
    whole = met.groupBy("dimension").agg(
        F.sum("now").alias("all"), F.sum("target").alias("goal"), F.max(gain).alias("most"), F.min(gain).alias("least"),
        F.max(F.when(F.col("target") > 0, 0.0).otherwise(F.col("now"))).alias("stray"),  # a class without a target has no weight
    )
    error = 0.0
    for r in whole.collect():
        scale = r["goal"] / r["all"] if r["all"] > 0 else 0.0
        if r["most"] is not None:
            error = max(error, r["most"] * scale - 1, 1 - r["least"] * scale)
        if r["all"] > 0:
            error = max(error, r["stray"] / r["all"])
    return error


def rake(table: DataFrame, targets: dict[str, DataFrame], cycles: int, scratch: Scratch) -> tuple[DataFrame, float]:
    """``table`` of cells (source, lang, topic, w) with column fitted, as shares of 1, and the error that is left. In
    each cycle each dimension is met once; a value that has no target gets none, and no cell of weight 0 gains any.
    At least ``cycles`` are taken, and more until the error is below TOLERANCE or falls no more. The cells carry their
    targets and are written after each dimension: a step reads them twice, and steps upon steps would double the plan,
    which the driver holds and plans again for each of its stages."""
    fitted = table.withColumn("fitted", F.col("w").cast("double"))
    for d in DIMENSIONS:
        fitted = fitted.join(targets[d].select(d, F.col("target").cast("double").alias(f"{d}_target")), d, "left")
    step = 0
    fitted = scratch.save(fitted, f"fit-{step}")
    cycle, errors = 0, []
    while cycle < cycles or (errors and errors[-1] > TOLERANCE and not (len(errors) > STALL and errors[-1] > 0.99 * errors[-1 - STALL])):
        cycle += 1
        for d in DIMENSIONS:
            now = fitted.groupBy(d).agg(F.sum("fitted").alias("now"), F.max(f"{d}_target").alias("target"))
            factor = now.select(d, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("factor"))
            met = fitted.join(factor, d, "left").withColumn("fitted", F.col("fitted") * F.coalesce("factor", F.lit(0.0)))
            step += 1
            fitted = scratch.save(met.select(*fitted.columns), f"fit-{step}")
            scratch.drop(f"fit-{step - 1}")
        if cycle >= cycles:
            errors.append(marginal_error(fitted, targets))
    return fitted, errors[-1] if errors else marginal_error(fitted, targets)


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, cycles: int = CYCLES, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """One row per input row: id, source, lang, topic, tokens, ratio, probability, weight, kept.

    ``targets``: by dimension, a frame of its values and column target; tempered shares of the corpus
    otherwise. ``ratio`` is a cell's fitted share over its own, ``probability`` is min(1, ratio), and ``weight``
    is ratio / probability, what a kept document's tokens count for. Null sources, languages and topics are
    the class unknown; null text is empty and has one token, as has every empty one. Rows with equal ids
    are kept or dropped alike in a cell; a null id is dropped unless its probability is 1. Other columns are
    not read. Raking takes ``cycles`` cycles at least, and warns of the error where the targets can't be met.
    The cells are aggregated before anything is shuffled, and only they are iterated over.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(cells(docs, id_col, text_col, source_col, lang_col, topic), "rows")
    table = scratch.save(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("w")), "cells")
    goals = {d: scratch.save((targets or {}).get(d, tempered(table, d, temper)).select(F.col(d), F.col("target")), f"target-{d}") for d in DIMENSIONS}
    fitted, error = rake(table, goals, cycles, scratch)
    if error > TOLERANCE:
        warnings.warn(f"the mixture's targets aren't met: a class's share is off by {error:.2g} of its target", stacklevel=2)
    total = fitted.agg(F.sum("w").alias("all"), F.sum("fitted").alias("fit"))
    ratio = fitted.crossJoin(F.broadcast(total)).select(*DIMENSIONS, F.round(F.when(F.col("fit") > 0, F.col("fitted") / F.col("fit") / (F.col("w") / F.col("all"))).otherwise(0.0), 9).alias("ratio"))
    probability = F.least(F.lit(1.0), F.col("ratio"))
    return rows.join(ratio, list(DIMENSIONS)).select(
        "id", *DIMENSIONS, "tokens", "ratio",
        probability.alias("probability"),
        F.greatest(F.lit(1.0), F.col("ratio")).alias("weight"),
        F.coalesce((probability >= 1.0) | (uniform(F.col("id"), seed) < probability), F.lit(False)).alias("kept"),
    )


def mix_sql(documents: str = "documents", temper: float = TEMPER, cycles: int = CYCLES, seed: int = 17) -> str:
    """The same in SQL: common table expressions ending in one named mixed, over a relation of documents."""
    topic = f"'{OTHER}'"
    for name, cue in reversed(CUES):
        topic = f"CASE WHEN regexp_matches(coalesce(text, ''), '{cue}') THEN '{name}' ELSE {topic} END"
    parts = [
        f"""mrows AS MATERIALIZED (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {topic} AS topic,
  CAST(greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 4.0)) AS BIGINT) AS tokens FROM {documents})""",
        "fit0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS w, CAST(sum(tokens) AS DOUBLE) AS fitted FROM mrows GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"goal_{d} AS MATERIALIZED (SELECT {d}, t / sum(t) OVER () AS target FROM (SELECT {d}, pow(CAST(sum(w) AS DOUBLE), {temper}) AS t FROM fit0 GROUP BY {d}))")
    n = 0
    for _ in range(cycles):
        for d in DIMENSIONS:
            parts.append(f"fit{n + 1} AS MATERIALIZED (SELECT source, lang, topic, w, fitted * target / sum(fitted) OVER (PARTITION BY {d}) AS fitted FROM fit{n} JOIN goal_{d} USING ({d}))")
            n += 1
    parts.append(f"ratios AS MATERIALIZED (SELECT source, lang, topic, round(fitted / sum(fitted) OVER () / (w / sum(w) OVER ()), 9) AS ratio FROM fit{n})")
    u = f"CAST(('0x' || substr(md5('{seed}:' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0"
    parts.append(f"mixed AS MATERIALIZED (SELECT doc_id, source, lang, topic, tokens, ratio, least(1.0, ratio) AS probability, greatest(1.0, ratio) AS weight, ratio >= 1.0 OR {u} < ratio AS kept FROM mrows JOIN ratios USING (source, lang, topic))")
    return ",\n".join(parts)
