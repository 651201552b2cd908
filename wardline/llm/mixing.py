"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Source i holds a share p_i of all tokens. Its weight is p_i^a / sum p^a; a = 1 keeps the shares, a = 0
makes all sources equal. The exponent is found by bisection as the largest one whose weights reach the
target entropy, or the smallest one that repeats no source more often than the limit.

A budget of B tokens gives source i floor(w_i B) tokens. They are dealt in blocks, each one a permutation
of the source's documents (by hash of document and block number): as many whole blocks as fit, then the
longest beginning of one more block that stays within the source's tokens.

Only DataFrame operations run on executors. Which documents begin a permutation is decided by one cut per
source, found by radix selection: token sums per leading hex digits of the hash, narrowed digit pair by
digit pair. So a source with a third of all rows is only ever summed map-side, never sorted or windowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, private_names, table

STEPS = 60
#: Hex digits looked at per narrowing pass: 256 sums per source.
DIGITS = 2
NO_CUT, ALL = "", "g"  # below and above every hex digit
WEIGHT_DIGITS = 9


@dataclass(frozen=True)
class Target:
    """Either ``entropy`` (as a fraction of the largest, log of the number of sources) or ``repeats`` (largest passes over a source)."""

    entropy: float | None = None
    repeats: float | None = None
    budget: float = 1.0  # tokens of the mixture as a multiple of the corpus' tokens


def weights(tokens: dict, target: Target) -> dict:
    """Normalised weights by source, rounded to 9 digits; sources without tokens get 0."""
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("give an entropy or a repetition limit")
    held = {s: n for s, n in tokens.items() if n > 0}
    total = sum(held.values())
    if not total:
        return dict.fromkeys(tokens, 0.0)
    shares = {s: n / total for s, n in sorted(held.items())}

    def at(a: float) -> dict:
        raised = {s: p**a for s, p in shares.items()}
        norm = math.fsum(raised.values())
        return {s: v / norm for s, v in raised.items()}

    def flat_enough(w: dict) -> bool:
        return -math.fsum(v * math.log(v) for v in w.values() if v) >= target.entropy * math.log(len(w))

    def fits(w: dict) -> bool:
        return all(w[s] * target.budget / shares[s] <= target.repeats for s in w)

    # flat_enough holds from 0 up to some exponent; fits holds from some exponent up to 1.
    low, high = 0.0, 1.0
    if target.entropy is not None:
        if flat_enough(at(1.0)):
            low = 1.0
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if flat_enough(at(middle)) else (low, middle)
        best = at(low)
    else:
        if fits(at(0.0)):
            high = 0.0
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(at(middle)) else (middle, high)
        best = at(high)
    return {s: round(best.get(s, 0.0), WEIGHT_DIGITS) for s in tokens}


def n_words(text: Column) -> Column:
    """Tokens of a text: runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def place_key(doc_id: Column, block: Column) -> Column:
    """A document's place in a block's permutation; rows of equal id share it (null ids too)."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), block.cast("string")).cast("binary"))


def plan(docs: DataFrame, target: Target) -> list[dict]:
    """Per source: weight, budget, whole blocks, and the cut of the last block (documents with a smaller place key are in).

    ``docs``: (doc_id, source, n_tokens). A number of rows per source and pass reaches the driver.
    """
    slim = cut_lineage(docs.select("doc_id", source_key(F.col("source")).alias("s"), "n_tokens"))
    tokens = {r["s"]: r["n"] for r in slim.groupBy("s").agg(F.sum("n_tokens").alias("n")).collect()}
    total, mix = sum(tokens.values()), weights(tokens, target)
    rows = []
    for s in sorted(tokens):
        budget = math.floor(mix[s] * target.budget * total)
        whole, left = divmod(budget, tokens[s]) if tokens[s] else (0, 0)
        rows.append({"s": s, "weight": mix[s], "tokens": tokens[s], "budget": budget, "blocks": whole, "left": left, "cut": NO_CUT})
    # Radix selection: ``prefix`` is the group of keys the cut falls in, ``left`` what may still be taken from it.
    open_rows = {r["s"]: r for r in rows if r["left"] > 0}
    prefix = dict.fromkeys(open_rows, "")
    for depth in range(0, 32, DIGITS):
        if not open_rows:
            break
        cases = _by_source({s: (open_rows[s]["blocks"], prefix[s]) for s in open_rows}, "struct<block:bigint,prefix:string>")
        keyed = slim.withColumn("at", cases[F.col("s")]).filter(F.col("at").isNotNull())
        keyed = keyed.withColumn("k", place_key(F.col("doc_id"), F.col("at.block")))
        inside = keyed.filter(F.substring("k", 1, depth) == F.col("at.prefix"))
        sums = inside.groupBy("s", F.substring("k", 1, depth + DIGITS).alias("p")).agg(F.sum("n_tokens").alias("n"))
        by_source: dict[str, list] = {}
        for r in sums.collect():
            by_source.setdefault(r["s"], []).append((r["p"], r["n"]))
        for s in list(open_rows):
            row = open_rows[s]
            for p, n in sorted(by_source.get(s, [])):
                if n > row["left"]:
                    prefix[s] = p
                    row["cut"] = p  # keys below this group are in; narrowed in the next pass
                    break
                row["left"] -= n
            else:
                row["cut"] = prefix[s] + ALL
                del open_rows[s]
    return rows


def _by_source(values: dict, kind: str) -> Column:
    """A map literal from source to a struct, from Python tuples."""
    names = [part.split(":")[0] for part in kind[7:-1].split(",")]
    pairs = []
    for s, v in values.items():
        pairs += [F.lit(s), F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)]).cast(kind)]
    return F.create_map(*pairs)


def mix(docs: DataFrame, target: Target, block: str = "block", n_tokens: Column | None = None) -> DataFrame:
    """Every document as often as the mixture reads it, with the number of the block added.

    Columns of docs stay as they are, but one named like ``block`` is replaced. Documents without tokens belong to every block of their source's
    permutation like others. A null or empty text has 0 tokens; an empty table, or one without tokens,
    gives no rows. Rows of equal doc_id (null ids too) are taken or left together.
    """
    docs = docs.drop(block)
    tokens = n_words(F.col("text")) if n_tokens is None else n_tokens
    rows = plan(docs.select("doc_id", "source", tokens.alias("n_tokens")), target)
    key, at = private_names(docs, ["_source", "_plan"])
    if not rows:
        return docs.withColumn(block, F.lit(0).cast("bigint")).filter(F.lit(False))
    cases = _by_source({r["s"]: (r["blocks"], r["cut"]) for r in rows}, "struct<blocks:bigint,cut:string>")
    planned = docs.withColumn(key, source_key(F.col("source"))).withColumn(at, cases[F.col(key)])
    whole = F.col(f"{at}.blocks")
    times = whole + (place_key(F.col("doc_id"), whole) < F.col(f"{at}.cut")).cast("bigint")
    repeated = F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1))
    return planned.withColumn(block, F.explode(repeated)).select(*docs.columns, block)


#: Production parameters of the query and of the pipeline stage: 97 % of the largest entropy, one corpus' worth of tokens.
TARGET = Target(entropy=0.97, budget=1.0)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = docs.select("doc_id", "source", n_words(F.col("text")).alias("n_tokens"))
    return mix(counted, TARGET, n_tokens=F.col("n_tokens")).select("doc_id", "source", "block", "n_tokens")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents of large sources are thinned, those of small ones are repeated."""
    (block,) = private_names(docs, ["block"])
    return mix(docs, TARGET, block=block).select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
t AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY s),
held AS (SELECT s, n / (SELECT sum(n) FROM t) AS p FROM t WHERE n > 0),
ps AS (SELECT list(p ORDER BY s) AS p FROM held),
step AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN m ELSE lo END, CASE WHEN flat THEN hi ELSE m END FROM (
    SELECT i, lo, hi, m,
      -list_sum(list_transform(p, lambda x: pow(x, m) / z * ln(pow(x, m) / z))) >= {TARGET.entropy} * ln(len(p)) AS flat
    FROM (SELECT i, lo, hi, p, (lo + hi) / 2 AS m, list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS z
          FROM step, ps WHERE i < {STEPS}))),
best AS (
  SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {TARGET.entropy} * ln(len(p)) THEN 1.0 ELSE lo END AS a
  FROM step, ps WHERE i = {STEPS}),
w AS (SELECT s, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM held, best), {WEIGHT_DIGITS}) AS w FROM held, best),
b AS (SELECT s, n, CAST(floor(w * {TARGET.budget} * (SELECT sum(n) FROM t)) AS BIGINT) AS budget FROM t JOIN w USING (s)),
blocks AS (SELECT s, n, budget // n AS whole, budget % n AS rest FROM b),
keyed AS (
  SELECT d.*, whole, rest, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(whole AS VARCHAR)) AS k
  FROM d JOIN blocks USING (s)),
taken AS (
  SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY s ORDER BY k) <= rest AND rest > 0 THEN 1 ELSE 0 END AS times
  FROM keyed)
SELECT doc_id, source, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS block, n_tokens FROM taken WHERE times > 0
"""
