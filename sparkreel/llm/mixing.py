"""Temperature mixing of sources, in DataFrame functions only.

A source's token share p becomes the weight p**a / sum(p**a). The exponent a is found by
bisection on [0, 1]: the smallest (flattest) one for which no source is repeated more than
`repetitions` times and, if `entropy` is given, the weights' entropy is at most that part
of its maximum. Both fall as a grows. a is rounded up to six digits. If no exponent up to 1
meets both, it is 1, the nearest to the limits (sources in proportion), and `met` in the plan is false.

The weights are realised in tokens. With `budget` None the mix is the smallest one that
reads every source in full at least once, so nothing is dropped; otherwise `budget` is the
mix's size as a multiple of the corpus, and a source whose part is below its size is read
in part. A source is dealt by hash into blocks of about BLOCK_TOKENS. In every epoch its
blocks stand in a permutation of their own and so do the documents of a block; blocks are
taken whole until the source's tokens are used up, and the block where that happens is cut
after the document that reaches them.

Scale. Sources are one row each and the bisection works on that list. Documents shuffle
once, by (source, block), so a source with a third of all rows is as many groups as it has
blocks, and the only windows over documents are inside a block.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Defined cases: null or empty text has 0 tokens and is
read with its block; a source without any token is read once. A null source is a source of
its own. Repeated rows are read each for itself; rows with a null doc_id are read like any
other. A docs table without rows gives none. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import cut

REPETITIONS, BLOCK_TOKENS, SEED = 2.0, 1_000_000, 7
STEPS = 40
#: Up to so many sources their table (one narrow row each) is broadcast; beyond, documents join it by shuffle.
FEW_SOURCES = 10_000


def _exponent(repetitions: float, entropy: float | None, budget: float | None) -> tuple[str, str]:
    """SQL for whether there is an exponent and for it, from an array `shares` of positive shares."""
    z = "aggregate(shares, 0D, (s, p) -> s + pow(p, (b.lo + b.hi) / 2))"
    low, high = "array_min(shares)", "array_max(shares)"
    if budget is None:
        repeated = f"pow({low} / {high}, (b.lo + b.hi) / 2 - 1)"
    else:
        repeated = f"{budget}D * pow({low}, (b.lo + b.hi) / 2 - 1) / {z}"
    fits = f"{repeated} <= {repetitions}D"
    if entropy is not None:
        # -sum(w log w) = log z - a * sum(p**a log p) / z
        h = f"ln({z}) - (b.lo + b.hi) / 2 * aggregate(shares, 0D, (s, p) -> s + pow(p, (b.lo + b.hi) / 2) * ln(p)) / {z}"
        fits += f" and {h} <= {entropy}D * ln(size(shares))"
    new = f"if({fits}, named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2), named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi))"
    at_one = fits.replace("(b.lo + b.hi) / 2", "1D")
    return at_one, f"ceil(aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (b, i) -> {new}).hi * 1e6D) / 1e6D"


def plan(docs: DataFrame, repetitions: float = REPETITIONS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source of docs (_source, _tokens): tokens, weight, exponent, whether it meets the limits, the tokens to read (quota) and its blocks."""
    each = docs.groupBy("_source").agg(F.sum("_tokens").alias("tokens"))
    total = each.agg(F.sum("tokens").alias("total"), F.expr("collect_list(tokens) filter (where tokens > 0)").alias("all"))
    a = total.withColumn("shares", F.expr("array_sort(transform(all, t -> t / total))"))
    met, exponent = _exponent(repetitions, entropy, budget)
    a = a.withColumns({"exponent": F.expr(exponent), "met": F.coalesce(F.expr(met), F.lit(True))})
    a = a.withColumn("z", F.expr("aggregate(shares, 0D, (s, p) -> s + pow(p, exponent))"))
    size = "pow(array_max(shares), 1 - exponent) * z * total" if budget is None else f"{budget}D * total"
    a = a.withColumn("size", F.expr(size)).select("total", "exponent", "met", "z", "size")
    out = each.crossJoin(a).withColumn("weight", F.expr("if(tokens > 0, pow(tokens / total, exponent) / z, 0D)"))
    quota = "cast(round(size * weight) as long)"
    out = out.withColumn("quota", F.expr(f"greatest({quota}, tokens)" if budget is None else quota))
    return out.select("_source", "tokens", "exponent", "met", "weight", "quota", F.expr(f"cast(ceil(greatest(tokens, 1) / {block_tokens}) as long)").alias("blocks"))


def _hash(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def mix(docs: DataFrame, repetitions: float = REPETITIONS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mix: rows of docs (doc_id, text, source, ...), each as often as it is read, with epoch, block, block_rank, position and tokens."""
    s = F.lit(seed)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # any column name may clash with those used here
    name = F.coalesce(F.concat(F.lit("s"), F.col(own["source"]).cast("string")), F.lit("n"))
    tokens = F.coalesce(F.regexp_count(F.col(own["text"]), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.toDF(*own.values()).withColumns({"_source": name, "_tokens": tokens, "_id": F.coalesce(F.col(own["doc_id"]).cast("string"), F.lit("n"))})
    sources = cut(plan(rows.select("_source", "_tokens"), repetitions, entropy, budget, block_tokens))
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)

    def in_block(df):
        return df.join(sources, "_source").withColumn("_block", F.conv(F.substring(_hash(F.col("_id"), s), 1, 8), 16, 10).cast("long") % F.col("blocks"))

    all_once = " or _epoch = 0" if budget is None else ""  # quotas are the sources' tokens or more; documents without tokens may stand after them
    blocks = in_block(rows.select("_source", "_tokens", "_id")).groupBy("_source", "_block", "tokens", "quota").agg(F.sum("_tokens").alias("_size"))
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long")
    blocks = blocks.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(epochs, F.lit(1).cast("long")) - 1)))
    order = W.partitionBy("_source", "_epoch").orderBy(_hash(F.col("_source"), F.col("_block"), F.col("_epoch"), s), "_block")
    blocks = blocks.withColumns({"_rank": F.row_number().over(order).cast("long") - 1, "_before": F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")})
    blocks = blocks.withColumn("_left", F.col("quota") - F.col("_epoch") * F.col("tokens") - F.col("_before")).where(f"_left > 0 or tokens = 0{all_once}").select("_source", "_block", "_epoch", "_rank", "_left", "tokens")

    read = in_block(rows).drop("tokens", "exponent", "met", "weight", "quota", "blocks").join(blocks, ["_source", "_block"])
    inside = W.partitionBy("_source", "_block", "_epoch").orderBy(_hash(F.col("_id"), F.col("_epoch"), s), "_id", F.xxhash64(own["text"]))
    read = read.withColumns({"_position": F.row_number().over(inside).cast("long") - 1, "_upto": F.sum("_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_tokens")})
    read = read.where(f"_upto < _left or tokens = 0{all_once}")
    extra = {"epoch": "_epoch", "block": "_block", "block_rank": "_rank", "position": "_position", "tokens": "_tokens"}
    return read.select(*[F.col(v).alias(k) for k, v in own.items()], *[F.col(v).alias(k) for k, v in extra.items() if k not in docs.columns])


#: The mix of `documents` with the parameters of op3 in DuckDB.
ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(doc_id::VARCHAR, 'n') AS id, text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tok FROM documents),
each_ AS (SELECT src, sum(tok)::BIGINT AS tokens FROM rows_ GROUP BY src),
total_ AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens) FILTER (tokens > 0) AS lo, max(tokens) AS hi FROM each_),
bis(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN b.lo ELSE (b.lo + b.hi) / 2 END, CASE WHEN ok THEN (b.lo + b.hi) / 2 ELSE b.hi END
  FROM (SELECT bis.*, 1e0 * pow(t.lo / t.total, (bis.lo + bis.hi) / 2 - 1)
          / (SELECT sum(pow(tokens / t.total, (bis.lo + bis.hi) / 2)) FROM each_ WHERE tokens > 0) <= {REPETITIONS}e0 AS ok
        FROM bis, total_ t WHERE i < {STEPS}) b),
a_ AS (SELECT ceil(hi * 1e6) / 1e6 AS a FROM bis WHERE i = {STEPS}),
z_ AS (SELECT sum(pow(tokens / total, a)) AS z FROM each_, total_, a_ WHERE tokens > 0),
plan_ AS (SELECT src, tokens, CASE WHEN tokens > 0 THEN round(total * pow(tokens / total, a) / z) ELSE 0 END::BIGINT AS quota,
    ceil(greatest(tokens, 1) / {BLOCK_TOKENS}e0)::BIGINT AS blocks FROM each_, total_, a_, z_),
dealt AS (SELECT r.*, p.tokens, p.quota, ('0x' || substr(md5(id || '|{SEED}'), 1, 8))::BIGINT % p.blocks AS block FROM rows_ r JOIN plan_ p USING (src)),
sized AS (SELECT src, block, tokens, quota, sum(tok)::BIGINT AS size FROM dealt GROUP BY ALL),
epochs AS (SELECT *, unnest(range(greatest(CASE WHEN tokens > 0 THEN ceil(quota / tokens::DOUBLE) ELSE 1 END::BIGINT, 1))) AS epoch FROM sized),
ranked AS (SELECT *, row_number() OVER w - 1 AS block_rank, sum(size) OVER w - size AS before FROM epochs
  WINDOW w AS (PARTITION BY src, epoch ORDER BY md5(src || '|' || block || '|' || epoch || '|{SEED}'), block ROWS UNBOUNDED PRECEDING)),
left_ AS (SELECT src, block, epoch, block_rank, quota - epoch * tokens - before AS remains FROM ranked WHERE quota - epoch * tokens - before > 0 OR tokens = 0),
read_ AS (SELECT d.*, l.epoch, l.block_rank, l.remains, row_number() OVER w - 1 AS position, sum(tok) OVER w - tok AS upto FROM dealt d JOIN left_ l USING (src, block)
  WINDOW w AS (PARTITION BY src, block, l.epoch ORDER BY md5(id || '|' || l.epoch || '|{SEED}'), id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, epoch::BIGINT AS epoch, block::BIGINT AS block, block_rank::BIGINT AS block_rank, position::BIGINT AS position, tok AS tokens
FROM read_ WHERE upto < remains OR tokens = 0
"""
