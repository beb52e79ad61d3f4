"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, all in DataFrame expressions.

Tokens are words here. Each source's documents stand in a seeded order; that stream of words, repeated, is cut into
blocks of block_words. Seats (blocks) go to the highest quotients target / (2k - 1). The method is house-monotone, so the
seats of the first i shards are a prefix of those of all shards, and their differences are the integer quotas of shard i.
A source's seats are the first blocks of its seeded stream: no document is cut but the one where they end. Shard i takes
the quota of blocks that follow those of the shards before, so each word that the mix takes is in one shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import cut, picked

WORD = r"[^\x20\x09-\x0D]+"
#: The seeded hash has 60 bits; its first BUCKET_BITS split a hot source's order into that many independent parts.
HASH_BITS, BUCKET_BITS = 60, 12


@dataclass
class Mix:
    """quotas: (shard, source, blocks). documents: (doc_id, source, size, source_size, target, taken, shard), one row for each input row;
    shard is where its first word is taken, null if none is."""

    quotas: DataFrame
    documents: DataFrame


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(doc_id: Column, seed: int) -> Column:
    """60 bits of an MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources (source, source_size) with place, weight, total and target.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    `most` times its source's size; the excess is shared by weight among the rest until none is above. In ascending order
    of bound by weight, a source is bounded while its bound is below its share of what is left, so one pass finds all.
    """
    named = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("bigint")
    every, so_far = Window.partitionBy(), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    bounded = (
        named.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
        .withColumn("ratio", F.col("bound") / F.col("weight")).withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("bound").over(so_far), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
    )
    d = lambda c: F.col(c).cast("decimal(19,0)")
    level = F.min(F.when(d("bound") * d("weight_left") >= d("weight") * d("left"), F.struct("ratio", "place", "left", "weight_left"))).over(every)
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weight_left")
    within = F.struct("ratio", "place") < F.struct("level.ratio", "level.place")
    return bounded.withColumn("level", level).select("source", "source_size", "place", "weight", "total", F.when(F.col("level").isNull() | within, F.col("bound").cast("double")).otherwise(share).alias("target"))


def apportion(aims: DataFrame, block_words: int, shards: int, most: int = 3) -> DataFrame:
    """(shard, source, place, seats): the seats of all shards up to this one (1 to shards), for targets()'s rows.

    Only the seats near a source's own share are compared: the divisor that gives n seats to S sources is within
    2 S / n of the plain one, so the seats below `low` are sure and those above `high` are out of reach. That leaves a
    few rows for each source and shard, whatever the number of seats.
    """
    every = Window.partitionBy()
    n, q, s = F.col("n"), F.col("target") / F.col("total") * F.col("n"), F.col("n_sources")
    rows = (
        aims.where("total > 0").withColumn("n_sources", F.count("*").over(every)).withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("n", F.expr(f"cast(floor(shard * cast(total div {block_words} as decimal(19,0)) / {shards}) as bigint)"))
        .withColumn("bound", F.expr(f"(source_size * {most}) div {block_words}"))
        .withColumn("low", F.greatest(F.lit(0), F.least("bound", F.floor(q * (1 - s / F.greatest(n, F.lit(1))) - 2))))
        .withColumn("high", F.least("bound", F.ceil(q * (1 + 2 * s / F.greatest(n, F.lit(1))) + 2)))
    )
    spare = rows.groupBy("shard").agg((F.first("n") - F.sum("low")).alias("spare"))
    tried = rows.where("high > low").withColumn("k", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    order = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "place")
    won = tried.withColumn("rank", F.row_number().over(order)).join(spare, "shard").where("rank <= spare").groupBy("shard", "place").agg(F.count("*").alias("won"))
    return rows.join(won, ["shard", "place"], "left").select("shard", "source", "place", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, block_words: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The quotas; for each source and hash bucket, where it begins in its source; for each source, its size, its target and the words that it has given when each shard ends."""
    rows = picked(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = cut(rows.select("source", n_words(F.col("text")).alias("size"), bucket(F.col("doc_id"), seed).alias("bucket")).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "sizes")
    aims = cut(targets(sized.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most), "targets")
    seats = cut(apportion(aims, block_words, shards, most), "seats")
    quota = F.col("seats") - F.coalesce(F.lag("seats").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    quotas = seats.select("shard", "source", quota.alias("blocks"))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", (F.col("seats") * block_words).alias("words")))), lambda x: x["words"])
    by_source = seats.groupBy("place").agg(ends.alias("ends"))
    none = F.array_repeat(F.lit(0).cast("bigint"), shards)
    aimed = aims.join(by_source, "place", "left").select("source", "source_size", "target", F.coalesce("ends", none).alias("ends"))
    at = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    placed = sized.withColumn("bucket_at", at).select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), F.col("bucket_at").alias("__bucket_at"))
    return quotas, placed, cut(aimed.select(*(F.col(c).alias(f"__aim_{c}") for c in aimed.columns)), "aims")


def bucket(doc_id: Column, seed: int) -> Column:
    return F.shiftright(seeded(doc_id, seed), HASH_BITS - BUCKET_BITS).cast("int")


def _taken(docs: DataFrame, placed: DataFrame, aims: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs, all columns, with __size, __taken and __shard, and with __aim_source_size and __aim_target of the source."""
    doc_id, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    rows = docs.withColumns({"__size": n_words(F.col(f"`{text_col}`")), "__h": seeded(doc_id, seed)}).withColumn("__its_bucket", F.shiftright("__h", HASH_BITS - BUCKET_BITS).cast("int"))
    found = rows.join(placed, source.eqNullSafe(F.col("__source")) & (F.col("__its_bucket") == F.col("__bucket")))
    own = Window.partitionBy("__source", "__bucket").orderBy("__h", doc_id.asc_nulls_first(), "__size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__bucket_at") + F.sum("__size").over(own) - F.col("__size")
    found = found.withColumn("__start", start).join(aims, F.col("__source").eqNullSafe(F.col("__aim_source")))
    words, size = F.element_at("__aim_ends", -1), F.greatest("__aim_source_size", F.lit(1))
    rounds, rest = F.floor(words / size).cast("bigint"), words % size
    taken = rounds * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__start")))
    found = found.withColumn("__taken", taken.cast("bigint"))
    before = F.size(F.filter("__aim_ends", lambda e: e <= F.col("__start")))
    return found.withColumn("__shard", F.when(F.col("__taken") > 0, before + 1))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 16, shards: int = 64, seed: int = 7) -> Mix:
    """Mix all documents by source; see Mix.

    taken counts the words that the mix takes of a document, repeats included: never over `most` times its size. Null and
    empty texts have size 0 and give 0; null sources are one source, the last; null ids come first among equal hashes.
    Repeated rows count once each. An empty table gives empty results. Reruns agree: order hangs on seed, id and size only.
    A source's order is split by hash bucket, so that a hot source's documents are summed in many tasks.
    """
    quotas, placed, aims = _plan(docs, id_col, text_col, source_col, weights, most, block_words, shards, seed)
    rows = picked(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", "text")
    done = _taken(rows, placed, aims, "doc_id", "text", "source", seed)
    return Mix(quotas, done.select("doc_id", "source", F.col("__size").alias("size"), F.col("__aim_source_size").alias("source_size"), F.col("__aim_target").alias("target"), F.col("__taken").alias("taken"), F.col("__shard").alias("shard")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 16, shards: int = 64, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken.

    Null and empty texts have no words, so they have no row. Ids that tie go by size; rows equal in both go in any order, which
    changes no count. Null sources are one source; an empty table gives an empty result.

    A document taken whole keeps its text; where its source's blocks end within it, a row has its first words alone, with
    the white space before each, and chars_col, if it is a column, follows. Documents of which nothing is taken have no row.
    """
    _, placed, aims = _plan(docs, id_col, text_col, source_col, weights, most, block_words, shards, seed)
    rows = _taken(docs, placed, aims, id_col, text_col, source_col, seed).where("__taken > 0")
    times = rows.withColumn("__part", F.explode(F.expr("transform(sequence(1, cast(ceil(__taken / cast(__size as double)) as int)), i -> least(__size, __taken - (i - 1) * __size))")))
    text, part = F.col(f"`{text_col}`"), F.col("__part")
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    whole = part == F.col("__size")
    out = {text_col: F.when(whole, text).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), ""))}
    if chars_col in docs.columns:
        out[chars_col] = F.when(whole, F.col(f"`{chars_col}`")).otherwise(F.char_length(out[text_col]))
    return times.select(*(out[c].cast(docs.schema[c].dataType).alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(concat_ws(':', '7', doc_id::VARCHAR)), 1, 15) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, source_size * 3 AS bound, sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, total - coalesce(sum(bound) OVER w, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
         row_number() OVER (ORDER BY bound / weight, place) AS nth
  FROM weighed WINDOW w AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT nth AS first_free, remaining, weight_left FROM filled WHERE bound * weight_left >= weight * remaining ORDER BY nth LIMIT 1),
aims AS (
  SELECT f.source, f.source_size, f.place, f.total,
         CASE WHEN l.first_free IS NULL OR f.nth < l.first_free THEN f.bound::DOUBLE
              ELSE (f.weight * l.remaining)::DOUBLE / l.weight_left END AS target
  FROM filled f LEFT JOIN level l ON true),
tried AS (
  SELECT place, total, target, unnest(range(1, (source_size * 3) // 16 + 1)) AS k FROM aims),
ranked AS (
  SELECT place, total, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place) AS nth FROM tried),
shards AS (SELECT unnest(range(1, 65)) AS shard),
seats AS (
  SELECT place, shard, count(*) * 16 AS words FROM ranked JOIN shards ON nth <= shard * (total // 16) // 64 GROUP BY place, shard),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.place, coalesce(w.words, 0) AS words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN seats w ON a.place = w.place AND w.shard = 64),
taken AS (
  SELECT *, ((words // greatest(source_size, 1)) * size + greatest(0, least(size, words % greatest(source_size, 1) - start)))::BIGINT AS taken FROM placed),
ends AS (SELECT place, list(words ORDER BY shard) AS ends FROM seats GROUP BY place)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN 65 - len(list_filter(ends, lambda e: e > start)) END AS shard
FROM taken LEFT JOIN ends USING (place)
"""
