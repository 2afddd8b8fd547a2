"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

A mix takes whole blocks of words: a shard is cut into blocks of equal size, at
most ``BLOCK`` words. Seats (block copies) are given to
sources by highest quotients of their targets, then a source's seats to its
shards by highest quotients of the shards' blocks. Inside a shard every block
is taken ``seats div blocks`` times, and the remaining seats go to the blocks
that come first in a seeded hash order. Documents lie end to end in a shard in
a seeded hash order, so a document gives the words that its blocks share with
it.

A source has about sqrt(words) / SHARD_ROOT shards: number and size of shards
both grow with the root of the source, so neither the windows over a shard nor
those over a source's shards hold more than a small part of a hot source.
Windows without a key hold one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.row_index import with_row_index
from basketlens.llm.common import WORD
from basketlens.session import materialize

#: Most words of a block.
BLOCK = 64
#: A source of n words has ceil(sqrt(n) / SHARD_ROOT) shards.
SHARD_ROOT = 32
#: Contract: the weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def _digest(seed: int, *columns: str) -> F.Column:
    """A seeded hash of columns, as hex digits (md5: the same in any engine)."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Give each group's ``seats`` to its parties by the highest quotients votes / 1, / 3, / 5, ...

    Adds ``given`` (long). Ties go to the smaller ``key``. Parties without votes
    get none. Every party starts with its rounded share; only the few quotients
    between that and the result are listed, not all.
    """
    same = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    shares = (parties.withColumn("__v", F.col(votes).cast("double"))
              .withColumn("__total", F.sum("__v").over(same))
              .withColumn("__share", F.expr(f"if(__total > 0, {seats} * __v / __total, 0D)"))
              .withColumn("__start", F.floor(F.col("__share") + 0.5).cast("long"))
              .withColumn("__left", F.col(seats) - F.sum("__start").over(same))
              .withColumn("__reach", F.expr("if(__v > 0, ceil((abs(__left) + count(*) over w) * __v / __total) + 1, 0)".replace("over w", f"over (partition by {', '.join(group) or '0'})")).cast("long")))
    # Seats are missing: the next quotients, highest first. Too many: the last quotients given, lowest first.
    more = "transform(sequence(1L, __reach), k -> struct(__v / (2 * (__start + k) - 1) as q, 1L as by))"
    less = "transform(sequence(1L, least(__reach, __start)), k -> struct(-__v / (2 * (__start - k) + 1) as q, -1L as by))"
    steps = shares.select("*", F.explode(F.expr(
        f"case when __left > 0 and __reach > 0 then {more} when __left < 0 and least(__reach, __start) > 0 then {less} end")).alias("__s"))
    # a lower quotient goes first when seats are taken back, so the later key loses a tie
    order = [F.col("__s.q").desc(), *[F.when(F.col("__left") > 0, F.col(c)).asc_nulls_last() for c in key], *[F.col(c).desc_nulls_first() for c in key]]
    ranked = steps.withColumn("__rank", F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)))
    ids = [c for c in [*group, *key]]
    changes = ranked.filter("__rank <= abs(__left)").groupBy(*ids).agg(F.sum("__s.by").alias("__by"))
    joined = shares.alias("s").join(changes.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ids], "left")
    return joined.select(*[F.col(f"s.{c}") for c in parties.columns], (F.col("__start") + F.coalesce("__by", F.lit(0))).cast("long").alias("given"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` -> with ``target`` in words.

    Sources in code-point order, null last, have the weights in turn and share
    ``share`` times all words; no target is over ``most`` times its source's
    words, and what that cuts off is shared by weight among the others, until
    none is above. (A level u with target = min(cap, weight * u): sources are
    capped in order of cap / weight.)
    """
    array = "array(" + ", ".join(map(str, weights)) + ")"
    every = Window.partitionBy(F.lit(0))  # one row per source
    ranked = (sizes.withColumn("__k", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("__w", F.expr(f"element_at({array}, cast((__k - 1) % {len(weights)} + 1 as int))").cast("double"))
              .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("__all", F.sum("source_size").over(every) * F.lit(float(share))))
    up = every.orderBy(F.col("__cap") / F.col("__w"), "__k").rowsBetween(Window.unboundedPreceding, -1)
    level = (ranked.withColumn("__taken", F.coalesce(F.sum("__cap").over(up), F.lit(0.0)))
             .withColumn("__rest", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(up), F.lit(0.0)))
             .withColumn("__u", (F.col("__all") - F.col("__taken")) / F.col("__rest"))
             # the first source in this order that its share does not fill sets the level of all later ones
             .withColumn("__level", F.min(F.when(F.col("__u") * F.col("__w") <= F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("a"), F.col("__k").alias("b"), F.col("__u").alias("u")))).over(every)))
    return level.select("source", "source_size", F.least("__cap", F.coalesce(F.col("__level.u") * F.col("__w"), F.col("__cap"))).alias("target"))


def _repeats(counted: DataFrame) -> DataFrame:
    """``place, again`` of the rows whose id is null or not theirs alone: a number each.

    The number is the row's position among them by id, source, size and text,
    so reruns agree (rows that agree in all of these stand for each other), and
    it enters the hash that deals rows to shards: no id brings its rows together.
    """
    shared = counted.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = counted.select("place", "doc_id", "source", "size", "text_hash")
    repeated = rows.filter("doc_id is null").unionByName(rows.filter("doc_id is not null").join(shared, "doc_id", "left_semi"))
    return with_row_index(repeated, ["doc_id", "source", "size", "text_hash", "place"], "again").select("place", "again")


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
           weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, again, shard`` and ``carry`` of every row: the shard that it is dealt to."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                          F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                          F.xxhash64(text_col).alias("text_hash"), *carry)
    counted = materialize(counted.withColumn("place", F.monotonically_increasing_id()), "sizes")
    counted = materialize(counted.join(_repeats(counted), "place", "left").drop("text_hash", "place"), "sizes")
    sizes = targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = materialize(sizes.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sqrt("source_size") / SHARD_ROOT))), "sources")
    return counted.join(sources, counted["source"].eqNullSafe(sources["source"])).select(
        counted["doc_id"], counted["source"], "size", "source_size", "target", *carry,
        "again", (F.conv(F.substring(_digest(seed, "doc_id", "again"), 1, 12), 16, 10).cast("long") % F.col("shards")).alias("shard"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(documents, pieces)`` of the mix.

    ``documents``: ``doc_id, source, size, source_size, target, taken`` for every
    row of ``docs``. ``pieces``: ``doc_id, source, size, first, words, copies``,
    the runs of words that the mix takes (``first`` counted from 0) and how
    often. A null or empty text has size 0 and gives nothing. A null source is
    a source of its own, the last. Rows with equal ids (or null ids) are
    documents of their own, dealt to shards one by one. An empty table gives an
    empty mix. ``documents`` also has the columns ``carry``; others
    are ignored; reruns agree.
    """
    dealt = placed(docs, id_col, text_col, source_col, seed, weights, share, most, carry)
    shards = materialize(dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
                         .withColumn("blocks", F.ceil(F.col("shard_size") / BLOCK)), "shards")
    # a source's votes are its target in blocks of its own mean size (about BLOCK words)
    votes = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.max("source_size").alias("size"), F.max("target").alias("target")).select(
        "source", F.expr("if(size > 0, target * blocks / size, 0D)").alias("votes"))
    seats = votes.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy(F.lit(0)))).cast("long"))
    by_source = apportion(seats, [], ["source"], "votes", "seats").select(F.col("source").alias("s"), F.col("given").alias("source_seats"))
    quotas = apportion(shards.join(by_source, F.col("source").eqNullSafe(F.col("s"))), ["source"], ["shard"], "blocks", "source_seats").select(
        "source", "shard", "blocks", "given").filter("blocks > 0 and given > 0")
    # a row per shard becomes one per block: dealt out before that, to tasks that are not merged as so few rows would be
    quotas = quotas.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "shard")
    by_shard = Window.partitionBy("source", "shard")
    taken = (quotas.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
             .withColumn("rank", F.row_number().over(by_shard.orderBy(_digest(seed, "source", "shard", "block"), "block")))
             .select("source", "shard", "block", F.expr(f"least({int(most)}, given div blocks + if(rank <= given % blocks, 1, 0))").alias("copies"))
             .filter("copies > 0"))
    order = by_shard.orderBy(_digest(seed + 1, "doc_id", "again"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("shard_size", F.sum("size").over(by_shard)).withColumn("blocks", F.ceil(F.col("shard_size") / BLOCK)).withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size")).withColumn("row", F.monotonically_increasing_id())
    laid = materialize(laid, "laid")
    parts = laid.filter("size > 0").select("row", "source", "shard", "start", "end", "shard_size", "blocks", F.explode(F.expr("sequence(start * blocks div shard_size, (end - 1) * blocks div shard_size)")).alias("block"))
    # Spark takes a side of blocks to be as small as the shards that they come from, and would send it through the driver
    joined = parts.alias("p").join(taken.hint("merge").alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.shard") == F.col("t.shard")) & (F.col("p.block") == F.col("t.block")))
    cut = joined.select("row", F.expr("greatest(start, (p.block * shard_size + blocks - 1) div blocks)").alias("from"), F.expr("least(end, ((p.block + 1) * shard_size + blocks - 1) div blocks)").alias("to"), "copies", "start")
    cut = materialize(cut.select("row", (F.col("from") - F.col("start")).alias("first"), (F.col("to") - F.col("from")).alias("words"), "copies"), "cut")
    sums = cut.groupBy("row").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
    documents = laid.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row", *carry)
    return documents, cut


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 2.0, **options) -> DataFrame:
    """The mix as rows of ``docs``: one row per copy of a document, its text the words of the blocks taken.

    Rows with equal ids (or null ids) are documents of their own: a number per
    row, written once, joins the pieces to their texts. A copy that takes all
    words has the text as it is; otherwise the words taken keep the white space
    behind them, but for the last. Documents of which nothing is taken go.
    """
    numbered = materialize(docs.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    documents, cut = mix(numbered, id_col, text_col, source_col, most=most, carry=("__number",), **options)
    pieces = cut.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "words", "copies"))).alias("__pieces")).join(
        documents.select("row", "__number", F.col("size").alias("__size")), "row").select("__number", "__size", "__pieces")
    joined = numbered.join(pieces, "__number")
    spaced = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    copies = joined.withColumn("__tokens", spaced).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(int(most)))))
    taken = copies.withColumn("__mine", F.expr("filter(__pieces, p -> p.copies >= __copy)")).filter("size(__mine) > 0")
    part = F.array_join(F.flatten(F.expr("transform(__mine, p -> slice(__tokens, cast(p.first + 1 as int), cast(p.words as int)))")), "")
    part = F.rtrim(part, F.lit(" \t\n\x0b\x0c\r"))
    whole = F.expr("aggregate(__mine, 0L, (s, p) -> s + p.words) = __size")
    return taken.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(part)).select(docs.columns)
