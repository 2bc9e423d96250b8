"""Mixing sources to target weights in equal-token blocks. DataFrame functions only.

Words of a source are laid out shard by shard in a seeded order of documents and cut into
blocks of `block` words. Sainte-Lague apportionment gives blocks to sources by their
targets, and then each source's blocks to its shards by their words. A shard takes its
quota as whole rounds over its blocks plus evenly spaced blocks from a seeded start.
Which words of a document these are follows from its place alone, so no block is a row.

A source has as many shards as its own words fill with LEAST_BLOCKS blocks each, a power of two and no more than the
square root of all rows: a small source of short texts has one, and both the shards of a source and the documents of
a (source, shard) stay small, whatever share of the rows one source holds. Shards have votes by their blocks, and a source no
more seats than `most` times its blocks, so that no quota is above what its shard may give.

Nulls: a null text has no words; null sources form one source, last in order; null ids are
ordinary values. Repeated rows are mixed one by one. An empty table gives an empty table.
A column of the input that is named like an added one gives way to it; whole rows are carried beside the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.llm.apportionment import filled_targets, sainte_lague
from brinewave.llm.rows import field, named, packed, unpacked, with_length
from brinewave.session import cut_lineage

# Fixed value: a word is a maximal run without these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BLOCK = 16
LEAST_BLOCKS = 64  # of a shard, on average, where a source has more than one
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def chosen_before(x: Column) -> Column:
    """Words among the first x of a shard that lie in the extra (seeded) blocks, for a block length column _b."""
    m, r, off, b = F.col("mix_blocks"), F.col("mix_rest"), F.col("mix_first"), F.col("_b")
    count = lambda j: F.floor((j + off) * r / m) - F.floor(off * r / m)
    j = F.least(m - 1, F.floor(x / b))
    return count(j) * b + (count(j + 1) - count(j)) * (x - j * b)


def placed(docs: DataFrame, seed: int, block: int, most: int, weights: tuple[int, ...], text: str, source: str, key: str, keep: list[str]) -> DataFrame:
    """`_row` (the kept columns), the added columns, and where the document's words lie among its shard's blocks."""
    row = packed(keep)
    # an escaped key keeps null apart from any source text
    name = F.when(named(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), named(source)))
    sized = cut_lineage(
        docs.select(row, name.alias("_source"), named(key).alias("_key"), word_count(named(text)).alias("size"))
    )
    finest = 1 << max(0, int(sized.count() ** 0.5)).bit_length()
    order = F.xxhash64(F.lit(seed), F.col("_key").cast("string"))
    dealt = sized.withColumn("_order", order).withColumn("_fine", F.pmod("_order", F.lit(finest)))

    fine = cut_lineage(dealt.groupBy("_source", "_fine").agg(F.sum("size").alias("_words")))
    sources = fine.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("_source") == "n", "_source")) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    shared = filled_targets(weighted, "source_size", "_weight", most, F.col("_source"))
    total = F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    seated = sainte_lague(shared.withColumn("_all", total).withColumn("_one", F.lit(1)), ["_one"], ["_source"], "target", "_all", "_blocks")
    # sources are few and small; the tables below join them by their key

    wanted = F.greatest(F.lit(1.0), F.col("source_size") / (block * LEAST_BLOCKS))
    number = F.least(F.lit(finest).cast("long"), F.pow(F.lit(2.0), F.floor(F.log2(wanted))).cast("long"))
    parts = fine.join(seated.select("_source", "source_size", "target", "_blocks"), "_source")
    parts = parts.withColumn("mix_shard", F.pmod(F.col("_fine"), number))
    own = ["_source", "mix_shard", "source_size", "target"]
    m = F.when(F.col("_words") > 0, F.greatest(F.lit(1).cast("long"), F.floor((F.col("_words") + block / 2) / block))).otherwise(F.lit(0).cast("long"))
    shards = parts.groupBy(*own, "_blocks").agg(F.sum("_words").alias("_words")).withColumn("_votes", m)
    seats = F.least(F.col("_blocks"), most * F.sum("_votes").over(Window.partitionBy("_source")))
    quotas = sainte_lague(shards.withColumn("_seats", seats), ["_source"], ["mix_shard"], "_votes", "_seats", "_quota")
    has = F.greatest(F.lit(1).cast("long"), F.col("_votes"))
    q = F.least(F.col("_quota"), most * F.col("mix_blocks"))
    first = F.pmod(F.xxhash64(F.lit(seed), "_source", "mix_shard"), F.col("mix_blocks"))
    plan = (
        quotas.withColumn("mix_blocks", has)
        .withColumn("mix_rounds", F.floor(q / F.col("mix_blocks")))
        .withColumn("mix_rest", q % F.col("mix_blocks"))
        .withColumn("mix_first", first)
        .select(*own, "mix_blocks", "mix_rounds", "mix_rest", "mix_first")
    )
    plan = cut_lineage(parts.select("_source", "_fine", "mix_shard").join(plan, ["_source", "mix_shard"]))
    joined = dealt.join(plan, ["_source", "_fine"])
    line = Window.partitionBy("_source", "mix_shard").orderBy("_order", "_key", "size")
    start = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    begun = joined.withColumn("mix_start", start).withColumn("_b", F.lit(block).cast("long"))
    extra = chosen_before(F.col("mix_start") + F.col("size")) - chosen_before(F.col("mix_start"))
    taken = (F.col("mix_rounds") * F.col("size") + extra).cast("long")
    return begun.withColumn("taken", taken)


def mix(
    docs: DataFrame, seed: int = 7, block: int = BLOCK, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3),
    text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None,
) -> DataFrame:
    """`keep` columns (the key unless given) plus size, source_size, target and taken.

    Sources in code-point order (null last) weigh `weights`, repeating. No document is taken
    more than `most` times.
    """
    keep = [c for c in ([key] if keep is None else keep) if c not in ADDED]
    return placed(docs, seed, block, most, weights, text, source, key, keep).select(*unpacked(keep), *ADDED)


def mixed_documents(
    docs: DataFrame, seed: int = 7, block: int = BLOCK, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3),
    text: str = "text", source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: whole rounds are whole copies of a text, the
    extra blocks a last row with just their words (white space before a word goes with it).

    n_chars, where it is there, is the length of the new text.
    """
    names = docs.columns
    mixed = placed(docs, seed, block, most, weights, text, source, key, names)
    extra = F.col("taken") - F.col("mix_rounds") * F.col("size")
    copies = F.col("mix_rounds") + (extra > 0).cast("long")
    rows = mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    body = field(names, text)
    words = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    inside = lambda w, i: chosen_before(F.col("mix_start") + i + 1) > chosen_before(F.col("mix_start") + i)
    whole = (F.col("_copy") <= F.col("mix_rounds")) | (extra == F.col("size"))
    new = F.when(whole, body).otherwise(F.array_join(F.filter(words, inside), ""))
    return rows.select(*unpacked(names, **with_length(names, new, text, docs)))
