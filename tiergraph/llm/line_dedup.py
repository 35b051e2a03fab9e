"""Fuzzy line deduplication with DataFrame functions only.

A line's character shingles are the sequences of up to ``shingle`` characters of
the lower-cased line that begin where a word begins, and at every character of a
script that is written without spaces.  Lines with few word starts also have the
shingles of ``shingle`` characters at every place; those decide where one of two
lines has too few word starts.  Their hashes, sorted, are
the line's MinHash order; the signature is the ``bottom`` least.  A band is a
pair of hashes that are neighbours in that signature, so that one character
shingle more or less shifts no other band.  With ``bottom`` 8 and Jaccard
similarity 0.8 a pair of long lines shares a band with probability 0.985, with 0.9 with
0.9995.  Lines that share a band with a line of about their size are paired with the least
line of the band and with their neighbour by size, verified by the exact Jaccard similarity of their
whole shingle sets, and the verified links go through a distributed union-find.
Then all pairs of a band that are still in different components are judged,
block by block.  Sizes, and bitmaps of the sets, bound from above how many shingles two
lines share; what these bounds exclude can't be similar and becomes no row.  So every pair that shares a
band is judged, and a passage within many otherwise different lines makes few pairs.
One line of each component stays: the first by (document, position).

Equal shingle sets are one line from the start, so copies never meet in a band.
A line with too few word starts is not similar to one with twice
``min_shingles`` of them or more.

Defined results: null and empty texts have no lines to remove; lines without a
letter or digit stay; lines with fewer than ``min_shingles`` distinct shingles of
either kind (below 16 characters with the defaults) are compared
whole, but for case, and copies of them go; a line
repeated in one document stays once; rows with equal id and text are one
document and get equal results; null ids count as one id; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.components import components
from tiergraph.plans.shared import dropped, release, where_once, written

BLOCK = 256  # lines of a band that are compared in one row
WORDS = 8  # of 64 bits in a bitmap
ASCII = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han; and all others beyond ASCII.
DENSE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
SPACED = r"\x80-\u0DFF\u0F00-\u0FFF\u10A0-\u177F\u1800-\u303F\u3100-\u33FF\uA000-\uF8FF\uFB00-\x{1FFFF}\x{40000}-\x{10FFFF}"


def shingles(line: Column, shingle: int) -> Column:
    """Sorted distinct hashes of the character shingles of a line.

    A word is a run of ASCII letters and digits and of all other characters beyond ASCII."""
    # Each match looks ahead for a shingle and then takes the rest of its word. Plain
    # ranges, as classes by category cost a third more here. ASCII is a class of its own without
    # ranges, which is one lookup, and dots in a row cost less than a counted one: two thirds of the time.
    found = rf"[[{ASCII}]\x80-\x{{10FFFF}}](?:{'.' * (shingle - 1)}|.*)"
    return _hashed(line, rf"(?=({found}))(?:[[{ASCII}][{SPACED}]]+|[{DENSE}])")


def every_shingle(line: Column, shingle: int) -> Column:
    """The same of all runs of ``shingle`` characters, wherever they begin."""
    return _hashed(line, rf"(?=(.{{{shingle}}}))")


def _hashed(line: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of one id may have different texts: the text's hash tells them apart."""
    r = F.xxhash64(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), r.alias("_r"), F.col(text_col).alias("_t"), F.xxhash64(F.col(id_col), r).alias("_d"))


def _occurrences(docs: DataFrame, shingle: int, bottom: int, min_shingles: int) -> DataFrame:
    lines = docs.select("_id", "_r", F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
    lines = _sets(lines.where(F.col("_line").rlike(r"[\p{L}\p{N}]")), shingle, min_shingles, "_id", "_r", "_pos")
    judged = (F.size("_s") >= min_shingles) | (F.size("_e") >= min_shingles)
    # The upper halves keep the order and are enough for a band.
    least = lambda c: F.when(judged, F.transform(F.slice(c, 1, bottom), lambda h: F.shiftright(h, 32).cast("int"))).otherwise(F.array().cast("array<int>"))
    key = F.when(judged, F.xxhash64("_s", "_e")).otherwise(F.xxhash64(F.lower("_line"), F.lit(1)))
    return lines.select("_id", "_r", "_pos", key.alias("_k"), least("_s").alias("_sig"), least("_e").alias("_esig"), F.size("_s").alias("_n"))


def _sets(lines: DataFrame, shingle: int, min_shingles: int, *keys: str) -> DataFrame:
    """``_s``: shingles at word starts; ``_e``: at every place, where these are few."""
    lines = lines.select(*keys, "_line", shingles(F.col("_line"), shingle).alias("_s"))
    every = F.when(F.size("_s") < 2 * min_shingles, every_shingle(F.col("_line"), shingle)).otherwise(F.array().cast("array<bigint>"))
    return lines.select(*keys, "_line", "_s", every.alias("_e"))


def _band_array() -> Column:
    def bands(c: str, *kind) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.xxhash64(F.get(c, i - 1), F.get(c, i), *kind))
        return F.when(F.size(c) > 1, pairs).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(bands("_sig"), bands("_esig", F.lit(1))))


def _bands(lines: DataFrame, *columns: str) -> DataFrame:
    return lines.select("_k", *columns, F.explode(_band_array()).alias("_band"))


def _sized(a: str, b: str, threshold: float, min_shingles: int) -> str:
    """Whether sets of a and b shingles can be similar.  Where both have few word
    starts the other shingles may decide, of which this doesn't know the number."""
    return f"(greatest({a}, {b}) < {2 * min_shingles} or least({a}, {b}) >= {threshold} * greatest({a}, {b}) - 1e-9)"


def _met(lines: DataFrame, threshold: float, min_shingles: int) -> DataFrame:
    """(_k, _with): the lines that share a band with one they can be similar to by size, once
    for each band, with the least line of the band and the next smaller one where these can be."""
    band = "partition by _band"
    near = lambda x: _sized("_n", x, threshold, min_shingles)
    order = f"over ({band} order by _n, _k)"
    rows = _bands(lines, "_n").selectExpr("_band", "_k", "_n", f"lag(_k) {order} as _pk", f"lag(_n) {order} as _pn", f"lead(_n) {order} as _next")
    # Most bands have one line; the second window finds the rest in order.
    rows = rows.where("_pk is not null or _next is not null").selectExpr("*", f"min(struct(_k, _n)) over ({band}) as _least")
    # The neighbours by size are the likeliest to be near enough.
    rows = rows.where(f"(_pk is not null and {near('_pn')}) or (_next is not null and {near('_next')})")
    found = f"array(if({near('_least._n')}, _least._k, null), if({near('_pn')}, _pk, null))"
    return rows.selectExpr("_k", f"array_distinct(filter({found}, x -> x <> _k)) as _with")


def _bitmap(c: str) -> Column:
    """The shingles of ``c`` hashed to 64 * WORDS bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 8).bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.aggregate(F.filter(c, lambda h: h.bitwiseAND(F.lit(WORDS - 1)) == i), F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h)))
    return F.struct(*[word(i).alias(f"w{i}") for i in range(WORDS)])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, min_shingles: int) -> DataFrame:
    """The pairs whose exact similarity is at least ``threshold``."""
    side = lambda x: sets.select(F.col("_k").alias(f"_{x}"), F.col("_s").alias(f"_s{x}"), F.col("_e").alias(f"_e{x}"))
    both = pairs.join(side("a"), "_a").join(side("b"), "_b")

    def alike(x: str, y: str) -> Column:
        return (1 + threshold) * F.size(F.array_intersect(x, y)) >= threshold * (F.size(x) + F.size(y)) - 1e-9

    long = F.least(F.size("_sa"), F.size("_sb")) >= min_shingles
    similar = F.when(long, alike("_sa", "_sb")).otherwise((F.least(F.size("_ea"), F.size("_eb")) > 0) & alike("_ea", "_eb"))
    return both.where(similar).select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def _open_rows(lines: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """(_band, _k, _n, _g, _main): the lines of each band that is in several
    components, with the largest of these."""
    known = sets.select("_k").join(parts.withColumnRenamed("node", "_k"), "_k", "left").select("_k", F.coalesce("component", "_k").alias("_g"))
    rows = _bands(lines.join(known, "_k"), "_n", "_g")
    each = rows.groupBy("_band", "_g").agg(F.count("*").alias("_c"))
    bands = each.groupBy("_band").agg(F.max_by("_g", F.struct("_c", "_g")).alias("_main"), F.count("*").alias("_parts"))
    return rows.join(bands.where("_parts > 1").drop("_parts"), "_band")


def _open_pairs(rows: DataFrame, sets: DataFrame, threshold: float, min_shingles: int) -> DataFrame:
    """(_a, _b), once each: lines that share a band, are not in one component, and may be similar by
    their sizes and bitmaps.  The lines of a band fall into classes by size and these into blocks;
    a class meets itself and the next one, two blocks within the largest component do not meet."""
    # A little wider than the similarity allows; lines with few word starts are one class.
    step = F.log(F.lit(1.00001 / threshold))
    rows = rows.withColumns({"_class": F.floor(F.log(F.greatest("_n", F.lit(2 * min_shingles - 1))) / step).cast("int"), "_out": F.col("_g") != F.col("_main")})
    key = ["_band", "_class", "_out"]
    cuts = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("_cuts")).where("_cuts > 1")
    rows = rows.join(cuts, key, "left").withColumn("_cut", F.pmod(F.xxhash64("_k"), F.coalesce("_cuts", F.lit(1))))
    # Each line meets its bitmaps once, whatever the number of its bands.
    by_line = rows.groupBy("_k").agg(F.min("_g").alias("_g"), F.min("_class").alias("_class"), F.collect_list(F.struct("_band", "_out", "_cut")).alias("_at"))
    rows = by_line.join(sets.select("_k", "_n", "_m", "_sb", "_eb"), "_k").withColumn("_bands", F.col("_at._band"))
    rows = rows.select("_class", F.struct("_k", "_n", "_m", "_g", "_sb", "_eb", "_bands").alias("_row"), F.explode("_at").alias("_at")).select("_at.*", "_class", "_row")
    blocks = rows.groupBy(*key, "_cut").agg(F.collect_list("_row").alias("_in"))
    one, two = blocks.where("_out").alias("x"), blocks.alias("y")
    met = one.join(two, F.expr("x._band = y._band and abs(x._class - y._class) <= 1 and (not y._out or (x._class, x._cut) <= (y._class, y._cut))"))
    # Dealt out again, so that the blocks of one band are compared in many tasks.
    met = met.selectExpr("x._band as _band", "x._class as _cx", "y._class as _cy", "x._cut as _bx", "y._cut as _by", "y._out as _out", "x._in as _x", "y._in as _y").repartition("_band", "_cx", "_cy", "_bx", "_by", "_out")

    def close(n: str, bits: str) -> str:
        only = lambda x, y, words=WORDS: " - ".join([f"{x}.{n}", *[f"bit_count({x}.{bits}.w{i} & ~{y}.{bits}.w{i})" for i in range(words)]])
        enough = lambda most: f"(1 + {threshold}) * ({most}) >= {threshold} * (a.{n} + b.{n}) - 1e-9"
        # A quarter of the bits bounds from above too, and excludes most pairs at less cost.
        return f"({enough(f'least(a.{n}, b.{n})')} and {enough(only('a', 'b', WORDS // 4))} and {enough(only('a', 'b'))} and {enough(only('b', 'a'))})"

    near = f"a._g <> b._g and (a._k < b._k or not _out or _cx <> _cy or _bx <> _by) and if(least(a._n, b._n) >= {min_shingles}, {close('_n', '_sb')}, least(a._m, b._m) > 0 and {close('_m', '_eb')})"
    # Each pair comes from the least of its bands.
    near += " and array_min(array_intersect(a._bands, b._bands)) = _band"
    found = met.selectExpr(f"explode(flatten(transform(_x, a -> transform(filter(_y, b -> {near}), b -> struct(least(a._k, b._k) as _a, greatest(a._k, b._k) as _b))))) as _p")
    return found.select("_p.*")


def line_decisions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 12,
    bottom: int = 8,
    threshold: float = 0.8,
    min_shingles: int = 5,
) -> DataFrame:
    """(_id, _r, _removed): for each document that loses lines, their positions.
    ``_r`` is the hash of the text."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    occurrences = written(_occurrences(keyed, shingle, bottom, min_shingles), "lines")

    # Without copies: each distinct line with its first place.
    first = F.min(F.struct("_id", "_r", "_pos")).alias("_first")
    lines = written(occurrences.groupBy("_k").agg(first, F.min("_sig").alias("_sig"), F.min("_esig").alias("_esig"), F.min("_n").alias("_n")), "distinct")
    release(spark)

    met = written(_met(lines, threshold, min_shingles), "met")
    release(spark)

    # The whole shingle sets of all lines that a line of their band can be similar to, from their first places.
    places = lines.join(met.select("_k").distinct(), "_k").select(F.xxhash64("_first._id", "_first._r").alias("_d"), "_k", "_first._pos")
    places = places.groupBy("_d").agg(F.collect_list(F.struct("_pos", "_k")).alias("_at"))
    # Repeated rows meet in one partition; one of them is enough.
    texts = keyed.where("_t is not null").select("_d", "_t").join(places, "_d").groupBy("_d").agg(F.first("_t").alias("_t"), F.first("_at").alias("_at"))
    # Only the lines that are looked for go on, not all lines of the text with each of them.
    found = F.transform("_at", lambda at: F.struct(at["_k"].alias("_k"), F.get("_l", at["_pos"]).alias("_line")))
    sets = texts.select(F.split("_t", "\n").alias("_l"), "_at").select(F.explode(found).alias("_at")).select("_at.*")
    sets = _sets(sets, shingle, min_shingles, "_k").select("_k", "_s", "_e", F.size("_s").alias("_n"), F.size("_e").alias("_m"), _bitmap("_s").alias("_sb"), F.when(F.size("_e") > 0, _bitmap("_e")).alias("_eb"))
    sets = written(sets, "sets")
    release(spark)
    pairs = met.select(F.explode("_with").alias("_a"), F.col("_k").alias("_b")).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    links = written(_links(pairs, sets, threshold, min_shingles), "links")
    release(spark)

    # What is left: all pairs of a band whose lines are not in one component yet.
    parts = components(links)
    rows = written(_open_rows(lines, sets, parts), "open")
    release(spark)
    pairs = written(_open_pairs(rows, sets, threshold, min_shingles), "pairs")
    release(spark)
    more = written(_links(pairs, sets, threshold, min_shingles), "links")
    release(spark)
    for spent in (met, sets, rows, pairs):
        dropped(spent)
    if not more.isEmpty():
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    parts = parts.withColumnRenamed("node", "_k")
    grouped = lines.join(parts, "_k", "left").select("_k", "_first", F.coalesce("component", "_k").alias("_c"))
    linked = grouped.where("_c is not null").join(parts.select("component").distinct().withColumnRenamed("component", "_c"), "_c", "left_semi")
    keeper = linked.groupBy("_c").agg(F.min("_first").alias("_keep"))
    place = linked.join(keeper, "_c").select("_k", "_keep")
    # A line without links keeps its own first place.
    kept = lines.join(place, "_k", "left").select("_k", F.coalesce("_keep", "_first").alias("_keep"))
    gone = occurrences.select("_id", "_r", "_pos", "_k").join(kept, "_k")
    gone = gone.where(~F.struct("_id", "_r", "_pos").eqNullSafe(F.col("_keep")))
    removed = written(gone.groupBy("_id", "_r").agg(F.sort_array(F.collect_list("_pos")).alias("_removed")), "removed")
    dropped(occurrences)
    dropped(lines)
    release(spark)
    return removed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, **options) -> DataFrame:
    """The input rows, all their columns, with duplicate lines taken out of the
    text.  A document of which nothing is left goes unless ``drop_emptied`` is
    false; one that had no text stays as it was."""
    removed = line_decisions(docs, id_col, text_col, **options)
    removed = removed.select(F.col("_id").alias("_pid"), F.col("_r").alias("_pr"), "_removed")
    # The row goes along as one struct, so that no column of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_r"))
    joined = rows.join(removed, rows["_id"].eqNullSafe(removed["_pid"]) & (rows["_r"] == removed["_pr"]), "left")
    # The text goes through the join once.
    joined = joined.withColumn("_t", F.col(f"_row.`{text_col}`")).withColumn("_lines", F.split("_t", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    out = joined.withColumn("_left", F.when(F.col("_removed").isNull(), F.col("_t")).otherwise(left))
    if drop_emptied:
        out = where_once(out, F.col("_removed").isNull() | (F.btrim("_left", F.lit(" \t\n\x0b\f\r")) != ""))
    return out.select(*[F.col("_left").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = line_decisions(docs)
    n = docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.xxhash64("text").alias("_r"))
    removed = removed.withColumnRenamed("_id", "_pid").withColumnRenamed("_r", "_pr")
    out = n.join(removed, n["doc_id"].eqNullSafe(removed["_pid"]) & (n["_r"] == removed["_pr"]), "left")
    return out.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("_removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
