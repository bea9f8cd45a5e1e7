"""SimHash fingerprints, near-dedup by multi-index hashing, and block-table search.

A fingerprint bit is a vote of all term hashes. The votes are counted in packed
lanes: ``(h >>> k) & 0x0000000100000001`` carries bit k in its low half and bit
k + 32 in its high half, so 32 sums of longs count 64 bits, and each half has
room for 2^31 votes, more than any text has. Partial sums are made before the
shuffle, in generated code.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, cut, hex64, small, unused, whole, words
from .components import connected_components

LANES = 0x0000000100000001


def _shifted(bit: int) -> int:
    """2^bit as a signed long."""
    return (1 << bit) - (1 << 64) * (bit == 63)


def term_fingerprints(df: DataFrame, keys: list[str], word_array: str, shingle: int, bits: int = 64, weighted: bool = False) -> DataFrame:
    """``keys``, copies, fp0 (and fp1 ... for each further 64 bits): one row for each distinct value of ``keys``.

    Terms are runs of ``shingle`` words, repeats included; fewer words are one
    term; none: all bits are 0. A bit is 1 if terms of over half the weight
    have it. The weight of a term is 1, or its length if ``weighted``.
    ``copies`` is the number of rows with these keys, whose words must be alike.
    """
    n = F.size(word_array)
    d = df.select(*keys, word_array, F.explode(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))).alias("_i"))
    parts = [x for i in range(shingle) for x in ([F.lit(" ")] if i else []) + [F.get(F.col(word_array), F.col("_i") + i)]]
    term = F.when(n >= shingle, F.concat(*parts)).when(n > 0, F.concat_ws(" ", word_array))
    d = d.select(*keys, "_i", term.alias("_t"))
    weight = F.length("_t").cast("long") if weighted else F.when(F.col("_t").isNotNull(), F.lit(1).cast("long"))
    seeds = range(bits // 64)
    hashed = d.select(*keys, "_i", weight.alias("_w"), *[(F.xxhash64("_t") if s == 0 else F.xxhash64(F.lit(s), "_t")).alias(f"_h{s}") for s in seeds])

    def votes(s: int, k: int) -> Column:
        lane = F.shiftrightunsigned(f"_h{s}", k).bitwiseAND(F.lit(LANES))
        return F.sum(lane * F.col("_w") if weighted else F.when(F.col("_w").isNotNull(), lane)).alias(f"_v{s}_{k}")

    sums = hashed.groupBy(*keys).agg(
        F.sum((F.col("_i") == 0).cast("long")).alias("copies"), F.sum("_w").alias("_n"), *[votes(s, k) for s in seeds for k in range(32)]
    )

    def fingerprint(s: int) -> Column:
        out = []
        for k in range(32):
            v = F.col(f"_v{s}_{k}")
            for bit, count in ((k, v.bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(v, 32))):
                out.append(F.when(count * 2 > F.col("_n"), F.lit(_shifted(bit)).cast("long")).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), out).alias(f"fp{s}")

    return sums.select(*keys, "copies", *[fingerprint(s) for s in seeds])


def document_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, copies, fp): unweighted 64-bit fingerprints of the texts' word shingles."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(ascii_lower(whole("text")), BLANK).alias("w"))
    return term_fingerprints(d, ["doc_id", "text_hash"], "w", shingle).withColumnRenamed("fp0", "fp")


# --- multi-index hashing, radius 2 -----------------------------------------

SEGMENT, SEGMENTS, RADIUS = 32, 2, 2
#: Fingerprints of one segment value from which on that value is indexed further, and the parts of the other segment it is indexed by.
HOT, PARTS = 128, [(0, 11), (11, 11), (22, 10)]


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _key(s: int, value: Column) -> Column:
    """Segment values as keys of their tables; equal ones of different segments are apart."""
    return value.bitwiseOR(F.lit(s << SEGMENT))


def _split(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with sub: 0, or for a hot key a row for each part of the other segment, by the part's value."""
    part = [F.shiftrightunsigned(_segment(F.col("fp"), 1), lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in PARTS], [F.shiftrightunsigned(_segment(F.col("fp"), 0), lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in PARTS]
    other = [F.when(F.col("key") < F.lit(1 << SEGMENT), a).otherwise(b) for a, b in zip(*part, strict=True)]
    subs = F.array(*[v.bitwiseOR(F.lit((t + 1) << 16)) for t, v in enumerate(other)])
    none = F.array(F.lit(0).cast("long"))
    return rows.join(hot, "key", "left").withColumn("sub", F.explode(F.when(F.col("is_hot"), subs).otherwise(none))).drop("is_hot")


def candidates(fingerprints: DataFrame, hot_from: int = HOT) -> DataFrame:
    """(a, b, distance), a < b: what the segment tables have for the distinct values in the long column ``fp``, with whole distances.

    Of two values within RADIUS bits one segment differs in one bit at most. The
    table of a segment has each fingerprint under its value there; the lookups
    of a fingerprint are that value and its 32 one-bit neighbours. A pair may come
    from both tables. Values that ``hot_from`` fingerprints share are indexed
    under the parts of their other segment as well: it differs in two bits at
    most, so that one of its three parts is equal.
    """
    # So many partitions by number: each row makes 66 lookups, which isn't seen when small partitions are put together.
    partitions = max(8, int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prints = cut(fingerprints.select("fp").repartition(partitions, "fp").distinct())
    fp = F.col("fp")
    entries = prints.select("fp", F.explode(F.array(*[_key(s, _segment(fp, s)) for s in range(SEGMENTS)])).alias("key"))
    hot = small(cut(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= hot_from).select("key", F.lit(True).alias("is_hot"))), F.lit(24))
    ball = [_key(s, v) for s in range(SEGMENTS) for v in [_segment(fp, s), *[_segment(fp, s).bitwiseXOR(F.lit(1 << bit)) for bit in range(SEGMENT)]]]
    lookups = prints.select("fp", F.explode(F.array(*ball)).alias("key"))
    table = cut(_split(entries, hot)).select(F.col("fp").alias("a"), "key", "sub")
    met = _split(lookups, hot).withColumnRenamed("fp", "b").join(small(table, F.lit(32)), ["key", "sub"]).where("a < b")
    return met.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def near_links(fingerprints: DataFrame, hot_from: int = HOT) -> DataFrame:
    """(a, b): links between values in the long column ``fp`` that differ in at most 2 of 64 bits, which connect all that near pairs connect.

    Candidates are verified by their whole distance. The smaller values near a
    fingerprint (2080 at most) are gathered, and of those that are near one another only the
    least is linked: what is left out is connected by links of smaller values.
    """
    near = candidates(fingerprints, hot_from).where(F.col("distance") <= RADIUS).groupBy("b").agg(F.collect_set("a").alias("near"))
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    least = F.filter("near", lambda g: ~F.exists("near", lambda h: (h < g) & close(g, h)))
    return near.select("b", F.explode(least).alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id, root for each row of ``docs``; root tells components apart.

    component_id is the smallest doc_id that links of distance 2 or less lead
    to. Equal fingerprints are linked; so are all rows without words, null and
    empty texts among them (their fingerprint is 0). Null doc_ids take part, but
    are a component_id only where a component has no others. Repeated rows stay
    repeated; an empty table gives an empty one; other columns play no part.
    """
    prints = cut(document_fingerprints(docs, shingle))
    roots = connected_components(cut(near_links(prints)), "a", "b")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    by_print = cut(by_print.withColumn("root", F.coalesce("component", "fp")))
    # Most fingerprints are one row's own: those have no class to look up.
    many = by_print.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n")).where("n > 1").drop("n")
    classes = cut(by_print.select("fp", "root").join(many, "root"))
    rows = prints.join(small(classes, F.lit(48)), "fp", "left")
    rows = rows.withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("root", F.coalesce("root", "fp"))
    return rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "text_hash", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs``, all columns as they are, with one row of each component: that of the smallest doc_id (of several with it, of the smallest text hash).

    A row without a doc_id stays only in a component where none has one. Of rows
    that are repeated with doc_id and text one stays. Texts are fingerprinted
    whole; null and empty ones and those of blanks only are copies of one another.
    An empty table stays empty.
    """
    n = near_duplicates(docs.select("doc_id", "text"), shingle).groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    n = cut(n)
    keep = n.groupBy("root").agg(F.min(first).alias("k"))
    marked = n.join(keep, "root")
    key, h = unused(docs, "key"), unused(docs, "hash")
    gone = marked.where(~first.eqNullSafe(F.col("k"))).select("doc_id", "text_hash")
    repeated = marked.where(first.eqNullSafe(F.col("k")) & (F.col("copies") > 1)).select("doc_id", "text_hash")
    named = lambda d: d.select(F.col("doc_id").alias(key), F.col("text_hash").alias(h))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))
    left = docs.join(small(cut(named(gone.unionByName(repeated))), F.lit(48)), same, "left_anti")
    repeated = cut(named(repeated))
    if repeated.isEmpty():
        return left
    once = docs.join(small(repeated, F.lit(48)), same).dropDuplicates([key, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.unionByName(once)


def query_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


# --- permuted block tables --------------------------------------------------


def block_table_pairs(fingerprints: DataFrame, columns: list[str], radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance): pairs of different fingerprints within ``radius``; a and b are structs of ``columns`` (64 bits each).

    The bits are cut into ``blocks`` blocks; ``radius`` differing bits touch
    ``radius`` blocks at most, so two such fingerprints agree in all the other
    blocks: there is a table for each choice of blocks - radius blocks, sorted by
    these, and every table is searched by equality. Spark takes a table of
    entries for as small as the fingerprints it is exploded from, so that it
    would broadcast one of many times its limit; the join is told to sort both.
    """
    total = 64 * len(columns)
    edges = [round(total * i / blocks) for i in range(blocks + 1)]

    def masks(chosen: tuple[int, ...]) -> list[int]:
        bits = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        out = [(bits >> (64 * i)) & ((1 << 64) - 1) for i in range(len(columns))]
        return [m - (1 << 64) if m >> 63 else m for m in out]

    tables = list(combinations(range(blocks), blocks - radius))
    fps = fingerprints.select(*columns).distinct().select(F.struct(*columns).alias("fp"))
    key = [F.xxhash64(F.lit(t), *[F.col(f"fp.{c}").bitwiseAND(F.lit(m).cast("long")) for c, m in zip(columns, masks(chosen), strict=True)]) for t, chosen in enumerate(tables)]
    entries = fps.select("fp", F.posexplode(F.array(*key)).alias("t", "key"))
    left, right = entries.select(F.col("fp").alias("a"), "key", "t"), entries.select(F.col("fp").alias("b"), "key")
    differing = {c: F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in columns}
    distance = reduce(lambda x, y: x + y, [F.bit_count(x) for x in differing.values()])
    met = left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & (distance <= radius))
    # A pair may meet in several tables: the first of them counts, so that no pair is sent on to be compared.
    alike = [reduce(lambda x, y: x & y, [differing[c].bitwiseAND(F.lit(m).cast("long")) == 0 for c, m in zip(columns, masks(chosen), strict=True)]) for chosen in tables]
    first = F.coalesce(*[F.when(x, t) for t, x in enumerate(alike)])
    return met.where(first == F.col("t")).select("a", "b", distance.alias("distance"))
