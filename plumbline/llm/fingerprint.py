"""Operator 3: document fingerprints as bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` smallest distinct hashes of a text's 5-word shingles. Fingerprints of
parts merge into that of the whole; two of them estimate resemblance and containment, one alone
the number of distinct shingles. Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch

SHINGLE = 5
K = 64
RANGES = 64  # parts of the id order; each holds its share of ids, found from the ids themselves


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty array for NULL or no words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trimmed = F.regexp_replace(lowered, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def sketch_of(text: Column, k: int = K) -> Column:
    """Sorted array of the ``k`` smallest distinct shingle hashes; a text of fewer than five words
    is one shingle, a text without words has none."""
    words = words_of(text)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def rolled(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))
        runs = F.transform(F.slice(h, F.lit(1), F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(
            x, *[F.get(h, i + j) for j in range(1, SHINGLE)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            F.size(h) < SHINGLE, whole).otherwise(F.slice(F.sort_array(F.array_distinct(runs)), 1, k))

    # Bound once by a one-element transform, so that the words are not hashed for every use.
    return F.transform(F.array(hashes), rolled)[0]


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the smallest ``k`` hashes of both that are in each; 1 for two empty fingerprints."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common.cast("double") / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than ``k``."""
    top = F.element_at(a, -1).cast("double") + F.lit(float(1 << 63))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << 64)) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; 1 for an empty a."""
    union = distinct_shingles(merge(a, b, k), k)
    inside = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), inside))


def to_text(a: Column) -> Column:
    """Fixed-width hexadecimal digits of the hashes, one after the other."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def merge_by(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One fingerprint per key of the fingerprints of its parts, folded before the shuffle.

    Hashes are ranked within salted parts of a key first, so a key with very many parts is not
    gathered as a whole; NULL keys are a key of their own.
    """
    hashes = df.select(F.col(key).alias("key"), F.explode(sketch).alias("hash")).distinct()
    for salt in (F.pmod(F.col("hash"), F.lit(RANGES)), F.lit(0)):
        ranked = Window.partitionBy("key", salt).orderBy("hash")
        hashes = hashes.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank")
    return hashes.groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias(sketch)).select(
        F.col("key").alias(key), sketch)


def next_ids(ids: DataFrame) -> DataFrame:
    """``id, next_id`` over distinct ids in ascending order; after the last comes the first.

    The order is cut into ranges of ids; each takes its last follower from the least id of the
    next range that is not empty.
    """
    n = ids.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = scratch(ids.repartitionByRange(max(RANGES, int(n)), "id").withColumn("part", F.spark_partition_id()), "ranges")
    heads = dealt.groupBy("part").agg(F.min("id").alias("head"))
    ordered = Window.orderBy("part")  # one row per range
    heads = heads.withColumn("after", F.lead("head").over(ordered)).withColumn(
        "after", F.coalesce("after", F.first("head").over(ordered)))
    within = Window.partitionBy("part").orderBy("id")
    return dealt.join(heads.select("part", "after"), "part").select(
        "id", F.coalesce(F.lead("id").over(within), "after").alias("next_id"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``doc_id, n_chars, sketch, n_distinct`` for every row of ``df``; NULL texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
                     sketch_of(text, k).alias("sketch")).withColumn("n_distinct", distinct_shingles(F.col("sketch"), k))


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry=None) -> DataFrame:
    """``doc_id, text, edited, next_id, carried``: each text with its last half replaced by the next document's beginning.

    The last floor(n/2) code points give way to the first as many (or all) of the document with
    the next higher id; the one after the last is the first. NULL texts count as empty. Rows that
    repeat an id stand as one document in the order, with the least of their texts; each of
    them is edited. Rows without an id come before all others. ``carried`` is ``carry`` of the next
    document's text, worked out where that text is, so that only its beginning travels.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = scratch(docs.groupBy("id").agg(F.max(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("rows")), "sizes")
    known = sizes.filter("id IS NOT NULL")
    links = next_ids(known.select("id"))
    nulls = sizes.filter("id IS NULL").select("id", F.lit(0).alias("one"))
    first = known.agg(F.min("id").alias("next_id"))
    last = known.agg(F.max("id").alias("top"))
    if not nulls.isEmpty():
        # The documents without an id stand before the first id, and after the last one.
        links = links.join(F.broadcast(last), links.id == last.top, "left").select(
            "id", F.when(F.col("top").isNotNull(), F.lit(None)).otherwise(F.col("next_id")).alias("next_id"))
        links = links.unionByName(nulls.crossJoin(first).select("id", "next_id"))
    links = scratch(links.join(sizes, links.id.eqNullSafe(sizes.id)).select(
        links.id, "next_id", F.floor(F.col("n_chars") / 2).cast("int").alias("half")), "next")
    repeated = not sizes.filter("rows > 1").isEmpty()
    given = docs.groupBy("id").agg(F.min("text").alias("text")) if repeated else docs
    heads = links.join(given, links.next_id.eqNullSafe(given.id)).select(
        links.id.alias("of"), "next_id", F.expr("substring(text, 1, half)").alias("head"),
        (carry(F.col("text")) if carry else F.lit(None).cast("string")).alias("carried"))
    half = F.floor(F.length("text") / 2).cast("int")
    return docs.join(heads, docs.id.eqNullSafe(heads.of)).select(
        F.col("id").alias("doc_id"), "text", F.concat(
            F.substring(F.col("text"), F.lit(1), F.length("text") - half),
            F.substring(F.col("head"), F.lit(1), half)).alias("edited"), "next_id", "carried")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, also to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_distinct. See ``edited_texts`` for NULLs, ties and repeated rows.
    """
    text = edited_texts(df, id_col, text_col, lambda t: sketch_of(t, k))
    both = text.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch_of(F.col("text"), k).alias("sketch"), sketch_of(F.col("edited"), k).alias("edited_sketch"),
        F.col("carried").alias("next_sketch"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_distinct"))
