"""Operator 5: documents linked by the Jaccard likeness of their word shingles.

Every document becomes a sorted array of distinct 64-bit shingle hashes; documents with the same
array form one class, so copies are compared once. Links are found in passes over classes:

* Star pass. Classes that share two min-hashes within a size band make a bucket. Each class is compared
  with a few of the classes that stand for its buckets, the ones that agree with it in most min-hashes.
  This joins the bulk of a group of near copies with a linear number of comparisons.
* Further rounds. Classes that stand outside a large component are compared with some members of it
  that share a bucket in their own or an adjacent size band, a few for each class, until a round joins none.
  Without them a class that the star pass left over would meet every member in the tiles.
* Full pass. Two sets with J >= t share a shingle among the first ``n - ceil(t n) + 1`` of any
  common order, so each class is dealt to tiles (shingle, size band, block) by those shingles.
  Frequent shingles come last in the order. Tiles that hold one component only need no
  comparison; in the others, only classes of different components are compared. In a large tile
  the bitmaps are as wide as the sets ask for, and a pair leaves only the first large tile that it is
  in: each row carries the large tiles its class was in before. So what leaves the tiles is at most
  ``LARGE`` pairs for a row of a small tile, and of the large ones each pair once, if it is near the limit.

A comparison first bounds the overlap from above by the bit counts of two hashed bitmaps, then
intersects the sorted arrays. The full pass gives every component exactly, whatever was joined before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.graph import components
from plumbline.llm.shared import BROADCAST_IDS, bound_batches, discard, free_name, mix, scratch, shingle_sets, signed, texts_of

SHINGLE = 5
STARS = 16         # min-hashes per class in the star pass; two by two they make its buckets
ALIKE = 9          # min-hashes that agree where a pair is worth a comparison; it only steers the speed
GROUP = 16         # classes that make a component large
TRIES = 4          # classes that a class is compared with in the star pass, and those of a large component in a round
ROUNDS = 2         # further rounds at most; they only steer the speed
BLOCK = 512        # classes of one side of a tile
PAIRS = 50_000     # pairs of a tile whose bitmaps are held at once
LARGE = 32         # rows beyond which a tile is large
NARROW = 8         # 64-bit words of the bitmaps that are dealt to small tiles
HINTS = 131_072    # frequent shingles that the order knows of; they only steer the speed
CHUNK = 2_000_000  # shingles held at once while frequent ones are looked for

_SKETCH = ("kind int, doc_id long, text_hash long, class_id long, n_shingles long, stars array<long>, "
           "bitmap binary, narrow binary")


def class_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def band_of(n: int, percent: int) -> int:
    """Sizes that can link lie in the same or in adjacent bands."""
    return math.floor(math.log(n) / band_width(percent) + 1e-9) if n else -1


def band_width(percent: int) -> float:
    """Logarithm of the ratio of the sizes a band spans; nearly none where only equal sets link."""
    return max(math.log(100 / percent), 1e-9)


def bitmap_of(hashes: np.ndarray) -> bytes:
    """Parity bitmap, as wide as the next power of two above twice the size (``NARROW`` words at least)."""
    width = max(64 * NARROW, 1 << (2 * max(1, len(hashes)) - 1).bit_length())
    places = (mix(hashes) % np.uint64(width)).astype(np.int64)
    bits = (np.bincount(places, minlength=width) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Narrow a parity bitmap; the parities of the halves add up."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sketches(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd = (mix(np.arange(1, STARS + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
        held: dict[int, np.ndarray] = {}
        size = 0

        def frequent():
            values = np.sort(np.concatenate(list(held.values())))
            at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            counts = np.diff(at, append=len(values))
            at, counts = at[counts >= 3], counts[counts >= 3]
            n = len(at)
            none, nothing = pd.array([None] * n, "Int64"), pd.Series([None] * n, dtype=object)
            return pd.DataFrame({"kind": np.ones(n, np.int32), "doc_id": none, "text_hash": none, "class_id": signed(values[at]), "n_shingles": counts,
                                 "stars": nothing, "bitmap": nothing, "narrow": nothing})

        for batch in batches:
            rows = []
            for doc_id, digest, h in zip(batch["doc_id"], batch["text_hash"],
                                         shingle_sets(batch["text"].tolist(), SHINGLE)):
                c = class_of(h)
                stars = (h * odd).min(axis=1).view(np.int64) if len(h) else []
                bits = bitmap_of(h)
                rows.append((0, doc_id, digest, c, len(h), stars, bits,
                             fold(np.frombuffer(bits, np.uint64), NARROW).tobytes()))
                if len(h) and c not in held:
                    held[c] = h
                    size += len(h)
                if size >= CHUNK:
                    yield frequent()
                    held, size = {}, 0
            out = pd.DataFrame(rows, columns=["kind", "doc_id", "text_hash", "class_id", "n_shingles",
                                              "stars", "bitmap", "narrow"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        if held:
            yield frequent()

    return run


def _prefixes(percent: int, hints: np.ndarray, ranks: np.ndarray):
    """Rows (shingle, class_id, place) of the leading shingles, rare ones first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set[int] = set()
            parts, size = [], 0
            for h in shingle_sets(batch["text"].tolist(), SHINGLE):
                if not len(h) or (c := class_of(h)) in seen:
                    continue
                seen.add(c)
                p = prefix_length(len(h), percent)
                if len(hints):
                    at = np.minimum(np.searchsorted(hints, h), len(hints) - 1)
                    hot = hints[at] == h
                    if hot.any():
                        late = h[hot][np.argsort(ranks[at[hot]], kind="stable")]
                        h = np.concatenate([h[~hot], late])[: p] if p > (~hot).sum() else h[~hot]
                parts.append((h[:p], c))
                size += p
                if size >= 200_000:
                    yield _rows(parts)
                    parts, size = [], 0
            if parts:
                yield _rows(parts)

    def _rows(parts):
        lengths = [len(h) for h, _ in parts]
        return pd.DataFrame({
            "shingle": signed(np.concatenate([h for h, _ in parts])),
            "class_id": np.repeat(np.array([c for _, c in parts], np.int64), lengths),
            "place": np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]),
        })

    return run


def _bound_pairs(percent: int):
    """Keep pairs whose bit counts leave enough overlap possible."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [bound_allows(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, percent)
                    for x, y, n, m in zip(batch["bits_a"], batch["bits_b"], batch["n_a"], batch["n_b"])]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def bound_allows(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int) -> bool:
    """The symmetric difference has at least as many members as the bitmaps' differing bits."""
    words = min(len(x), len(y))
    differing = int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())
    most = min(n, m, (n + m - differing) // 2)
    return 100 * most >= percent * (n + m - most)


def _tile_pairs(percent: int):
    """Pairs of one tile that differ in component and that size and bit counts allow.

    Rows come sorted by tile; a tile has at most two blocks of each of two size bands. In the tile
    of the first shingle two classes have in common, all else they share comes after it: with
    ``place`` shingles before it, n - place bounds the overlap. Pairs that this excludes are left
    out of a tile; a pair that links is never excluded from that first one. A pair that several
    small tiles of a batch hold is looked at once.
    """
    keys = ["shingle", "band", "block_a", "block_b"]

    def pairs(batch: pd.DataFrame, starts: np.ndarray, ends: np.ndarray):
        n, comp, ids, high, block, place = (batch[c].to_numpy(np.int64) for c in (
            "n_shingles", "component", "class_id", "high", "block", "place"))
        rest = n - place
        apart = (batch["block_a"] != batch["block_b"]).to_numpy()
        large = batch["large"].to_numpy(bool)
        left, right, held = [], [], 0

        def possible(i, j, s):
            ok = (comp[i] != comp[j]) & (high[i] + high[j] < 2)
            if apart[s]:
                ok &= block[i] != block[j]
            ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            return ok & ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (n[i] + n[j]))

        for s, e in zip(starts, ends):
            if large[s]:
                # Row by row, so that the pairs of one tile are never held together.
                parts, waiting = [], 0
                for k in range(s, e - 1):
                    j = np.arange(k + 1, e)
                    j = j[possible(np.full(len(j), k), j, s)]
                    parts.append((np.full(len(j), k), j))
                    waiting += len(j)
                    if waiting > PAIRS or k == e - 2:
                        if waiting:
                            yield first_time(batch, ids, n, *map(np.concatenate, zip(*parts)))
                        parts, waiting = [], 0
                continue
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
            ok = possible(i, j, s)
            left.append(i[ok])
            right.append(j[ok])
            held += len(left[-1])
            if held > PAIRS:
                yield bounded(batch, ids, n, np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        if held:
            yield bounded(batch, ids, n, np.concatenate(left), np.concatenate(right))

    def bounded(batch, ids, n, i, j):
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((ids[j], ids[i]))
        i, j = i[order], j[order]
        new = np.concatenate([[True], (ids[i[1:]] != ids[i[:-1]]) | (ids[j[1:]] != ids[j[:-1]])])
        i, j = i[new], j[new]
        keep = np.flatnonzero(near(batch, n, i, j, NARROW))
        return pd.DataFrame({"a": ids[i[keep]], "b": ids[j[keep]]})

    def near(batch, n, i, j, words):
        """Whether the bit counts of the bitmaps, folded to ``words``, leave enough overlap."""
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        bits = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in batch["bits"].iloc[used]])
        x, y = back[:len(i)], back[len(i):]
        step = max(1, PAIRS * NARROW // words)
        differing = np.concatenate([
            np.bitwise_count(bits[x[k:k + step]] ^ bits[y[k:k + step]]).sum(axis=1, dtype=np.int64)
            for k in range(0, len(x), step)])
        most = np.minimum(np.minimum(n[i], n[j]), (n[i] + n[j] - differing) // 2)
        return 100 * most >= percent * (n[i] + n[j] - most)

    def first_time(batch, ids, n, i, j):
        """Pairs of one large tile by its full bitmaps, without those that met in a large tile before."""
        words = min(len(x) for x in batch["bits"].iloc[np.unique(np.concatenate([i, j]))]) // 8
        keep = near(batch, n, i, j, words)
        i, j = i[keep], j[keep]
        before = {k: set(batch["earlier"].iat[k]) for k in set(i.tolist()) | set(j.tolist())}
        new = np.array([before[p].isdisjoint(before[q]) for p, q in zip(i.tolist(), j.tolist())], bool)
        i, j = i[new], j[new]
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in batches:
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            if not len(batch):
                continue
            k = batch[keys].to_numpy(np.int64)
            starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1])
            yield from pairs(batch, starts[:-1], starts[1:])
            carry = batch.iloc[starts[-1]:].reset_index(drop=True)
        if carry is not None:
            yield from pairs(carry, np.array([0]), np.array([len(carry)]))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = list(shingle_sets(batch["text"].tolist(), SHINGLE))
        yield pd.DataFrame({"class_id": [class_of(s) for s in sets], "members": [s.tobytes() for s in sets]})


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, n_shingles, class_id, component, component_id`` for every row of ``df``.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over distinct 5-word shingles;
    ``component_id`` is the least id reachable by links, ``class_id`` marks equal sets
    and ``component`` is the least class of a component.

    A NULL or empty text, or one without words, has an empty set and links with nothing: its
    component is its own id. Rows without an id get the component of their class, NULL if no
    row of the component has an id. Rows that repeat an id are compared each on their own.
    Any further column of ``df`` is ignored. An empty table gives an empty table.
    """
    bound_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch(base.withColumn("text_hash", F.xxhash64("text")).mapInPandas(_sketches(percent), _SKETCH), "sketch")
    docs = scratch(sketch.filter("kind = 0").select("doc_id", "text_hash", "class_id", "n_shingles"), "docs")
    classes = scratch(
        sketch.filter("kind = 0 AND n_shingles > 0").groupBy("class_id").agg(
            F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n_shingles"),
            F.first("stars").alias("stars"), F.first("bitmap").alias("bitmap"),
            F.first("narrow").alias("narrow")), "classes")
    hints = _order_hints(sketch)
    discard(sketch)
    sizes = classes.select("class_id", "n_shingles", "bitmap")

    star_links = _verify(base, classes, sizes, _star_pairs(classes, percent), percent)
    placed = _placed(classes, star_links)
    for turn in range(ROUNDS):
        pairs = _pairs_with_large(classes, placed, percent, turn)
        if pairs is None:
            break
        more = _verify(base, classes, sizes, pairs, percent)
        if more.isEmpty():
            break
        star_links = star_links.unionByName(more)
        placed = _placed(classes, star_links)
    known = classes.select("class_id", "n_shingles", "narrow").join(placed, "class_id")

    rows = scratch(base.mapInPandas(_prefixes(percent, *hints), "shingle long, class_id long, place int"), "prefixes")
    pairs = _contested_pairs(rows, known, sizes, percent)
    all_links = star_links.unionByName(_verify(base, classes, sizes, pairs, percent))
    final = components(all_links)

    member = scratch(docs.join(final, docs.class_id == final.node, "left").select(
        "doc_id", "text_hash", "class_id", "n_shingles", F.coalesce("component", "class_id").alias("component")), "members")
    least = member.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (member.join(least, "component", "left")
            .select("doc_id", "text_hash", "n_shingles", "class_id", "component",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the least id
    (rows without an id come last, ties go by a hash of the text) and of repeated rows one.
    Texts without words are no duplicates and all stay."""
    found = scratch(ngram_jaccard_join(df, id_col, text_col, percent), "joined")
    keys = ["doc_id", "text_hash"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("first")
    least = found.filter("n_shingles > 0").groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    counts = found.filter("n_shingles > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    match = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    kept = scratch(least.join(counts, match(least, counts)).select(least["doc_id"], least["text_hash"], "rows"), "kept")
    wordless = found.filter("n_shingles = 0").select(*keys).distinct().withColumn("rows", F.lit(1).cast("long"))
    id_name, hash_name = free_name(df, "_id"), free_name(df, "_hash")
    kept = scratch(kept.unionByName(wordless).select(
        F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name), F.col("rows").alias("n")), "kept")
    listed = lambda part: kept.filter(part).select(id_name, hash_name)
    on = F.col(id_col).cast("long").eqNullSafe(F.col(id_name)) & (F.xxhash64(text_col) == F.col(hash_name))

    def rows_of(part: DataFrame) -> DataFrame:
        part = F.broadcast(part) if part.count() <= BROADCAST_IDS else part
        return df.join(part, on, "left_semi")

    single = rows_of(listed("n = 1"))
    several = listed("n > 1")
    if several.isEmpty():
        return single
    # Rows that share id and text: one of them whole, the least if their types have an order.
    row = F.struct(*df.columns)
    one = F.first(row) if any("map<" in f.dataType.simpleString() for f in df.schema) else F.min(row)
    folded = rows_of(several).groupBy(F.col(id_col).alias(id_name), F.xxhash64(text_col).alias(hash_name)).agg(
        one.alias("row")).select("row.*")
    return single.unionByName(folded)


def _order_hints(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HINTS`` frequent shingles, sorted, with their rank from rare to frequent."""
    top = (sketch.filter("kind = 1").groupBy(F.col("class_id").alias("shingle"))
           .agg(F.sum("n_shingles").alias("seen")).filter("seen >= 8")
           .orderBy(F.desc("seen"), "shingle").limit(HINTS).select("shingle").toArrow())
    values = top["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    ranks = np.arange(len(values))[::-1].copy()
    order = np.argsort(values)
    return values[order], ranks[order]


def _placed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``class_id, component`` of every class."""
    reached = components(links)
    return scratch(classes.select("class_id").join(reached, classes.class_id == reached.node, "left").select(
        "class_id", F.coalesce("component", "class_id").alias("component")), "placed")


def _band(percent: int):
    return F.floor(F.log(F.col("n_shingles").cast("double")) / band_width(percent) + 1e-9)


def _couples(band):
    """The buckets of a class in a size band: two min-hashes each."""
    return F.array(*[F.xxhash64(F.lit(j), F.col("stars")[2 * j], F.col("stars")[2 * j + 1], band) for j in range(STARS // 2)])


def _dealt(classes: DataFrame, buckets) -> DataFrame:
    """``bucket, class_id, digest``: the digest has a byte made of each min-hash."""
    return classes.select(F.explode(buckets).alias("bucket"), "class_id", F.transform("stars", lambda x: (x % 127).cast("tinyint")).alias("digest"))


def _most_alike(met: DataFrame, *keys: str) -> DataFrame:
    """Pairs (a, b) of each class with the ``TRIES`` heads that agree with it in most min-hashes, ``ALIKE`` at least."""
    agree = F.size(F.filter(F.zip_with("digest", "head.digest", lambda x, y: x == y), lambda same: same))
    tried = met.withColumn("agree", agree).filter(F.col("agree") >= ALIKE).groupBy("class_id", *keys).agg(F.collect_set(F.struct(
        (-F.col("agree")).alias("by"), F.col("head.class_id").alias("head"))).alias("heads"))
    return tried.select("class_id", F.explode(F.slice(F.sort_array("heads"), 1, TRIES).getField("head")).alias("head")).select(
        F.least("class_id", "head").alias("a"), F.greatest("class_id", "head").alias("b")).distinct()


def _pairs_with_large(classes: DataFrame, placed: DataFrame, percent: int, turn: int) -> DataFrame | None:
    """Each class with up to ``TRIES`` members of the largest component in its buckets, if that is another one.

    None where no component is large. Every turn takes other members.
    """
    large = placed.groupBy("component").count().filter(F.col("count") >= GROUP).select("component")
    members = scratch(placed.join(large, "component", "left_semi"), "large")
    if members.isEmpty():
        return None
    band = _band(percent)
    dealt = _dealt(classes, F.concat(_couples(band), _couples(band - 1)))
    chosen = [F.min(F.struct(F.xxhash64(F.lit(4 * turn + k), F.col("class_id")), "class_id", "digest")).alias(f"m{k}")
              for k in range(4)]
    led = dealt.join(members, "class_id").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), *chosen)
    led = led.groupBy("bucket").agg(F.max(F.struct(
        "n", "component", F.array_distinct(F.array(*[F.struct(f"m{k}.class_id", f"m{k}.digest") for k in range(4)])).alias("heads"))).alias("most"))
    led = led.select("bucket", F.col("most.component").alias("other"), F.col("most.heads").alias("heads"))
    met = dealt.join(led, "bucket").join(placed, "class_id").filter("component <> other").select(
        "class_id", "other", "digest", F.explode("heads").alias("head"))
    return _most_alike(met, "other")


def _star_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Each class with the most alike of the classes that stand for its buckets, up to three for each bucket.

    A bucket is a size band and two min-hashes, so that a passage which many texts share rarely
    makes one. The three are the least and the greatest class and the least by another hash.
    """
    dealt = _dealt(classes, _couples(_band(percent)))
    heads = dealt.groupBy("bucket").agg(
        F.min(F.struct("class_id", "digest")).alias("least"), F.max(F.struct("class_id", "digest")).alias("greatest"),
        F.min(F.struct(F.xxhash64("class_id"), "class_id", "digest")).alias("third")).filter("least.class_id < greatest.class_id").select(
        "bucket", F.array_distinct(F.array("least", "greatest", F.struct("third.class_id", "third.digest"))).alias("heads"))
    return _most_alike(dealt.join(heads, "bucket").select("class_id", "digest", F.explode("heads").alias("head")).filter(
        "class_id <> head.class_id"))


def _contested_pairs(rows: DataFrame, known: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes from tiles that hold more than one component, by bit counts."""
    shared = rows.groupBy("shingle").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter(
        "lo < hi").select("shingle")
    kept = rows.join(shared, "shingle").distinct()
    placed = scratch(kept.join(known, "class_id").select(
        "shingle", "class_id", "place", "n_shingles", "component", _band(percent).alias("own")), "placed")
    discard(rows)
    # A tile (shingle, band) holds its own band, and the next one up for comparison with it.
    dealt = placed.select("shingle", "class_id", "place", "n_shingles", "component", F.explode(F.array(
        F.struct(F.col("own").alias("band"), F.lit(0).alias("high")),
        F.struct((F.col("own") - 1).alias("band"), F.lit(1).alias("high")))).alias("t")).select(
        "shingle", "class_id", "place", "n_shingles", "component", "t.band", "t.high")
    mixed = dealt.groupBy("shingle", "band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("high").alias("low_side"),
        F.count(F.lit(1)).alias("rows")).filter("lo < hi AND low_side = 0").select(
        "shingle", "band", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), (F.col("rows") > LARGE).alias("large"))
    tiles = scratch(dealt.join(mixed, ["shingle", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")), "tiles")
    discard(placed)
    # The tile of a pair in a band is the same for both, so the earlier ones of that band tell whether they met.
    along = Window.partitionBy("class_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    large = tiles.filter("large").withColumn("earlier", F.collect_list("shingle").over(along))
    small = tiles.filter("NOT large").withColumn("earlier", F.array().cast("array<long>"))
    signed_rows = [rows.join(sigs.withColumnRenamed(bits, "bits"), "class_id") for rows, sigs, bits in (
        (small, known.select("class_id", "narrow"), "narrow"), (large, sizes.select("class_id", "bitmap"), "bitmap"))]
    ready = signed_rows[0].unionByName(signed_rows[1]).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "shingle", "band", "class_id", "place", "n_shingles", "component", "high", "block", "large", "earlier", "bits",
        F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"))
    keys = ["shingle", "band", "block_a", "block_b"]
    dealt_out = ready.repartition(*keys).sortWithinPartitions(*keys)
    return dealt_out.mapInPandas(_tile_pairs(percent), "a long, b long").distinct()


def _verify(base: DataFrame, classes: DataFrame, sizes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that link: bounded by full bitmaps, then by the arrays of one text of each class."""
    a = sizes.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bitmap").alias("bits_a"))
    b = sizes.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bitmap").alias("bits_b"))
    pairs = scratch(pairs.join(a, "a").join(b, "b").filter(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").mapInPandas(
        _bound_pairs(percent), "a long, b long"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    sets = scratch(texts_of(base, classes.select("class_id", "doc_id", "text_hash").join(wanted, "class_id", "left_semi")).mapInPandas(
        _sets, "class_id long, members binary"), "sets")
    a = sets.select(F.col("class_id").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("class_id").alias("b"), F.col("members").alias("set_b"))
    linked = scratch(pairs.join(a, "a").join(b, "b").mapInPandas(_verified(percent), "a long, b long"), "linked")
    discard(sets, pairs)
    return linked
