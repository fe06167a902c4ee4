"""The registered queries of the text operators, over whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.conversation_trie import prefix_trie, shared_openings, turn_chains
from plumbline.llm.curve_shards import hilbert_shards
from plumbline.llm.decontaminate import find_contamination
from plumbline.llm.fingerprint import fingerprint_edits
from plumbline.llm.language import identify_language
from plumbline.llm.mixing import mix_sources
from plumbline.llm.near_join import ngram_jaccard_join
from plumbline.llm.passages import repeated_passages
from plumbline.llm.pseudonyms import pseudonymize_documents
from plumbline.llm.quotations import as_mail, reply_ordered
from plumbline.llm.resampling import resample_towards
from plumbline.llm.secret_scan import scan_secrets
from plumbline.llm.shared import read_table
from plumbline.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and the least document reachable by links."""
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify_language(read_table(spark, sf_dir, "documents"))


@query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the benchmark items of which they hold a passage."""
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.filter("contaminated").drop("contaminated")


@query()
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the rules' findings, and all findings."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    place = "concat_ws(':', f.kind, cast(f.start as string), cast(f.end as string))"
    base = "filter(findings, f -> f.kind <> 'network')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as bigint)").alias(f"n_{k}")
          for k in ("assign", "access", "hex")],
        F.expr(f"sha2(concat_ws(',', transform({base}, f -> {place})), 256)").alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(findings, f -> {place}))").alias("spans"),
        F.expr("cast(size(filter(findings, f -> f.kind = 'network')) as bigint)").alias("n_network"))


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query()
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability and whether it is drawn."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
                        F.col("mix_probability").alias("probability"), F.col("mix_sampled").alias("sampled"))


@query()
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


@query()
def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data."""
    return pseudonymize_documents(read_table(spark, sf_dir, "documents"), key="example key of the test tables").withColumn(
        "n_found", F.size("found").cast("long"))


@query()
def op10_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail with nested quotations, put back into reply order without them."""
    return reply_ordered(as_mail(read_table(spark, sf_dir, "conversations")))


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents hold too."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))


_TRIE = """
WITH turns AS (
    SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
           length(coalesce(text, '')) AS len, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({'d': digest, 'l': len} ORDER BY turn NULLS FIRST, digest) AS ts FROM turns GROUP BY conv_id),
bytes AS (
    SELECT *, list_transform(range(length(cast(conv_id AS varchar))),
        lambda i: ascii(substr(cast(conv_id AS varchar), i + 1, 1))) AS bs FROM own),
tab AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM (SELECT unnest(range(256)) AS i))),
opened AS (
    SELECT conv_id, ts, conv_id - conv_id % 100 AS opener, xor(list_reduce(bs,
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h FROM bytes, tab),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts
    FROM opened o LEFT JOIN own b ON b.conv_id = o.opener),
steps AS (
    SELECT conv_id, len(ts) AS total, unnest(range(len(ts) + 1)) AS depth, ts FROM rebuilt),
members AS (
    SELECT conv_id, depth, total, array_to_string(list_transform(ts[1:depth], lambda t: t.d), '') AS key,
           CASE WHEN depth > 0 THEN array_to_string(list_transform(ts[1:depth - 1], lambda t: t.d), '') END AS above,
           CASE WHEN depth > 0 THEN ts[depth].l ELSE 0 END AS len FROM steps),
nodes AS (
    SELECT key, depth, any_value(above) AS above, any_value(len) AS len, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CASE WHEN total = depth THEN cast(conv_id AS varchar) END, ',' ORDER BY conv_id), '')) AS ends
    FROM members GROUP BY key, depth),
kids AS (SELECT above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
tree AS (
    SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
sums AS (
    SELECT a.key, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.len) AS saved
    FROM tree u JOIN members m ON m.conv_id = u.conv_id AND m.depth <= u.depth JOIN tree a ON a.key = m.key GROUP BY a.key)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, cast(s.n_leaves AS bigint) AS n_leaves,
       cast(s.saved AS bigint) AS saved_tokens, t.ends AS ends_sha256
FROM tree t JOIN sums s USING (key) LEFT JOIN nodes p ON p.key = t.above
"""


@query(_TRIE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the conversations, each opened by some turns of the first one of its hundred.

    The remainder of a negative id is negative, as in SQL."""
    conv = F.col("conv_id")
    chains = shared_openings(turn_chains(read_table(spark, sf_dir, "conversations")), conv - conv % 100,
                             F.crc32(conv.cast("string").cast("binary")) % 6)
    return prefix_trie(chains).drop("node", "parent")


_RESAMPLE = """
WITH tab AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM (SELECT unnest(range(256)) AS i))),
texts AS (
    SELECT row_number() OVER () AS r, doc_id, text FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark),
worded AS (
    SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
runs AS (
    SELECT r, array_to_string(ws[i:i + k - 1], ' ') AS f FROM (
        SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded), (SELECT unnest([1, 2, 3]) AS k)
    WHERE i + k - 1 <= len(ws)),
counted AS (SELECT r, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
    SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))),
        lambda i: cast('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counted), tab),
bucketed AS (SELECT r, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
per_bucket AS (
    SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM bucketed GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM per_bucket),
weights AS (SELECT r, sum(n * gain) AS weight, sum(n) AS n_features FROM bucketed JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
scored AS (
    SELECT d.r, d.doc_id, len(d.ws) AS n_words, cast(coalesce(w.n_features, 0) AS bigint) AS n_features,
        cast(coalesce(w.weight, 0) AS bigint) AS weight, cast(coalesce(w.weight, 0) + floor(-1000 * ln(-ln(
            (cast('0x' || substr(sha256('42:' || coalesce(cast(d.doc_id AS varchar), '')), 1, 8) AS bigint) + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS bigint) AS score
    FROM worded d LEFT JOIN weights w USING (r) WHERE d.r > 0),
ranked AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k.rank <= 5 * k.n // 100 THEN k.rank END AS rank
FROM scored s LEFT JOIN ranked k USING (r)
"""


@query(_RESAMPLE)
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts, and the five in a hundred that are drawn."""
    return resample_towards(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_words")


_CRC_TABLE = """WITH tab AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM (SELECT unnest(range(256)) AS i))), """
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce({0}, ''))), '..'), lambda h: cast('0x' || h AS bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""


def _curve_sql(dimensions: list[str], bits: int, shards: int) -> str:
    """The shards in SQL: cells by rank, a step of the curve for each bit and dimension, runs of equal rows."""
    x = [f"x{i}" for i in range(len(dimensions))]
    cells = ", ".join(f"cast(floor((rank() OVER (ORDER BY {d} NULLS FIRST) - 1) * {1 << bits} / count(*) OVER ()) AS bigint) AS {n}"
                      for d, n in zip(dimensions, x))
    steps = [f"""WITH s0 AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_CRC.format('text')} AS text_crc32, {cells}
        FROM documents, tab)"""]
    for b in range(bits - 1, 0, -1):
        for i, n in enumerate(x):
            p = (1 << b) - 1
            swap = f"CASE WHEN {n} & {1 << b} <> 0 THEN 0 ELSE xor(x0, {n}) & {p} END"
            first = f"CASE WHEN {n} & {1 << b} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {swap}) END"
            new = [f"{first} AS x0"] + [f"xor({n}, {swap}) AS {n}" if k == i else v for k, v in enumerate(x) if k]
            steps.append(f"s{len(steps)} AS (SELECT doc_id, size, text_crc32, {', '.join(new)} FROM s{len(steps) - 1})")
    gray = [x[0]]
    for n in x[1:]:
        gray.append(f"xor({n}, {gray[-1]})")
    steps.append(f"g AS (SELECT doc_id, size, text_crc32, {', '.join(f'{e} AS {n}' for e, n in zip(gray, x))} FROM s{len(steps) - 1})")
    turn = "0"
    for b in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN {x[-1]} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"t AS (SELECT *, {turn} AS turn FROM g)")
    places = [f"((xor({n}, turn) >> {b}) & 1) * {1 << (b * len(x) + len(x) - 1 - i)}" for b in range(bits) for i, n in enumerate(x)]
    steps.append(f"c AS (SELECT doc_id, size, text_crc32, {' + '.join(places)} AS curve FROM t)")
    steps.append("p AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS LAST) - 1 AS place, count(*) OVER () AS n FROM c)")
    steps.append(f"h AS (SELECT *, cast(place * {shards} // n AS integer) AS shard FROM p)")
    return _CRC_TABLE + ", ".join(steps).replace("WITH s0", "s0", 1) + """
        SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot,
               cast(NULL AS integer) AS grown_shard FROM h"""


CURVE_DIMENSIONS = ["lang", "source", "n_chars"]


@query(_curve_sql(CURVE_DIMENSIONS, 8, 16))
def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards along a Hilbert curve over language, source and length."""
    text = F.coalesce("text", F.lit(""))
    sized = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *CURVE_DIMENSIONS)
    return hilbert_shards(sized, CURVE_DIMENSIONS, ties=["text_crc32", "doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
