"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlog.functions.checkpoints import shared_folder, stored
from hushlog.llm.byte_cnn import fit, held_out, with_language
from hushlog.llm.chunk_bpe import with_decoded, with_token_ids
from hushlog.llm.feistel import with_pseudonyms
from hushlog.llm.fill_in_middle import with_fill_in_middle, with_restored
from hushlog.llm.hilbert_shards import hashed, scaled, with_shards
from hushlog.llm.kernel_quality import fit as fit_quality
from hushlog.llm.kernel_quality import with_quality, with_statistics
from hushlog.llm.license_scan import certainty, label_list, with_licenses
from hushlog.llm.positional_index import build_index, hit_words, search
from hushlog.llm.prefix_trie import numbered, prefix_trie, rebuilt
from hushlog.llm.quality_rules import MEASURES, with_measures, with_verdict
from hushlog.llm.shingle_join import similar_sets
from hushlog.llm.token_counts import with_token_counts
from hushlog.llm.token_files import token_file_ids


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir), width=3, per_cent=90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_measures(with_verdict(documents(spark, sf_dir).select("doc_id", "text")))
    kept = (F.col("kept") & ~F.col("base_failed")).alias("kept")
    return judged.select("doc_id", *MEASURES, "base_failed", kept)


#: Only for tables without real people; a real job passes a key of its own.
SAMPLE_KEY = b"a key for made-up documents only"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_pseudonyms(documents(spark, sf_dir).select("doc_id", "text"), SAMPLE_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("pii.kind"))), ",")
    return done.select(
        "doc_id", "text", F.size("pii").cast("long").alias("n_pii"), kinds.alias("kinds")
    )


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    net = fit(learned.select("text", "lang"))
    return with_language(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, found = F.col("base"), F.col("licenses")
    starts = F.transform(base, lambda d: d["start"])
    return with_licenses(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        label_list(base).alias("base_labels"),
        label_list(F.concat(base, found)).alias("labels"),
        certainty(base, found).alias("score"),
        F.size(found).cast("long").alias("n_licenses"),
    )


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of one source and language follow each other; a cut between shards may part them,
    since the law is ``rows``, and other sources or languages lie elsewhere on the curve."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    dims = [hashed(F.col("source")), hashed(F.col("lang")), scaled(F.col("size"))]
    sharded = with_shards(rows, dims, ["text_crc32", "size", "doc_id"], n_shards=24)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


BYTE_BPE = "byte_bpe_50k.json"


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    path = public_tokenizers.path(BYTE_BPE)
    read = token_file_ids(documents(spark, sf_dir), path, folder, end=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    encoded = with_token_ids(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    return with_decoded(encoded, path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(build_index(documents(spark, sf_dir)), "index")
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = hit_words(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(*rebuilt(numbered(turns)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return with_restored(done).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored")
    )


def op13_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = stored(with_statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "stats")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("doc_id").isNotNull() & ~apart)
    labels = labels.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    model = fit_quality(docs.join(labels, "doc_id").select("stats", "label"))
    return with_quality(docs, model).select(
        "doc_id",
        F.coalesce(apart, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


_QUERIES = [
    op1_token_counts,
    op2_pseudonyms,
    op3_byte_cnn,
    op4_license_scan,
    op5_hilbert_shards,
    op6_token_files,
    op7_shingle_join,
    op8_quality_rules,
    op9_chunk_bpe,
    op10_decontamination,
    op11_prefix_trie,
    op12_fill_in_middle,
    op13_kernel_quality,
    pipeline,
]

QUERIES = {query.__name__: query for query in _QUERIES}

QUALITY_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n
    FROM split, unnest(range(1, len(ws) - 3)) AS spot(i)),
steps AS (
    SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS step
    FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, sum(step) AS n FROM steps GROUP BY doc_id),
measured AS (
    SELECT doc_id, t, ws, ls, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM split LEFT JOIN repeats r USING (doc_id)),
failed AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed
        OR 100 * n_symbols > 20 * n_words
        OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\A[^\p{L}]*\p{Lu}{2,}[^\p{L}]*\z')))
            > 50 * n_words
        OR 100 * (length(t) - length(replace(t, '!', ''))) > 30 * n_words
        OR length(array_to_string(ls, '')) > 2 * length(array_to_string(list_distinct(ls), ''))
        OR word_chars < 2 * n_words OR word_chars > 30 * n_words
        OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\A[^\p{L}]*\z'))) > 50 * n_words
        OR len(ls) > 3 AND
            100 * len(list_filter(ls, lambda x: regexp_matches(x, '\A[ \t]*[-•*·][ \t]'))) > 90 * len(ls)
        OR len(ls) > 3 AND
            100 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*\z'))) > 50 * len(ls)
    ) AS kept
FROM failed
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
tests AS (
    SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS g
    FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS spot(i) WHERE len(ws) > 0),
places AS (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
    FROM docs, (SELECT DISTINCT n FROM tests), unnest(range(1, len(ws) - n + 2)) AS spot(i)),
found AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN tests USING (n, g)),
words AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS spot(k)
    GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

JOIN_SQL = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
    FROM docs, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS spot(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
same AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM same JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * same.n >= 90 * (x.n + y.n - same.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT doc_id, coalesce(s.n, 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes s USING (doc_id) GROUP BY doc_id, s.n
"""

TRIE_SQL = r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(printf('%016X', strlen(coalesce(role, ''))) || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
heads AS (
    SELECT c, n, c - c % 5 AS origin, xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
            lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END
        )) % 9 AS h
    FROM sizes),
convs AS (
    SELECT e.c, e.n, e.origin, e.h, least(e.h, coalesce(s.n, 0)) AS got
    FROM heads e LEFT JOIN sizes s ON s.c = e.origin),
whole AS (
    SELECT v.c, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.origin AND t.pos <= v.h
    UNION ALL
    SELECT v.c, v.got + t.pos - v.h, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
prefixes AS (
    SELECT c, pos AS d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY pos) AS k FROM whole
    UNION ALL SELECT c, 0, '', [] FROM convs),
nodes AS (
    SELECT d, k, min(c) AS top, count(*) AS n, (count(*) - 1) * strlen(any_value(text)) AS saved
    FROM prefixes GROUP BY d, k),
paths AS (SELECT c, d, top FROM prefixes JOIN nodes USING (d, k)),
kids AS (
    SELECT p.top, p.d, count(*) AS n FROM nodes u JOIN paths p ON p.c = u.top AND p.d = u.d - 1 GROUP BY ALL),
single AS (
    SELECT u.*, coalesce(k.n, 0) AS n_children FROM nodes u LEFT JOIN kids k ON k.top = u.top AND k.d = u.d),
sums AS (
    SELECT p.top, p.d, sum(u.saved) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
    FROM single u JOIN paths p ON p.c = u.top AND p.d <= u.d GROUP BY ALL),
ends AS (
    SELECT p.top, p.d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
    FROM paths p JOIN convs v USING (c) WHERE p.d = v.got + greatest(v.n - v.h, 0) GROUP BY ALL)
SELECT u.top AS conv_id, u.d AS depth, p.top AS parent_conv_id, u.n AS n_convs, u.n_children,
    s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM single u JOIN sums s ON s.top = u.top AND s.d = u.d
LEFT JOIN paths p ON p.c = u.top AND p.d = u.d - 1
LEFT JOIN ends e ON e.top = u.top AND e.d = u.d
"""

FILL_SQL = r"""
WITH draws AS (
    SELECT *, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us
    FROM documents),
spots AS (
    SELECT doc_id, coalesce(text, '') AS t, us, len(us) AS n,
        CAST('0x' || d[1:8] AS BIGINT) % (len(us) + 1) AS a,
        CAST('0x' || d[9:16] AS BIGINT) % (len(us) + 1) AS b,
        CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
    FROM draws),
pieces AS (
    SELECT doc_id, t, n, array_to_string(us[:least(a, b)], '') AS p,
        array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(us[greatest(a, b) + 1:], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
            THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM spots)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM pieces
"""

SQL: dict[str, str] = {
    "op7_shingle_join": JOIN_SQL,
    "op8_quality_rules": QUALITY_SQL,
    "op10_decontamination": DECONTAMINATION_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_fill_in_middle": FILL_SQL,
}
