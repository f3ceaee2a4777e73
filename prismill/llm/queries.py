"""The queries of the subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismill.session import pin_runtime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(lambda table: pin_runtime(spark).read.parquet(f"{folder}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return build

    return add


LINE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM docs),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT k.*, coalesce(k.doc_id > o.first, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def line_dedup(table):
    """Shared lines of all documents, kept once."""
    from prismill.llm.line_dedup import dedup_lines

    kept = dedup_lines(table("documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op5_source_mix")
def source_mix(table):
    """All documents mixed to the weights 5, 2, 1."""
    from prismill.llm.mixing import mix

    mixed = mix(table("documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


@query("op6_linked_credentials")
def linked_credentials(table):
    """Secrets of all documents, with the weak parts that complete each other."""
    from prismill.llm.credentials import find_credentials, written

    found = find_credentials(table("documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
often AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
held AS (SELECT doc_id, s FROM shingles SEMI JOIN often USING (s)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, v FROM reach JOIN links ON seen = u)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN sizes ON node = sizes.doc_id GROUP BY node
"""


@query("op1_ngram_join", JACCARD_SQL)
def ngram_join(table):
    """Components of near-duplicate documents."""
    from prismill.llm.ngram_join import near_duplicates

    return near_duplicates(table("documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


TOXIC_AT = 0.3


@query("op2_toxicity")
def toxicity(table):
    """Toxicity of all documents, learned from the labelled ones that are not held out."""
    from prismill.llm.toxicity import fit_on_tables, held_out, score_toxicity

    docs = table("documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_on_tables(docs, table("labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "evidence")


@query("op9_robust_outliers")
def robust_outliers(table):
    """Quality rules over all documents, by language and source."""
    from prismill.llm.outliers import reject_outliers

    return reject_outliers(table("documents").select("doc_id", "text", "lang", "source"))


@query("op8_lexical_packing")
def lexical_packing(table):
    """All documents in windows of 4096 tokens."""
    import public_tokenizers

    from prismill.llm.packing import pack

    pieces = pack(table("documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_weak_quality")
def weak_quality(table):
    """Quality of all documents from overlapping heuristics."""
    from prismill.llm.weak_quality import score_quality

    return score_quality(table("documents").select("doc_id", "text"))


@query("op7_chunk_dedup")
def chunk_dedup(table):
    """The documents with passages that another one has as well, what they lose and which documents keep it."""
    from prismill.llm.chunk_dedup import shared_passages

    found = shared_passages(table("documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return found.select("doc_id", "n_shared", "n_dropped", spans.alias("spans"), "holders")


@query("op10_vector_graph")
def vector_graph(table):
    """Near-duplicate vectors of the whole table."""
    from prismill.llm.vector_graph import near_vectors

    return near_vectors(table("embeddings").select("vec_id", "embedding"))


NEGATIVES_SQL = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives(table):
    """Hard negatives for each positive of the anchors among all vectors."""
    from prismill.llm.hard_negatives import mine_negatives

    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).alias("label")
    return mine_negatives(table("embeddings").select("vec_id", label, "embedding"), F.pmod("vec_id", F.lit(50)) == 0)


WARC_SQL = r"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM hashed)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""


@query("op12_warc_members", WARC_SQL)
def warc_members(table):
    """All pages as WARC records: written as one stream per file, normalised to members, read back by their index."""
    import uuid

    from prismill.llm.warc import normalise, page_of, read_index, read_records, write_archives
    from prismill.session import shared_folder

    pages = table("pages").select("page_id", "url", "html")
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = normalise(write_archives(pages, f"{folder}/whole"), f"{folder}/members")
    found = read_records(read_index(archives), with_payload=False)
    return found.select(page_of("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))


AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT k) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, term, coalesce(c, 0) AS c FROM groups g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang, source) AS v,
  sum(c) OVER (PARTITION BY lang, term) AS cl, sum(c) OVER (PARTITION BY lang) AS nl FROM grid),
shares AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v)::HUGEINT)::BIGINT AS p, (1 + (1000000000::HUGEINT * (cl + 2)) // (nl + 2 * v)::HUGEINT)::BIGINT AS q FROM sized),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, source, part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary")::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


@query("op13_source_audit", AUDIT_SQL)
def source_audit(table):
    """How far the sources of each language diverge, over all documents."""
    from prismill.llm.source_audit import audit_sources

    return audit_sources(table("documents").select("text", "lang", "source"))
