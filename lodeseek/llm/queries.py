"""One query per operator of this subpackage over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.conversation_repair import conversation_digests, repaired_conversations, talk_key
from lodeseek.llm.ngram_join import ngram_jaccard_join
from lodeseek.llm.lattice_dedup import lattice_dedup
from lodeseek.llm.license_scan import license_scan
from lodeseek.llm.line_dedup import line_dedup
from lodeseek.llm.merge_dropout import decode, encode
from lodeseek.llm.nbsvm import held_out
from lodeseek.llm.packing import pack, token_pieces
from lodeseek.llm.phrases import collocations
from lodeseek.llm.quality import quality_model, quality_scores
from lodeseek.llm.spot_signatures import edited_fingerprints, fingerprint, likeness
from lodeseek.llm.substring_dedup import substring_dedup
from lodeseek.llm.toxicity import toxicity_model, toxicity_scores
from lodeseek.llm.vantage_trees import nearest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VANTAGE_FACTOR = 2.0  # see README for the recall it gives
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, folder, "documents"), width=5, percent=80)


# What lower-cases A-Z and cuts words as the operators do.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE cut AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM cut
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substring_dedup(table(spark, folder, "documents").select("doc_id", "text"), window=20)
    return cleaned.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op10_substring_dedup"] = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM cut WHERE len(w) >= 20)
),
later AS (
    SELECT doc_id, p FROM (
        SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM wins
    ) WHERE k > 1
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM cut),
marks AS (
    SELECT x.doc_id, x.p, x.word, max(l.p) OVER (PARTITION BY x.doc_id ORDER BY x.p) AS last
    FROM words x LEFT JOIN later l ON l.doc_id = x.doc_id AND l.p = x.p
),
kept AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE p - last < 20) AS gone,
        string_agg(word, ' ' ORDER BY p) FILTER (WHERE last IS NULL OR p - last >= 20) AS text
    FROM marks GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(table(spark, folder, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
    return pack(pieces, 1024).drop("ids")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where(~held_out("doc_id"))


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(docs, _known(spark, folder))
    return quality_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity_model(docs, _known(spark, folder))
    return toxicity_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup(table(spark, folder, "documents"), "source", "text", max_ratio=0.1)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op2_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents
),
pages AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS pages FROM documents GROUP BY source),
often AS (
    SELECT source, line FROM (
        SELECT source, line, count(DISTINCT text) AS n FROM split WHERE trim(line) <> '' GROUP BY source, line
    ) JOIN pages USING (source) WHERE n >= 2 AND n > 0.1 * pages
),
marked AS (
    SELECT s.doc_id, s.line, s.p, o.line IS NOT NULL AS gone
    FROM split s LEFT JOIN often o ON o.source = s.source AND o.line = s.line
)
SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_lines, coalesce(gone, 0)::INTEGER AS n_dropped,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS gone,
        string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone) AS kept
    FROM marked GROUP BY doc_id
) m ON m.doc_id = d.doc_id
"""


@query
def op9_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = edited_fingerprints(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


@query
def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=VANTAGE_FACTOR)


@query
def op4_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizers.path("piece_bpe_32k.model")
    encoded = encode(table(spark, folder, "documents"), path, dropout=0.1, seed=1)
    return decode(encoded, path).select(
        "doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as files: every tenth is the licence file of a directory of its source and language."""
    docs = table(spark, folder, "documents")
    place = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), (F.col("doc_id") / 1000).cast("long").cast("string")))
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(
        F.concat(F.lit("doc_"), "doc_id"))
    return docs.select("doc_id", F.concat(place, F.lit("/"), name).alias("path"), "text")


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan(document_files(spark, folder), threshold=0.8)
    return found.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("doc_id"), "path", "license", "basis", "score")


@query
def op13_lattice_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_dedup(table(spark, folder, "embeddings"), cosine=0.93)


ORACLE["op13_lattice_near_dedup"] = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) e
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id
"""


def damaged_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` with a fault in some rows, by a hash of conversation and turn."""
    rows = table(spark, folder, "conversations")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    reports, repaired = repaired_conversations(damaged_conversations(spark, folder))
    talk = talk_key(F.col("conv_id")).alias("talk")
    every = table(spark, folder, "conversations").select("conv_id", talk).distinct()
    found = every.join(reports.select(talk, *reports.columns[1:]), "talk", "left").join(
        conversation_digests(repaired), "talk", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)), lambda c, b: list_reduce(
    list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

ORACLE["op11_conversation_repair"] = rf"""
WITH RECURSIVE faulted AS (
    SELECT *, {_CRC32} % 20 AS f FROM (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
),
damaged AS (
    SELECT coalesce('c' || conv_id, 'n') AS talk, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS time
    FROM faulted WHERE f <> 0
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY talk ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
),
lines AS (
    SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
        row_number() OVER (PARTITION BY talk, role, text ORDER BY i) AS k,
        lag(left(role, 1)) OVER (PARTITION BY talk ORDER BY i) AS prior
    FROM numbered
),
counts AS (
    SELECT talk, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
        count(*) FILTER (WHERE NOT blank AND k > 1) AS duplicate, count(*) FILTER (WHERE NOT blank AND k = 1 AND cut) AS truncated,
        count(*) FILTER (WHERE prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM lines GROUP BY talk
),
gap(p, r, gc, gs, gl) AS (
    VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
        (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
        (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])
),
step(r, s, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
want(r, w, wq) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
moves AS (
    SELECT talk, i, r, r AS q, 3 AS mc, 'D' AS ms, []::VARCHAR[] AS ml FROM lines, want
    UNION ALL SELECT talk, i, r, q, cut::INTEGER, 'K', [role || ':' || text]
    FROM lines JOIN step ON s = ini WHERE NOT blank AND k = 1
    UNION ALL SELECT talk, i, r, wq, 2 + cut::INTEGER, 'R', [w || ':' || text] FROM lines, want WHERE NOT blank AND k = 1
),
paths AS (
    SELECT talk, 0::BIGINT AS i, 0 AS p, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS best FROM counts
    UNION ALL
    SELECT x.talk, x.i + 1, m.q, min({{'c': x.best.c + g.gc + m.mc, 'a': x.best.a || g.gs || m.ms,
        'l': list_concat(list_concat(x.best.l, g.gl), m.ml)}})
    FROM paths x JOIN gap g ON g.p = x.p JOIN moves m ON m.talk = x.talk AND m.i = x.i + 1 AND m.r = g.r
    GROUP BY x.talk, x.i, m.q
),
whole AS (
    SELECT x.talk, min({{'c': x.best.c + g.gc, 'a': x.best.a || g.gs, 'l': list_concat(x.best.l, g.gl)}}) AS best
    FROM paths x JOIN counts c ON c.talk = x.talk AND c.n = x.i JOIN gap g ON g.p = x.p AND g.r IN (0, 3) GROUP BY x.talk
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
    coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('c' || conv_id, 'n') AS talk FROM conversations) e
LEFT JOIN counts USING (talk) LEFT JOIN whole USING (talk)
"""


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), least=30, top=2000)


ORACLE["op12_phrase_collocations"] = r"""
WITH cut AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k)),
counted AS (SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE f >= 30),
cuts AS (SELECT lang, k, ws, f, unnest(range(1, k)) AS c FROM often WHERE k > 1),
scored AS (
    SELECT x.lang, x.k, x.ws, x.f AS a, c, l.f AS l, r.f AS r, (2000000::HUGEINT * x.f) // (l.f::HUGEINT + r.f) AS score
    FROM cuts x JOIN often l ON l.lang = x.lang AND l.k = c AND l.ws = x.ws[1:c]
    JOIN often r ON r.lang = x.lang AND r.k = x.k - c AND r.ws = x.ws[c + 1:x.k]
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, ws ORDER BY score, c) = 1),
inner_runs AS (
    SELECT lang, m, ws[i:i + m - 1] AS ws, max(f) AS longer FROM (
        SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM often, (SELECT unnest([2, 3]) AS m) WHERE m < k)
    GROUP BY ALL
),
apart AS (
    SELECT x.* FROM lowest x LEFT JOIN inner_runs y ON y.lang = x.lang AND y.m = x.k AND y.ws = x.ws
    WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank,
    array_to_string(ws, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM apart JOIN totals USING (lang) QUALIFY rank <= 2000
"""
