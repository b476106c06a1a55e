"""The queries of this subpackage, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import chat, collocations, merkle, near_dup, packing, pieces, quality, records, rules, topk, toxicity, urls, vector_dup
from pagemill.llm.common import fold, table

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: A conversation that holds the template's own control strings.
CONTROL_TALK = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", mod=4, held_out=2)
    out = quality.score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_url_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op3_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE, end_id=2, length=1024)


def op5_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), PIECES, keep_ids=False)


def op6_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(F.col("`doc.doc_id`").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", mod=5, held_out=0)
    out = toxicity.score(docs, model, ["doc_id"])
    doc_id = F.col("`doc.doc_id`")
    return out.select(doc_id.alias("doc_id"), (fold(doc_id, 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(row, ("long", "long", "string", "string"), turns.columns))) for row in CONTROL_TALK))))
    return chat.read_back(chat.expand(turns.unionByName(more)))


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), BPE, end_id=0)


def op10_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op11_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.links(table(spark, sf_dir, "embeddings"), cosine=0.98)


def tampered() -> dict:
    """What the manifest is checked against: texts of a fifth of the documents lose their capitals."""
    return {"changed": fold(F.col("doc_id"), 5) == 0, "change": {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}}


def op12_superblock_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), **tampered())


def op13_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_attention_quality, op2_url_digest, op3_vector_approximation, op4_best_two_fit, op5_chunk_pieces, op6_adaptive_rules, op7_toxic_spans, op8_prefix_targets, op9_binary_records, op10_bag_min_hash, op11_sorted_projections, op12_superblock_manifest, op13_pivot_collocations)}
_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BEST = "(SELECT {} FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1)"
_ESCAPED = r"replace(regexp_replace({}, '[\\#]', '\\\0', 'g'), '</', '<\/')"
_WORD = r"[^\x20\x09-\x0D]"
_MEASURES = ("1000 * n_symbols // greatest(n_words, 1)", "1000 * n_dup_lines // greatest(n_lines, 1)", "1000 * n_repeat_words // greatest(n_words, 1)", "1000 * word_chars // greatest(n_words, 1)")
_MARGINS = [(up, 1 << 40 if down is None else down) for _, up, down in rules.MEASURES.values()]
_BUCKET = f"greatest(length(bin(val)) - 1 - {rules.SKETCH_BITS}, 0)"
#: The unsigned crc32 of doc_id in decimal, byte by byte and bit by bit.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)] || list_transform(range(8), lambda k: -1))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295), 4294967295)"


def _tree_sql(name: str, nodes: str, height: int) -> tuple[str, str]:
    """CTEs of a tree over nodes (g, i, h), and the expression of the siblings' names: level k has each node's
    run as a list (m) and its place there (p)."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM {nodes})"]
    for k in range(height):
        ctes.append(f"{name}r{k} AS MATERIALIZED (SELECT g, i // 16 AS i, list(h ORDER BY i) AS m, any_value(c) AS c FROM {name}{k} GROUP BY g, i // 16)")
        ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i, CASE WHEN c = 1 THEN m[1] ELSE sha256(array_to_string(m, '')) END AS h, CASE WHEN c = 1 THEN 1 ELSE (c + 15) // 16 END AS c FROM {name}r{k})")
    return ", ".join(ctes), f"{name}{height}"


def _manifest_sql(low: int = 5, high: int = 3) -> str:
    """SQL of op12 for tables of up to 16^low documents a source and 16^high sources."""
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + field + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sources, subroots = _tree_sql("a", "l", low)
    tops, root = _tree_sql("b", "t", high)
    # Each document's way up: its place at level k of either tree, and the node folded so far.
    steps, at = [], "SELECT l.*, t.i AS gi, '' AS proof, u AS node FROM l JOIN t ON t.name IS NOT DISTINCT FROM l.g"
    for tree, key, place, height in (("a", "g", "i", low), ("b", "0", "gi", high)):
        for k in range(height):
            run, p = f"{tree}r{k}", f"(x.{place} // {16**k}) % 16"
            steps.append(f"w{tree}{k} AS (SELECT x.* REPLACE (CASE WHEN r.c = 1 THEN x.proof ELSE x.proof || array_to_string(r.m[:{p}], '') || array_to_string(r.m[{p} + 2:], '') END AS proof, CASE WHEN r.c = 1 THEN x.node ELSE sha256(array_to_string(r.m[:{p}], '') || x.node || array_to_string(r.m[{p} + 2:], '')) END AS node) FROM ({at}) x JOIN {run} r ON r.i = x.{place} // {16 ** (k + 1)} AND r.g IS NOT DISTINCT FROM {'x.g' if key == 'g' else '0'})")
            at = f"SELECT * FROM w{tree}{k}"
    return (
        f"WITH d AS MATERIALIZED (SELECT doc_id, source AS g, {leaf.format('text')} AS h, {leaf.format(lower)} AS low FROM documents), "
        f"l AS MATERIALIZED (SELECT doc_id, g, h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, CASE WHEN {_CRC} % 5 = 0 THEN low ELSE h END AS u FROM d), "
        f"{sources}, t AS MATERIALIZED (SELECT 0 AS g, g AS name, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM {subroots}), {tops}, {', '.join(steps)} "
        f"SELECT doc_id, x.h AS leaf, t.h AS subroot, z.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = z.h AS verified FROM ({at}) x JOIN t ON t.name IS NOT DISTINCT FROM x.g, {root} z"
    )


_PHRASES = (
    "WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents), p AS (SELECT lang, unnest(ps) AS piece FROM d), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p), "
    "g AS (" + " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: ws[i:i + {k - 1}])) AS ws FROM w WHERE len(ws) >= {k}" for k in (1, 2, 3)) + "), f AS MATERIALIZED (SELECT lang, ws, count(*) AS a FROM g GROUP BY lang, ws), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(ws) = 1 GROUP BY lang), "
    f"c AS MATERIALIZED (SELECT * FROM f WHERE len(ws) > 1 AND a >= {collocations.MIN_COUNT}), o AS (SELECT lang, ws, max(a) AS a FROM (SELECT lang, a, unnest([ws[1:2], ws[2:3]]) AS ws FROM c WHERE len(ws) = 3) GROUP BY lang, ws), "
    f"k AS (SELECT c.* FROM c LEFT JOIN o USING (lang, ws) WHERE o.a IS NULL OR 100 * o.a < {collocations.INSIDE_PERCENT} * c.a), "
    f"t AS (SELECT k.lang, k.ws, k.a, cut, l.a AS l, r.a AS r, CAST(CAST({collocations.SCALE} AS HUGEINT) * k.a * k.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, len(ws))) AS cut FROM k) k JOIN f l ON l.lang = k.lang AND l.ws = k.ws[:cut] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[cut + 1:]), "
    "b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1) "
    f"SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}"
)
ORACLES: dict[str, str] = {
    "op6_adaptive_rules": f"WITH t AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS x FROM documents), w AS MATERIALIZED (SELECT *, regexp_extract_all(x, '{_WORD}+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM t), "
    "g AS (SELECT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS win, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3), r AS (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, win) > 1), c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY id), "
    "m AS MATERIALIZED (SELECT w.id, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (id)), "
    f"v AS (SELECT id, lang, source, unnest([0, 1, 2, 3]) AS k, unnest([{', '.join(_MEASURES)}]) AS val FROM m), e AS (SELECT *, val >> CAST({_BUCKET} AS INT) << CAST({_BUCKET} AS INT) AS b FROM v), "
    "f AS (SELECT level, CASE WHEN level < 2 THEN lang END AS l, CASE WHEN level < 1 THEN source END AS s, k, b FROM e, (SELECT unnest([0, 1, 2]) AS level)), o AS (SELECT *, row_number() OVER (PARTITION BY level, l, s, k ORDER BY b) AS rn, count(*) OVER (PARTITION BY level, l, s, k) AS n FROM f), "
    "q AS (SELECT level, l, s, k, any_value(n) AS n, min(b) FILTER (WHERE rn * 100 >= n * 25) AS q1, min(b) FILTER (WHERE rn * 100 >= n * 75) AS q3 FROM o GROUP BY level, l, s, k), "
    f"z AS (SELECT level, l, s, k, n, q3 + {rules.FENCE} * (q3 - q1) + [{', '.join(str(u) for u, _ in _MARGINS)}][k + 1] AS hi, q1 - {rules.FENCE} * (q3 - q1) - [{', '.join(str(d) for _, d in _MARGINS)}][k + 1] AS lo FROM q), "
    f"j AS (SELECT e.id, e.val, z.* FROM e JOIN z ON z.k = e.k AND ((level = 0 AND l IS NOT DISTINCT FROM lang AND s IS NOT DISTINCT FROM source AND n >= {rules.MIN_ROWS}) OR (level = 1 AND l IS NOT DISTINCT FROM lang AND n >= {rules.MIN_ROWS}) OR level = 2) QUALIFY row_number() OVER (PARTITION BY e.id, e.k ORDER BY level) = 1), "
    f"h AS (SELECT id, bool_and(val BETWEEN lo AND hi) AS inside FROM j GROUP BY id), y AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m JOIN h USING (id)) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM y",
    "op2_url_digest": "WITH r(h, p, v) AS (VALUES " + ", ".join(map(str, URL_RULES)) + f"), u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages) SELECT page_id, host, path, {_BEST.format('h || p')} AS rule, coalesce({_BEST.format('v')}, 'allow') AS verdict FROM u",
    "op3_vector_approximation": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM k WHERE rank <= 10",
    "op8_prefix_targets": r"WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'), "
    + f"t AS (SELECT *, sum(6 + length(replace({_ESCAPED.format('role')}, ':', '\\:')) + length({_ESCAPED.format('text')}) + 8) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM c) "
    + "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (WHERE role = 'assistant' OR last) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id",
    "op11_sorted_projections": "WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98), "
    "r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), n AS (SELECT a, count(*) AS n FROM l GROUP BY a) SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id",
    "op12_superblock_manifest": _manifest_sql(),
    "op13_pivot_collocations": _PHRASES,
}
