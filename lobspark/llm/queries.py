"""The corpus operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lobspark.llm import bmw, covertree, editwalk, hamerly, html, mixing, packing, pii, quality, secrets, simhash, tokens, warc


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _over("documents", simhash.near_duplicates),
    "op2_secrets": _over("documents", secrets.digest),
    "op3_packing": _over("documents", packing.digest),
    "op4_pii": _over("documents", pii.digest),
    "op5_covertree": _over("embeddings", covertree.digest),
    "op6_tokens": _over("documents", tokens.digest),
    "op7_html": _over("pages", html.extracted),
    "op8_warc": _over("pages", warc.digest),
    "op9_mixing": _over("documents", mixing.digest),
    "op10_quality": _over("documents", quality.digest),
    "op11_hamerly": _over("embeddings", hamerly.digest),
    "op12_editwalk": _over("documents", editwalk.digest),
    "op13_bmw": lambda spark, sf_dir: bmw.digest(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))),
}

_SQUARED = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _clusters_sql() -> str:
    """Lloyd's rounds, each vector held against every centroid."""
    out = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({hamerly.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE len(embedding) = {hamerly.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           f"c0 AS (SELECT k, e FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS k, e FROM kept) WHERE k < {hamerly.K})"]
    for i in range(hamerly.ROUNDS + 1):
        out.append(f"a{i} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, c.k, {_SQUARED} AS d FROM kept v CROSS JOIN c{i} c) GROUP BY r)")
        if i < hamerly.ROUNDS:
            out.append(f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a.k, unnest(range({hamerly.COMPONENTS})) AS i, unnest(v.e) AS x FROM a{i} a JOIN kept v USING (r)) GROUP BY k, i) GROUP BY k)")
            out.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (k))")
    last = hamerly.ROUNDS
    return f"""WITH {', '.join(out)}
SELECT v.vec_id, a.k::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM kept v JOIN a{last} a USING (r) JOIN c{last} c ON c.k = a.k"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_hamerly": _clusters_sql(),
    "op13_bmw": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), dn AS (
  SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), t AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM dn
), p AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), q AS (
  SELECT item, item_id, unnest(list_distinct(w)) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark)
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, t WHERE term IN (SELECT term FROM q) GROUP BY term, docs
), s AS (
  SELECT q.item, q.item_id, dn.doc_id, sum(f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * dn.n * t.docs) // t.terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN dn ON dn.r = p.r, t GROUP BY q.item, q.item_id, dn.r, dn.doc_id
)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= {bmw.TOP}
""",
    "op5_covertree": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
""",
    # The article as these pages mark it; the operator itself does not rely on the mark.
    "op7_html": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(h1|p)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*(>|$)', '', 'g')) AS blocks FROM a
), c AS (
  SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b
), t AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM f
""",
    "op9_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM s
), l AS (
  SELECT remaining, rest FROM o WHERE remaining * weight <= cap * rest ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT remaining FROM l)::BIGINT * weight / (SELECT rest FROM l)::BIGINT), cap::DOUBLE) AS target FROM o
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), x AS (
  SELECT d.*, r.source_size, r.target, r.rate FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), b AS (
  SELECT source, floor(u * {mixing.BINS})::BIGINT AS bin, sum(size)::BIGINT AS words FROM x GROUP BY ALL
  UNION ALL SELECT source, -1, 0 FROM r
), c AS (
  SELECT b.source, b.bin + 1 AS cut, abs((sum(b.words) OVER (PARTITION BY b.source ORDER BY b.bin))::BIGINT - (r.rate - floor(r.rate)) * r.source_size) AS off FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
), k AS (
  SELECT source, arg_min(cut, (off, cut)) AS cut FROM c GROUP BY source
)
SELECT x.doc_id, x.size, x.source_size, x.target, (floor(x.rate)::BIGINT + (floor(u * {mixing.BINS}) < k.cut)::BIGINT) * x.size AS taken, x.source,
  floor(x.rate)::BIGINT + (floor(u * {mixing.BINS}) < k.cut)::BIGINT AS copies
FROM x JOIN k ON x.source IS NOT DISTINCT FROM k.source
""",
    "op10_quality": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, {' + '.join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality.RULES))} AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  bits = 0 AS kept, n_lines, n_letter_words, bits::BIGINT AS failed_rules FROM f
""",
}
