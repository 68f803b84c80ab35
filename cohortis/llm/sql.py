"""SQL (DuckDB) that states the results of the corpus queries that SQL can state."""

from __future__ import annotations

import math

from cohortis.llm.line_dedup import MIN_WORDS
from cohortis.llm.mixing import LARGE_SHARE
from cohortis.llm.url_filter import ADDRESS, MAX_RHO, MIN_RHO, PORT, SUFFIXES
from cohortis.plans.registry import hash_sql

VECTOR_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN lowest ON lowest.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

LINE_DEDUP = f"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), ln AS (
  SELECT doc_id, i, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ln
), runs AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
  WHERE b.upto - a.upto + a.w >= {MIN_WORDS}
    AND (b.upto - b.w - a.upto + a.w < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})
), held AS (
  SELECT runs.doc_id, a, b, list_slice(lines, a, b) AS content FROM runs JOIN d ON d.doc_id = runs.doc_id
), firsts AS (
  SELECT *, first_value({{'doc': doc_id, 'a': a}}) OVER (PARTITION BY content ORDER BY doc_id, a) AS f FROM held
), later AS (
  SELECT doc_id, a, b, f.doc AS source FROM firsts WHERE f.doc < doc_id OR f.a < a
), gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), sources AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS first_docs FROM later GROUP BY doc_id
), kept AS (
  SELECT ln.doc_id, string_agg(line, chr(10) ORDER BY ln.i) FILTER (WHERE gone.i IS NULL) AS text,
    count(*) AS n, count(gone.i) AS g
  FROM ln LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.i = ln.i GROUP BY ln.doc_id
)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(g, 0) AS INTEGER) AS n_removed,
  coalesce(first_docs, '') AS first_docs
FROM documents LEFT JOIN kept ON kept.doc_id = documents.doc_id LEFT JOIN sources ON sources.doc_id = documents.doc_id
"""


def _shrunk(children: str) -> str:
    """Posterior mean and strength of each row of ``children`` (n, bad, and the parent's mean as prior)."""
    over = "sum(pow(bad - n * prior, 2) - n * prior * (1 - prior))"
    room = "sum(n * (n - 1) * prior * (1 - prior))"
    return f"""
SELECT c.*, (bad + k * prior) / (n + k) AS mean, n + k AS strength FROM {children} c,
  (SELECT 1 / CASE WHEN {room} > 0 THEN least(greatest({over} / {room}, {MIN_RHO}), {MAX_RHO}) ELSE {MAX_RHO} END - 1 AS k
   FROM {children})"""


def url_filter(rules: list[tuple[str, str, str]], most_bad: float = 0.3, z: float = 1.645) -> str:
    two, three = r"regexp_extract(name, '([^.]*\.)?[^.]*$')", r"regexp_extract(name, '([^.]*\.){0,2}[^.]*$')"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, h, p in longest]
    rule = "CASE " + " ".join(f + f"'{h + p}'" for f, (_, h, p) in zip(fits, longest)) + " END"
    verdict = "CASE " + " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, longest)) + (
        f" WHEN mean - {z} * sqrt(mean * (1 - mean) / (strength + 1)) > {most_bad} THEN 'block' ELSE 'allow' END")
    return rf"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), lab AS (
  SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), outcomes AS (
  SELECT parts.*, bad FROM parts LEFT JOIN lab
    ON lab.doc = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)
), hosts AS (
  SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad,
    CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {two} IN ({listed}) THEN {three} ELSE {two} END AS domain,
    CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN {two} IN ({listed}) THEN {two}
      ELSE regexp_extract(name, '[^.]*$') END AS suffix
  FROM (SELECT *, regexp_replace(host, '{PORT}', '') AS name FROM outcomes) GROUP BY host, name
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), tops AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 1) AS prior
  FROM domains GROUP BY suffix
), top AS ({_shrunk("tops")}
), domains2 AS (SELECT domains.*, top.mean AS prior FROM domains JOIN top ON top.suffix = domains.suffix
), domain_ AS ({_shrunk("domains2")}
), hosts2 AS (SELECT hosts.*, domain_.mean AS prior FROM hosts JOIN domain_ ON domain_.domain = hosts.domain
), host_ AS ({_shrunk("hosts2")})
SELECT page_id, parts.host AS host, path, {rule.replace("host", "parts.host")} AS rule,
  {verdict.replace("host", "parts.host")} AS verdict, round(mean, 6) AS bad_rate,
  round(mean - {z} * sqrt(mean * (1 - mean) / (strength + 1)), 6) AS bad_lower
FROM parts JOIN host_ ON host_.host = parts.host
"""


def mixing(weights: list[int], share: float = 1.5, max_epochs: float = 2.0, seed: int = 11) -> str:
    listed = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    place, most = hash_sql(seed, "mix", "CAST(doc_id AS VARCHAR)"), math.ceil(max_epochs)
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS src, {place} AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * {max_epochs} AS cap,
    [{listed}][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % {len(weights)} + 1] AS weight FROM d GROUP BY src
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, src) AS k,
    ({share} * sum(CAST(source_size AS DOUBLE)) OVER () - (sum(cap) OVER (ORDER BY cap / weight, src) - cap))
      / (sum(weight) OVER (ORDER BY cap / weight DESC, src DESC)) AS level FROM s
), t AS (
  SELECT src, source_size, CASE WHEN k < coalesce(f.k1, 1e18) THEN cap ELSE weight * f.l END AS target
  FROM o, (SELECT min(k) AS k1, min_by(level, k) AS l FROM o WHERE weight * level <= cap) f
), large AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.src ORDER BY size DESC, place, doc_id) AS k
  FROM d JOIN t ON t.src IS NOT DISTINCT FROM d.src WHERE size * {LARGE_SHARE} > source_size
), walk AS (
  SELECT src, CAST(0 AS BIGINT) AS k, CAST(target AS DOUBLE) AS left_, source_size AS room, CAST(NULL AS BIGINT) AS doc_id,
    CAST(0 AS BIGINT) AS copies FROM t
  UNION ALL
  SELECT src, k, left_ - copies * size, room - size, doc_id, copies FROM (
    SELECT l.src, l.k, l.size, l.doc_id, w.left_, w.room, CAST(list_sort([
      {{'miss': greatest(0e0, c * l.size - w.left_, w.left_ - c * l.size - {most} * (w.room - l.size)),
        'off': abs(c - w.left_ / w.room), 'copies': c}} FOR c IN range(0, {most} + 1)])[1].copies AS BIGINT) AS copies
    FROM walk w JOIN large l ON l.src IS NOT DISTINCT FROM w.src AND l.k = w.k + 1)
), shares AS (
  SELECT *, CASE WHEN whole < {most} THEN greatest(left_ - whole * room, 0e0) ELSE 0e0 END AS rest FROM (
    SELECT *, CASE WHEN room > 0 THEN floor(least(greatest(left_ / room, 0e0), {most})) ELSE 0 END AS whole FROM (
      SELECT src, max_by(left_, k) AS left_, max_by(room, k) AS room FROM walk GROUP BY src))
), others AS (
  SELECT d.*, whole, rest, sum(size) OVER (PARTITION BY d.src ORDER BY place, doc_id, size) AS upto
  FROM d JOIN t ON t.src IS NOT DISTINCT FROM d.src JOIN shares ON shares.src IS NOT DISTINCT FROM d.src
  WHERE size * {LARGE_SHARE} <= source_size
), copied AS (
  SELECT doc_id, src, copies FROM walk WHERE k > 0
  UNION ALL
  SELECT doc_id, src, whole + CASE WHEN rest > 0 AND upto - rest < rest - (upto - size) THEN 1 ELSE 0 END FROM others
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken
FROM d JOIN copied USING (doc_id) JOIN t ON t.src IS NOT DISTINCT FROM d.src
"""


EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), grams AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, ws, cut, array_to_string(ws[1:cut], ' ') AS p1, array_to_string(ws[cut + 1:k], ' ') AS p2
  FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k
), scored AS (
  SELECT cuts.*, f1.f AS l, f2.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(f1.f AS HUGEINT) * f2.f) AS BIGINT) AS score
  FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cuts.lang AND f2.phrase = p2
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_pairs AS (
  SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE k = 3
), kept AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM inner_pairs i WHERE i.lang = best.lang AND i.phrase = best.phrase AND 100 * i.longer >= 50 * best.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
