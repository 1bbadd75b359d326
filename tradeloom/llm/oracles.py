"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.rid = x JOIN n AS ny ON ny.rid = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS t FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON r.t = e.x)
SELECT a.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM r JOIN d a ON a.rid = r.rid JOIN d b ON b.rid = r.t LEFT JOIN n ON n.rid = r.rid GROUP BY a.rid, a.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
s AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
f AS (SELECT k, min(doc_id) AS m FROM s GROUP BY k),
h AS (SELECT DISTINCT rid, p FROM s JOIN f USING (k), unnest(range(i, i + 13)) t(p) WHERE m < doc_id),
x AS (SELECT rid, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
y AS (SELECT x.rid, count(h.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (h.p IS NULL), '') AS kept FROM x LEFT JOIN h ON h.rid = x.rid AND h.p = x.p GROUP BY x.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (rid)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT item_id, j, least(13, len(w)) AS n, array_to_string(w[j:j+least(13, len(w))-1], ' ') AS k FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(j) WHERE len(w) > 0),
z AS (SELECT DISTINCT n FROM q),
s AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM d, z, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
o AS (SELECT rid, i, j, s.n, item_id FROM s JOIN q ON s.k = q.k AND s.n = q.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM o, unnest(range(i, i + n)) t(p) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM o) GROUP BY rid),
g AS (SELECT rid, item_id, i - j AS diagonal, i, n, i - row_number() OVER (PARTITION BY rid, item_id, i - j ORDER BY i) AS run FROM o),
v AS (SELECT rid, max(c) AS longest FROM (SELECT rid, count(*) - 1 + any_value(n) AS c FROM g GROUP BY rid, item_id, diagonal, run) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN h USING (rid) LEFT JOIN m USING (rid) LEFT JOIN v USING (rid)
"""


def quality_rules(rules, phrases: tuple[bytes, ...], marks: str, closers: str) -> str:
    """SQL of the line rules with the given limits (see quality.LineRules)."""
    n_of = lambda cls: f"length(regexp_replace(line, '[^{cls}]', '', 'g'))"
    boiler = " OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p.decode()}')" for p in phrases)
    num = lambda x: f"{x!r}::DOUBLE"
    last = "rtrim(lw[-1], '{}')".format(closers.replace("'", "''"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2]) AS times FROM d, unnest(range(1, len(w) - 1)) t(i) WHERE len(w) >= 3),
r AS (SELECT rid, count(DISTINCT p) AS n FROM g, unnest(range(i, i + 3)) t(p) WHERE times > 1 GROUP BY rid),
a AS (SELECT rid, i, lines[i] AS line FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM d), unnest(range(1, len(lines) + 1)) t(i)),
l AS (SELECT rid, i, line, regexp_extract_all(line, '{_SPACED}') AS lw FROM a),
m AS (SELECT *, len(lw) > 0 AS worded, len(lw) > 0 AND len(lw) <= {rules.menu_words} AND length(array_to_string(lw, '')) <= {rules.menu_chars} AND NOT contains('{marks}', right({last}, 1)) AS short, min(CASE WHEN len(lw) > 0 THEN i END) OVER (PARTITION BY rid) AS low_i, max(CASE WHEN len(lw) > 0 THEN i END) OVER (PARTITION BY rid) AS high_i,
  count(*) OVER (PARTITION BY rid, line) > 1 OR contains(line, '://') AS shown, sum(len(lw)) OVER (PARTITION BY rid) AS all_words FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY rid, worded ORDER BY i) - row_number() OVER (PARTITION BY rid, worded, short ORDER BY i) AS run FROM m),
v AS (SELECT *, short AND count(*) OVER r >= {rules.menu_lines} AND (2 * count(*) FILTER (shown) OVER r >= count(*) OVER r OR (bool_or(i = low_i OR i = high_i) OVER r AND sum(len(lw)) OVER r <= {num(rules.menu_share)} * all_words)) AS menu FROM u WINDOW r AS (PARTITION BY rid, worded, short, run)),
c AS (SELECT rid, line, menu, (length(line) - length(replace(line, '://', ''))) / 3 AS links, len(lw) AS n, len(list_distinct(lw)) AS dist, {n_of('#*$%&|<>')} AS sym, {n_of('!')} AS bang, {n_of('|')} AS bars, {n_of('A-Z')} AS up, {n_of('a-z')} AS low FROM v),
f AS (SELECT *, (sym >= 2 AND sym >= {num(rules.symbols_per_word)} * greatest(n, 1)) OR (bang >= 3 AND bang >= {num(rules.shouts_per_word)} * greatest(n, 1)) OR (n >= 5 AND up >= {num(rules.capitals)} * (up + low) AND up >= 10)
  OR menu OR (links >= 2 AND links >= {num(rules.links_per_word)} * greatest(n, 1)) OR (bars >= 2 AND bars >= {num(rules.separators_per_word)} * greatest(n, 1)) OR (n >= 10 AND dist <= {num(rules.distinct)} * n) OR (n <= {rules.boilerplate_words} AND ({boiler})) AS fails FROM c),
s AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost, count(*) FILTER (fails) AS failed FROM f GROUP BY rid),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(w) < {rules.min_words} OR coalesce(r.n, 0) > {num(rules.max_repeat)} * len(w) AS base_failed, coalesce(lost, 0)::BIGINT AS n_words_lost, coalesce(failed, 0)::BIGINT AS n_lines_failed FROM d LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT *, NOT base_failed AND n_words_lost <= {num(rules.max_loss)} * n_words AS kept FROM q
"""


FILTER_INTERACTIONS = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
first_ AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text), 'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)}} AS x,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN first_ ON first_.text = w.text LEFT JOIN lab ON lab.doc_id = w.doc_id),
c AS (SELECT part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, k AS step, filter_order[k] AS f, filter_order[1:k-1] AS before FROM o, range(1, 6) r(k) WHERE length(filter_order) = 5),
t AS (SELECT part, filter_order, step, f, sum(n) AS all_n, sum(n) FILTER (contains(fails, f)) AS failing, sum(n) FILTER (fails = f) AS only_f,
  sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS removed, sum(n) FILTER (translate(fails, before || f, '') <> fails) AS gone,
  sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS good, sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails) AS toxic FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, (all_n - coalesce(gone, 0))::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, (coalesce(failing, 0) - coalesce(removed, 0))::BIGINT AS redundant, coalesce(only_f, 0)::BIGINT AS unique_fails,
  coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t
"""


def cluster_vectors(clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    """SQL of the rounds, each an exact comparison of every vector with every centroid."""
    near = lambda c: f"SELECT rid, vec_id, q, min(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {clusters} + k) AS m FROM v, {c} GROUP BY ALL"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS c FROM (SELECT *, sha256('1:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for i in range(rounds):
        ctes.append(f"a{i} AS MATERIALIZED ({near(f'c{i}')})")
        ctes.append(f"s{i} AS (SELECT m % {clusters} AS k, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) t(j) GROUP BY ALL)")
        ctes.append(f"u{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY k)")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(u.c, o.c) AS c FROM c{i} o LEFT JOIN u{i} u ON u.k = o.k)")
    return f"""WITH {', '.join(ctes)}, f AS ({near(f'c{rounds}')}),
g AS (SELECT vec_id, (m % {clusters})::INTEGER AS cluster, (m // {clusters})::BIGINT AS distance FROM f)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM g JOIN c{rounds} ON k = cluster"""
