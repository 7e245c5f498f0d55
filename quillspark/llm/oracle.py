"""SQL of the operators that another engine can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6 = """WITH RECURSIVE good AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
both_ AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
links AS (SELECT a, b FROM both_ UNION ALL SELECT b, a FROM both_), ids AS (SELECT vec_id AS id FROM embeddings),
reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM least LEFT JOIN counts USING (id)"""

OP8 = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS s FROM words),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM flat p JOIN flat q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
both_ AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
links AS (SELECT a, b FROM both_ UNION ALL SELECT b, a FROM both_), ids AS (SELECT doc_id AS id FROM documents),
reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id"""

#: Windows of 100 bytes as hexadecimal digits; of equal ones all but the first cover their bytes.
OP7 = """WITH data AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS at_ FROM data),
windows AS (SELECT doc_id, at_, md5_number(substring(h, 2 * at_ + 1, 200)) AS w FROM starts),
again AS (SELECT doc_id, at_ FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, at_) > 1),
turns AS (SELECT *, (at_ > coalesce(lag(at_) OVER (PARTITION BY doc_id ORDER BY at_) + 100, -1))::INT AS new FROM again),
runs AS (SELECT doc_id, min(at_) AS a, max(at_) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY at_) AS r FROM turns) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(b, 0), length(h) // 2 FROM data LEFT JOIN (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps JOIN data USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS m FROM runs GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM data JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

#: Ranks cut twice into intervals of about 1024 documents; in the last one a recursion fills what is lacking, and the best exchange ends it.
OP13 = r"""WITH RECURSIVE sizes AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substring(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
sums AS (SELECT src, source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes GROUP BY src, source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * s AS most FROM sums),
level AS (SELECT *, sum(most) OVER o AS full_, sum(w) OVER o AS w_full, 1.5::DOUBLE * sum(s) OVER () AS all_, sum(w) OVER () AS w_all FROM weighed WINDOW o AS (ORDER BY most / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
capped AS (SELECT *, most * (w_all - w_full + w) <= (all_ - full_ + most) * w AS c FROM level),
goals AS (SELECT src, source, s, CASE WHEN c THEN most ELSE (all_ - coalesce(sum(CASE WHEN c THEN most END) OVER (), 0.0::DOUBLE)) / sum(CASE WHEN NOT c THEN w END) OVER () * w END AS target FROM capped),
classed AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM sizes),
classes AS (SELECT src, class, sum(size)::BIGINT AS words, target, pow(2.0::DOUBLE, class * -0.25::DOUBLE) AS w FROM classed JOIN goals USING (src) GROUP BY src, class, target HAVING sum(size) > 0),
spread AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY class ROWS UNBOUNDED PRECEDING) * 2.0::DOUBLE AS full_, sum(w * words) OVER (PARTITION BY src ORDER BY class DESC ROWS UNBOUNDED PRECEDING) AS rest FROM classes),
full_classes AS (SELECT *, w * (target - (full_ - words * 2.0::DOUBLE)) >= 2.0::DOUBLE * rest AS c FROM spread),
copies AS (SELECT src, class, CASE WHEN c THEN 2.0::DOUBLE ELSE greatest(0.0::DOUBLE, (target - coalesce(sum(CASE WHEN c THEN words END) OVER (PARTITION BY src), 0) * 2.0::DOUBLE) / sum(CASE WHEN NOT c THEN w * words END) OVER (PARTITION BY src) * w) END AS copies FROM full_classes),
expected AS (SELECT doc_id, src, size, u, floor(coalesce(copies, 0.0::DOUBLE))::BIGINT AS whole, coalesce(copies, 0.0::DOUBLE) - floor(coalesce(copies, 0.0::DOUBLE)) AS p FROM classed LEFT JOIN copies USING (src, class)),
ranked AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS z FROM expected),
start_ AS (SELECT src, target - sum(whole * size)::BIGINT AS lacking, least(4096, greatest(1, ceil(count(z) / 1024)))::BIGINT AS cuts1 FROM ranked JOIN goals USING (src) GROUP BY src, target),
first_ AS (SELECT ranked.*, lacking, cuts1, floor(z * cuts1)::BIGINT AS b1 FROM ranked JOIN start_ USING (src) WHERE z IS NOT NULL),
sums1 AS (SELECT src, b1, lacking, sum(size)::BIGINT AS words, count(*) AS n FROM first_ GROUP BY src, b1, lacking),
run1 AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY b1 ROWS UNBOUNDED PRECEDING) AS so_far, max(b1) OVER (PARTITION BY src) AS last_ FROM sums1),
end1 AS (SELECT src, b1, lacking - so_far + words AS lacking, least(4096, greatest(1, ceil(n / 1024)))::BIGINT AS cuts2 FROM run1 WHERE so_far >= lacking OR b1 = last_ QUALIFY row_number() OVER (PARTITION BY src ORDER BY b1) = 1),
second_ AS (SELECT f.doc_id, f.src, f.size, f.whole, f.z, e.lacking, e.b1 AS end1, f.b1, least(floor((f.z * f.cuts1 - f.b1) * e.cuts2)::BIGINT, e.cuts2 - 1) AS b2 FROM first_ f JOIN end1 e USING (src)),
sums2 AS (SELECT src, b2, lacking, sum(size)::BIGINT AS words FROM second_ WHERE b1 = end1 GROUP BY src, b2, lacking),
run2 AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY b2 ROWS UNBOUNDED PRECEDING) AS so_far, max(b2) OVER (PARTITION BY src) AS last_ FROM sums2),
end2 AS (SELECT src, b2, lacking - so_far + words AS lacking FROM run2 WHERE so_far >= lacking OR b2 = last_ QUALIFY row_number() OVER (PARTITION BY src ORDER BY b2) = 1),
placed AS (SELECT s.*, e.b2 AS end2, e.lacking AS gap FROM second_ s JOIN end2 e USING (src)),
inner_ AS (SELECT doc_id, src, size, gap, row_number() OVER (PARTITION BY src ORDER BY z, doc_id, size) AS at_ FROM placed WHERE b1 = end1 AND b2 = end2),
fill AS (SELECT src, 0::BIGINT AS at_, gap, FALSE AS took FROM inner_ WHERE at_ = 1
    UNION ALL SELECT i.src, i.at_, CASE WHEN i.size <= f.gap THEN f.gap - i.size ELSE f.gap END, i.size <= f.gap FROM fill f JOIN inner_ i ON i.src = f.src AND i.at_ = f.at_ + 1),
left_ AS (SELECT src, arg_max(gap, at_) AS gap FROM fill GROUP BY src),
got AS (SELECT i.src, i.at_, i.size, f.took FROM inner_ i JOIN fill f ON f.src = i.src AND f.at_ = i.at_),
swaps AS (SELECT o.src, o.at_ AS add_, coalesce(t.at_, -1) AS drop_, abs(l.gap - o.size + coalesce(t.size, 0)) AS error, l.gap FROM got o JOIN left_ l ON l.src = o.src
    JOIN (SELECT src, at_, size FROM got WHERE took UNION ALL SELECT src, -1, 0 FROM left_) t ON t.src = o.src WHERE NOT o.took),
best AS (SELECT src, add_, drop_ FROM swaps WHERE error < gap QUALIFY row_number() OVER (PARTITION BY src ORDER BY error, add_, drop_) = 1),
ended AS (SELECT i.doc_id, i.src, i.size, (g.took AND NOT coalesce(g.at_ = b.drop_, FALSE)) OR coalesce(g.at_ = b.add_, FALSE) AS more FROM inner_ i JOIN got g ON g.src = i.src AND g.at_ = i.at_ LEFT JOIN best b ON b.src = i.src),
early AS (SELECT doc_id FROM placed WHERE b1 < end1 OR (b1 = end1 AND b2 < end2)),
taken AS (SELECT doc_id FROM early UNION ALL SELECT doc_id FROM ended WHERE more)
SELECT e.doc_id, e.size, g.s AS source_size, g.target, e.size * (e.whole + (e.doc_id IN (SELECT doc_id FROM taken))::BIGINT) AS taken, g.source FROM expected e JOIN goals g USING (src)"""

OP11 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10), sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups_ AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY lang, source, v),
shares AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v)::HUGEINT AS p FROM groups_ g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term), totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM counts GROUP BY lang),
langs AS (SELECT w.lang, w.term, 1 + 1000000000::HUGEINT * (w.n + 2) // (t.total + 2 * s.v)::HUGEINT AS q FROM whole w JOIN totals t USING (lang) JOIN sizes s USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT s.lang, s.source, 'term', s.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLE_SQL = {"op6_epsilon_grid": OP6, "op7_suffix_arrays": OP7, "op8_bayes_minhash": OP8, "op11_source_divergence": OP11, "op13_pareto_mix": OP13}
