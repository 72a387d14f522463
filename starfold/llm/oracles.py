"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from .license_scan import NOTICES, PHRASES
from .merkle import FIELDS
from .mixing import Mix
from .quality_rules import Limits
from .url_rules import RULES, SEEDS

_L = Limits()
_BLANK = r"[^\x20\x09-\x0D]+"
_GRAMS = ", ".join(f"({k}, {most})" for k, most in _L.grams)

QUALITY = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_BLANK}') AS words FROM d),
 n AS (SELECT rid, doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM w),
 l AS (SELECT rid, i, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '{_BLANK}')),
 lr AS (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k, octet_length(encode(line)) AS n FROM l),
 lines AS (SELECT rid, count(*) FILTER (k > 1) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS DOUBLE) / sum(n) AS line_share FROM lr GROUP BY rid),
 sizes AS (SELECT k, most FROM (VALUES (3, 1.0), {_GRAMS}) AS t(k, most)),
 g AS (SELECT rid, k, i, array_to_string(words[i:i + k - 1], ' ') AS gram FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w CROSS JOIN sizes WHERE len(words) >= k)),
 gr AS (SELECT rid, k, i, count(*) OVER (PARTITION BY rid, k, gram) AS times, row_number() OVER (PARTITION BY rid, k, gram ORDER BY i) AS place FROM g),
 hit AS (SELECT DISTINCT rid, k, i + j AS pos FROM (SELECT rid, k, i, unnest(range(0, k)) AS j FROM gr WHERE (k = 3 AND times > 1) OR (k > 3 AND place > 1))),
 cover AS (SELECT hit.rid, k, count(*) AS n, sum(length(words[pos])) AS chars FROM hit JOIN w ON w.rid = hit.rid GROUP BY hit.rid, k),
 share AS (SELECT rid, max(CASE WHEN k = 3 THEN n ELSE 0 END) AS n_repeat_words, max(CASE WHEN k > 3 THEN chars END) AS most_chars, bool_or(k > 3 AND chars > most * word_chars) AS much FROM cover JOIN sizes USING (k) JOIN n USING (rid) GROUP BY rid),
 j AS (SELECT n.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(line_share, 0.0) AS line_share, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(much, false) AS much, coalesce(CAST(most_chars AS DOUBLE) / word_chars, 0.0) AS gram_share FROM n LEFT JOIN lines USING (rid) LEFT JOIN share USING (rid)),
 f AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.repeat_words_pct} * n_words AS base_failed FROM j)
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND line_share <= {_L.lines} AND n_symbols <= {_L.symbols_per_word} * n_words AND NOT much AS kept, round(line_share, 9) AS dup_line_share, round(gram_share, 9) AS dup_gram_share FROM f"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = ", ".join(f"('{k}', string_split('{p}', ' '))" for k, p in PHRASES.items())
_NOTICES = ", ".join(f"('{k}/{j}', '{k}', list_distinct(string_split('{t}', ' ')), CAST(ceil(1.5 * {len(t.split())}) AS BIGINT))" for k, ts in NOTICES.items() for j, t in enumerate(ts))

LICENSES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
 w AS (SELECT rid, doc_id, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS words FROM d),
 phrases AS (SELECT label, p FROM (VALUES {_PHRASES}) AS t(label, p)),
 found AS (SELECT rid, label, i - 1 AS i FROM (SELECT rid, words, label, p, unnest(range(1, len(words) - len(p) + 2)) AS i FROM w CROSS JOIN phrases WHERE len(words) >= len(p) AND list_contains(words, p[1])) WHERE words[i:i + len(p) - 1] = p),
 base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM found GROUP BY rid),
 tokens AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
 notices AS (SELECT notice, label, p, reach FROM (VALUES {_NOTICES}) AS t(notice, label, p, reach)),
 parts AS (SELECT notice, label, len(p) AS n, reach, unnest(p) AS w FROM notices),
 held AS (SELECT rid, notice FROM tokens JOIN parts USING (w) GROUP BY rid, notice HAVING count(DISTINCT w) >= 0.8 * any_value(n) - 1e-9),
 occ AS (SELECT rid, notice, label, n, reach, i, w FROM tokens JOIN parts USING (w) JOIN held USING (rid, notice)),
 s AS (SELECT a.rid, a.notice, a.label, a.i, count(DISTINCT b.w) AS overlap, count(DISTINCT b.w) / any_value(a.n) AS share FROM occ a JOIN occ b ON a.rid = b.rid AND a.notice = b.notice AND b.i >= a.i AND b.i < a.i + a.reach GROUP BY a.rid, a.notice, a.label, a.i),
 f AS (SELECT *, rank() OVER (PARTITION BY rid, i ORDER BY share DESC, overlap DESC) AS place FROM s WHERE share >= 0.8 - 1e-9),
 m AS (SELECT rid, list_distinct(list(label)) AS labels, max(share) AS share, count(DISTINCT i) AS n_places FROM f WHERE place = 1 GROUP BY rid)
 SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(share, 0.0), 9) END AS score, coalesce(n_places, 0) AS n_places
 FROM w LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)"""

_M = Mix()
_WEIGHTS = ", ".join(map(str, _M.weights))

MIXING = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_BLANK}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')) AS k FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{_WEIGHTS}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_M.weights)} + 1] AS w FROM d GROUP BY source),
 t AS (SELECT *, CAST({_M.share} AS DOUBLE) * sum(source_size) OVER () AS whole, {_M.most} * source_size AS cap, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST) AS i FROM s),
 r AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
 l AS (SELECT level FROM r WHERE level * w <= cap ORDER BY i LIMIT 1),
 g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT level FROM l)) AS target FROM t),
 m AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
 SELECT doc_id, size, source_size, target, size * (CAST(middle < target AS BIGINT) + CAST(source_size + middle < target AS BIGINT)) AS taken FROM m"""

NEGATIVES = """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id OR a.label <> b.label WHERE a.id % 50 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || " + _FIELD.format("{text}") + ")"
# The CRC-32 polynomial, a byte at a time and its eight shifts.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"

MERKLE = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, * FROM documents),
 leaf AS (SELECT rid, doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS altered FROM d),
 spot AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaf),
 low AS (SELECT 0 AS lvl, tree, list(leaf ORDER BY place) AS nodes FROM spot GROUP BY tree
   UNION ALL SELECT lvl + 1, tree, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM low WHERE len(nodes) > 1),
 subs AS (SELECT tree, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
 high AS (SELECT 0 AS lvl, list(subroot ORDER BY tree) AS nodes FROM subs
   UNION ALL SELECT lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM high WHERE len(nodes) > 1),
 depth AS (SELECT tree, max(lvl) AS deep FROM low GROUP BY tree),
 all_levels AS (SELECT tree, lvl, nodes FROM low WHERE len(nodes) > 1 UNION ALL SELECT s.tree, deep + lvl, nodes FROM high CROSS JOIN subs s JOIN depth USING (tree) WHERE len(nodes) > 1),
 paths AS (SELECT rid, doc_id, leaf, altered, tree, 0 AS lvl, place, altered AS digest, '' AS proof FROM spot
   UNION ALL SELECT rid, doc_id, leaf, altered, p.tree, p.lvl + 1, CASE WHEN p.lvl < deep THEN place // 3 ELSE here // 3 END, sha256(array_to_string(list_concat(nodes[here // 3 * 3 + 1:here], [digest], nodes[here + 2:here // 3 * 3 + 3]), '')),
     proof || array_to_string(list_concat(nodes[here // 3 * 3 + 1:here], nodes[here + 2:here // 3 * 3 + 3]), '')
     FROM (SELECT q.*, deep, CASE WHEN q.lvl = deep THEN q.tree ELSE q.place END AS here FROM paths q JOIN depth USING (tree)) p JOIN all_levels a ON a.tree = p.tree AND a.lvl = p.lvl),
 ends AS (SELECT * FROM paths QUALIFY lvl = max(lvl) OVER (PARTITION BY rid))
 SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS verified FROM ends JOIN subs USING (tree)"""

ORACLES = {"op11_mixing": MIXING, "op12_hard_negatives": NEGATIVES, "op13_merkle": MERKLE, "op5_quality_rules": QUALITY, "op9_license_scan": LICENSES}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_SEEDS = ", ".join(f"'{s}'" for s in SEEDS)

# Every token combination of a page is a set of a bit mask; rules are counted over all of them.
URLS = rf"""WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT rid, page_id, coalesce(url, '') AS url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
 c AS (SELECT rid, page_id, url, {_LOW.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
 d AS (SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, regexp_extract(url, '\?([^#]*)', 1) AS query FROM c),
 e AS (SELECT rid, page_id, host, path, len(list_intersect(regexp_split_to_array(host, '[.\-]'), [{_SEEDS}])) > 0 AS bad, list_filter([
   CASE WHEN ls[-1] <> '' THEN 'tld=' || ls[-1] END, CASE WHEN len(ls) >= 2 THEN 'domain=' || ls[-2] || '.' || ls[-1] END, CASE WHEN len(ls) >= 3 AND ls[-3] <> '' THEN 'site=' || ls[-3] END,
   CASE WHEN len(ls) >= 3 AND regexp_extract(ls[-3], '-([^-]+)$', 1) <> '' THEN 'part=' || regexp_extract(ls[-3], '-([^-]+)$', 1) END,
   CASE WHEN len(ls) >= 4 AND array_to_string(ls[1:len(ls) - 3], '.') <> '' THEN 'sub=' || array_to_string(ls[1:len(ls) - 3], '.') END, 'seg1=' || segs[1], 'seg2=' || regexp_replace(segs[2], '[0-9]+', '0', 'g'),
   CASE WHEN regexp_extract(path, '\.([A-Za-z0-9]{{1,5}})$', 1) <> '' THEN 'ending=' || regexp_extract(path, '\.([A-Za-z0-9]{{1,5}})$', 1) END,
   CASE WHEN query <> '' THEN 'query=' || array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*')))), '&') END], lambda x: x IS NOT NULL) AS tokens FROM d),
 known AS (SELECT page_id, bool_or(bad) AS bad FROM e WHERE left(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1) >= '4' GROUP BY page_id),
 n AS (SELECT count(*) AS n FROM e JOIN known USING (page_id) WHERE len(tokens) > 0),
 sets AS (SELECT rid, page_id, list_sort(list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1)) AS items FROM (SELECT rid, page_id, tokens, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS m FROM e WHERE len(tokens) > 0)),
 counted AS (SELECT items, count(*) AS freq, count(*) FILTER (known.bad) AS hits FROM sets JOIN known USING (page_id) GROUP BY items),
 mined AS (SELECT items, hits / freq AS conf FROM counted, n WHERE hits >= ceil(greatest(0.002, 3 / n) * n) AND hits >= 0.9 * freq),
 best AS (SELECT rid, max(conf) AS conf FROM sets JOIN mined USING (items) GROUP BY rid),
 rules AS (SELECT verdict, h, p FROM (VALUES {_RULES}) AS t(verdict, h, p)),
 fit AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC) AS k FROM e, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
 SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN conf IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, conf AS mined_confidence
 FROM e LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid) LEFT JOIN best USING (rid)"""

ORACLES["op3_url_filter"] = URLS
