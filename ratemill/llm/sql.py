"""Comparison SQL of the operators on training texts that SQL can express."""

from __future__ import annotations

#: crc32 as a reduction: each byte is mixed in, then eight marks shift.
_HEADS = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(o.conv_id AS varchar), ''), lambda c: [cast(ord(c) AS bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"

PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'k': md5(concat(length(role), ':', role, text)), 'w': len(regexp_extract_all(text, '[^ \\t-\\r]+'))}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id),
sized AS (SELECT o.conv_id, o.turns, xor({_HEADS}, 4294967295) % 4 AS h FROM own o),
built AS (
  SELECT s.conv_id, list_concat(coalesce(o.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns
  FROM sized s LEFT JOIN own o ON o.conv_id = s.conv_id - s.conv_id % 20),
prefixes AS (
  SELECT conv_id, depth, len(turns) AS n, array_to_string(list_transform(turns[1:depth], lambda t: t.k), ',') AS path,
    CASE WHEN depth > 0 THEN array_to_string(list_transform(turns[1:depth - 1], lambda t: t.k), ',') END AS parent,
    CASE WHEN depth > 0 THEN turns[depth].w ELSE 0 END AS words
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built)),
nodes AS (
  SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, path),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own_facts AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.words AS saved
  FROM nodes n LEFT JOIN children c ON c.parent = n.path AND c.depth = n.depth),
above AS (
  SELECT up, array_to_string(string_split(path, ',')[1:up], ',') AS top, leaf, saved
  FROM (SELECT path, leaf, saved, unnest(range(0, depth + 1)) AS up FROM own_facts)),
subtrees AS (SELECT up, top, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, cast(s.n_leaves AS bigint) AS n_leaves, cast(s.saved_tokens AS bigint) AS saved_tokens, f.ends_sha256
FROM own_facts f JOIN subtrees s ON s.up = f.depth AND s.top = f.path LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.path = f.parent
"""

FILTER_AUDIT = """
WITH counted AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents),
judged AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(c.doc_id) OVER (PARTITION BY text) < c.doc_id THEN 16 ELSE 0 END AS mask
  FROM counted c LEFT JOIN judged j ON j.doc_id = c.doc_id),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
perms AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ord(filter_order[step]) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ord(filter_order[i]) - 65))) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM perms)),
met AS (
  SELECT part, filter_order, cast(step AS integer) AS step, bit, mask & bit <> 0 AS fails, mask & cast(coalesce(before, 0) AS integer) = 0 AS there, mask, n, good, toxic FROM masks, steps),
rows_ AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN there AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT there AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN there AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN there AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley
FROM rows_
"""

_SHINGLES = "CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END"
_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+')"

DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS row_key, doc_id, {_LOWER} AS words FROM documents),
items AS (SELECT item_id, {_LOWER} AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
own AS (SELECT row_key, unnest({_SHINGLES}) AS shingle FROM docs),
wanted AS (SELECT row_number() OVER () AS item_key, item_id, {_SHINGLES} AS shingles FROM items),
listed AS (SELECT item_key, item_id, len(shingles) AS n, unnest(shingles) AS shingle FROM wanted),
pairs AS (SELECT row_key, item_id, max(c) AS containment FROM (SELECT row_key, item_key, item_id, count(*) / n AS c FROM own JOIN listed USING (shingle) GROUP BY row_key, item_key, item_id, n) WHERE c >= 0.8 GROUP BY ALL),
found AS (SELECT row_key, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY item_id) AS item_ids, max(containment) AS containment FROM pairs GROUP BY ALL)
SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(containment, 0.0) AS containment, item_ids IS NULL AS kept FROM docs LEFT JOIN found USING (row_key)
"""
