"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line) u
), f AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, (f.key IS NOT NULL AND f.keeper <> l.doc_id) AS gone FROM l LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS tm FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap FROM w
), l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM c
), o AS (
  SELECT *, (total - cb) / (all_weight - wb) AS level FROM l
), x AS (
  SELECT arg_min(level, cap / weight) FILTER (WHERE level * weight <= cap) AS water FROM o
), t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM o, x
), b AS (
  SELECT *, greatest(1, least(wide, floor(min(target) FILTER (WHERE target > 0) OVER () / 128)))::BIGINT AS block
  FROM (SELECT *, greatest(1, floor(sum(target) OVER () / 1048576))::BIGINT AS wide FROM t)
), seats AS (
  SELECT *, floor(sum(target) OVER () / block)::BIGINT AS seats FROM b
), q1 AS (
  SELECT *, target / (2 * k + 1) AS quotient FROM seats, LATERAL (SELECT unnest(range(0, (ceil(target / block) + 12)::BIGINT)) AS k) WHERE target > 0
), q2 AS (
  SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source ASC NULLS LAST) AS r FROM q1) WHERE r <= seats GROUP BY source
), q AS (
  SELECT seats.*, coalesce(quota, 0) AS source_quota, greatest(1, floor(source_size / (wide * 256)))::INT AS shards
  FROM seats LEFT JOIN q2 ON seats.source IS NOT DISTINCT FROM q2.source
), p AS (
  SELECT d.*, source_size, target, block, source_quota, md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || tm) AS place, shards
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), h AS (
  SELECT *, (('0x' || substr(place, 1, 8))::BIGINT % shards)::INT AS shard FROM p
), sh AS (
  SELECT source, shard, sum(size) AS shard_size, any_value(source_quota) AS source_quota, any_value(block) AS block FROM h GROUP BY source, shard
), sz AS (
  SELECT *, sum(shard_size) OVER (PARTITION BY source) AS total FROM sh
), r1 AS (
  SELECT *, shard_size / (2 * k + 1) AS quotient
  FROM sz, LATERAL (SELECT unnest(range(0, (ceil(shard_size * source_quota / total) + 12)::BIGINT)) AS k) WHERE shard_size > 0
), r2 AS (
  SELECT source, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard) AS r FROM r1) WHERE r <= source_quota GROUP BY source, shard
), y1 AS (
  SELECT sz.source, sz.shard, sz.shard_size, sz.block, coalesce(r2.quota, 0) * sz.block AS asked, 2 * sz.shard_size AS cap
  FROM sz LEFT JOIN r2 ON sz.source IS NOT DISTINCT FROM r2.source AND sz.shard = r2.shard
), y2 AS (
  SELECT *, sum(greatest(0, asked - cap)) OVER (PARTITION BY source) AS excess,
    coalesce(sum(greatest(0, cap - asked)) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before FROM y1
), y3 AS (
  SELECT source, shard, shard_size, least(asked, cap) + greatest(0, least(greatest(0, cap - asked), excess - room_before)) AS wanted,
    block * greatest(1, shard_size // (block * 256)) AS run_tokens FROM y2
), n1 AS (
  SELECT *, least(run_tokens, shard_size - run * run_tokens) AS length, wanted % shard_size AS rest
  FROM y3, LATERAL (SELECT unnest(range(0, ceil(shard_size / run_tokens)::BIGINT)) AS run) WHERE shard_size > 0
), n2 AS (
  SELECT *, greatest(0, least(length, rest - (sum(length) OVER (PARTITION BY source, shard ORDER BY md5('17|run|' || coalesce(source, '') || '|' || shard || '|' || run), run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length))) AS took FROM n1
), z AS (
  SELECT h.*, y3.shard_size, y3.wanted,
    sum(size) OVER (PARTITION BY h.source, h.shard ORDER BY place, doc_id, tm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM h JOIN y3 ON h.source IS NOT DISTINCT FROM y3.source AND h.shard = y3.shard
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN shard_size > 0 THEN wanted // shard_size * size ELSE 0 END + coalesce((
    SELECT sum(greatest(0, least(z.start + z.size, n2.run * n2.run_tokens + n2.took) - greatest(z.start, n2.run * n2.run_tokens)))
    FROM n2 WHERE n2.source IS NOT DISTINCT FROM z.source AND n2.shard = z.shard), 0))::BIGINT AS taken
FROM z
"""

#: All pairs of vectors; the components by repeated steps along the links.
OP3 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a
), c AS (
  SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id)
"""

#: Pairs of distinct n-gram sets that share a gram, copies collapsed; the components by repeated steps along the links.
OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS gs FROM w
), d AS (
  SELECT doc_id, len(gs) AS n_grams, gs, CASE WHEN len(gs) = 0 THEN 'none ' || doc_id ELSE md5(array_to_string(gs, chr(10))) END AS node FROM g
), c AS (
  SELECT node, min(doc_id) AS class_id, count(*) AS weight, any_value(gs) AS gs, any_value(n_grams) AS n_grams FROM d GROUP BY node
), x AS (
  SELECT node, n_grams, unnest(gs) AS gram FROM c
), p AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.gram = b.gram AND a.node <> b.node
  GROUP BY a.node, b.node HAVING count(*) / (any_value(a.n_grams) + any_value(b.n_grams) - count(*)) >= 0.8
), r AS (
  SELECT node, node AS seen FROM c UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a
), m AS (
  SELECT r.node, min(c.class_id) AS component_id FROM r JOIN c ON r.seen = c.node GROUP BY r.node
), k AS (
  SELECT p.a AS node, sum(c.weight)::BIGINT AS others FROM p JOIN c ON p.b = c.node GROUP BY p.a
)
SELECT doc_id, d.n_grams, class_id, weight - 1 + coalesce(others, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (node) JOIN m USING (node) LEFT JOIN k USING (node)
"""

OP10 = r"""
WITH w AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), h AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY key) AS c
  FROM (SELECT row_id, i, md5_number(array_to_string(ws[i:i + 34], ' ')) AS key FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35))
), p AS (
  SELECT row_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w
), m AS (
  SELECT p.row_id, p.pos, p.word, coalesce(max(CASE WHEN h.c > 1 THEN h.i END) OVER (PARTITION BY p.row_id ORDER BY p.pos), -99) >= p.pos - 34 AS gone
  FROM p LEFT JOIN h ON h.row_id = p.row_id AND h.i = p.pos
), a AS (
  SELECT row_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY row_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (row_id)
"""


def _step(state: str, cost: str, letter: str) -> str:
    """A state's `six digits of cost + audit` after one more edit."""
    return f"lpad((substr({state}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{letter}'"


#: States are the four states of the role order, as strings that compare by cost, then audit; a turn is [initial, forced, extra cost].
_ENTER = f"[s[1], s[2], least(s[3], {_step('s[1]', '3', 'I')}, {_step('s[2]', '3', 'I')}, {_step('s[4]', '3', 'I')}), s[4]]"


def _arcs() -> str:
    def kept(letter: str, state: int) -> str:
        return f"CASE WHEN x[1] = '{letter}' THEN {_step(f's[{state}]', 'x[3]::INT', 'K')} END"

    def changed(state: int) -> str:
        return _step(f"s[{state}]", "3 + x[3]::INT", "R")

    gone = [_step(f"s[{k}]", "4", "D") for k in (1, 2, 3, 4)]
    user = ", ".join([gone[2], *(kept("u", k) for k in (1, 2, 4)), *(changed(k) for k in (1, 2, 4))])
    return f"CASE WHEN x[2] = '1' THEN [{', '.join(gone)}] ELSE [{gone[0]}, least({gone[1]}, {kept('s', 1)}), least({user}), least({gone[3]}, {kept('a', 3)}, {changed(3)})] END"


def _closed(expression: str) -> str:
    return f"list_transform(list_transform([{expression}], lambda s: {_ENTER}), lambda z: [z[1], z[2], z[3], least(z[4], {_step('z[3]', '3', 'I')})])[1]"


OP12 = rf"""
WITH crc AS (
  SELECT list(coalesce(v, 0) ORDER BY b) AS tbl FROM (
    SELECT b, list_reduce([b] || range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))
), r0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), r1 AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda s, b: xor(tbl[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 20 AS kind
  FROM r0, crc
), r2 AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM r1 WHERE kind <> 0
), r3 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial
  FROM r2
), r4 AS (
  SELECT *, coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong FROM r3
), c1 AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate,
    count(*) FILTER (WHERE NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (WHERE wrong) AS illegal,
    list([initial, CASE WHEN blank OR seen THEN '1' ELSE '0' END, CASE WHEN cut THEN '3' ELSE '0' END] ORDER BY i) AS turns
  FROM r4 GROUP BY conv_id
), c2 AS (
  SELECT *, list_reduce(turns, lambda s, x: {_closed(_arcs())}, {_closed("['000000', NULL, NULL, NULL]::VARCHAR[]")}) AS ends FROM c1
), c3 AS (
  SELECT *, substr(least(ends[1], ends[4]), 1, 6)::BIGINT AS cost, substr(least(ends[1], ends[4]), 7) AS audit FROM c2
), e1 AS (
  SELECT conv_id, unnest(range(1, len(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS letter FROM c3 WHERE audit <> ''
), e2 AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM e1
), e3 AS (
  SELECT e2.conv_id, pos, letter, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, initial, row_number() OVER (PARTITION BY e2.conv_id ORDER BY pos) - 1 AS k
  FROM e2 LEFT JOIN r4 ON e2.conv_id IS NOT DISTINCT FROM r4.conv_id AND e2.i = r4.i AND letter <> 'I' WHERE letter <> 'D'
), e4 AS (
  SELECT *, max(CASE WHEN k = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM e3
), e5 AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos)) AS digest FROM e4 GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN c3 ON o.conv_id IS NOT DISTINCT FROM c3.conv_id LEFT JOIN e5 ON o.conv_id IS NOT DISTINCT FROM e5.conv_id
"""

#: CRC-32 from its table of 256 entries, over the bytes of each distinct feature.
OP13 = r"""
WITH crc AS (
  SELECT list(CASE WHEN v8 IS NULL THEN 0 ELSE v8 END ORDER BY b) AS tbl FROM (
    SELECT b, list_reduce([b] || range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS v8 FROM (SELECT unnest(range(256)) AS b))
), w AS (
  SELECT row_number() OVER () AS row_id, doc_id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, false AS item, text FROM documents UNION ALL SELECT NULL, true, text FROM benchmark)
), f AS (
  SELECT row_id, item, feature, count(*) AS n
  FROM (SELECT row_id, item, unnest(ws || list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' ')) || list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS feature FROM w)
  GROUP BY row_id, item, feature
), u AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)
), k AS (
  SELECT feature, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda s, b: xor(tbl[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 10000 AS bucket FROM u, crc
), g AS (
  SELECT row_id, item, bucket, n FROM f JOIN k USING (feature)
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE NOT item), 0) AS s, coalesce(sum(n) FILTER (WHERE item), 0) AS t FROM g GROUP BY bucket
), v AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c
), d AS (
  SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN v USING (bucket) WHERE NOT item GROUP BY row_id
), z AS (
  SELECT doc_id, len(ws) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d USING (row_id) WHERE NOT item
), r AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id ASC NULLS LAST, weight, n_features) AS place, count(*) FILTER (WHERE eligible) OVER () AS n FROM z
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""

ORACLE_SQL: dict[str, str] = {"op1_source_mix": OP1, "op3_cap_filter_links": OP3, "op5_line_dedup": OP5, "op7_ngram_jaccard_join": OP7, "op10_substring_dedup": OP10, "op12_conversation_repair": OP12, "op13_importance_resampling": OP13}
