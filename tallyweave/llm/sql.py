"""The queries of this subpackage that SQL can express, in DuckDB's SQL.

The others have models, a tokeniser, a parser of HTML or pseudo-random draws and are tested against brute force.
"""

_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), false)"

#: CRC-32 of the ASCII text s, bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, b: list_reduce([xor(x, b)] || range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"""

ORACLE: dict[str, str] = {
    "op1_topk_search": f"""
        WITH q AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE {_SOUND}),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op2_vector_dedup": f"""
        WITH RECURSIVE s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND {_SOUND} AND list_bool_or([x <> 0 FOR x IN embedding])),
             l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
             r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.w, r.root FROM r JOIN l ON r.id = l.u),
             c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE u = e.vec_id) AS n_links, component AS component_id, e.vec_id = component AS kept FROM embeddings e JOIN c ON id = vec_id""",
    "op8_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS n FROM p)
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 100 AND n > 1 THEN first END AS refers_to FROM f""",
    "op9_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] END) AS found FROM w),
             x AS (SELECT doc_id, len(found) AS n, unnest(found) AS shingle FROM s),
             l AS (SELECT a.doc_id AS u, b.doc_id AS w FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
             r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.w, r.root FROM r JOIN l ON r.id = l.u),
             c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
        SELECT doc_id, CAST(len(found) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM s JOIN c ON id = doc_id""",
    # runs as stretches of six words that come again, always as far away
    "op11_periodic_runs": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, CAST(doc_id AS VARCHAR) AS s FROM documents),
             h AS (SELECT doc_id, words, len(words) AS n, {_CRC32} AS h FROM d),
             g AS (SELECT doc_id, words, n, h % 10 = 0 AND n > 0 AS loops, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
             l AS (SELECT doc_id, n, CASE WHEN loops THEN words[:a] || [words[a + 1 + i % (1 + (n - a) // (3 + g % 8))] FOR i IN range(n - a)] ELSE words END AS words FROM g),
             t AS (SELECT doc_id, unnest(range(n)) AS i, unnest(words) AS word FROM l),
             x AS (SELECT doc_id, i, CASE WHEN count(*) OVER w = 6 THEN string_agg(word, ' ') OVER w END AS six FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
             p AS (SELECT a.doc_id, a.i, b.i - a.i AS period FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i),
             s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS stretch FROM p),
             r AS (SELECT doc_id, period, min(i) AS start, count(*) + 5 + period AS length FROM s GROUP BY doc_id, period, stretch),
             runs AS (SELECT doc_id, start, length, min(period) AS period FROM r WHERE length >= greatest(12, 2 * period) GROUP BY doc_id, start, length),
             best AS (SELECT doc_id, count(*) AS n_runs, max_by(start, (length, -start, -period)) AS start, max(length) AS length, max_by(period, (length, -start, -period)) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
             gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op12_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)),
             p AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n, length(regexp_replace(text, '(</?turn>|### )', '\\\1', 'g')) AS chars,
                       CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 ELSE 1 + length(url_encode(role)) END AS name FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             s AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS learned,
                       CAST(sum(chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 4 + name + 2 + 9 END) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM s""",
    "op13_structure_repair": f"""
        WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
             f AS (SELECT conv_id, turn, role, text, {_CRC32} % 20 AS f FROM b),
             d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
             o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
             g AS (SELECT *, left(role, 1) AS initial, left(lead(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS following, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM o),
             j AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM g),
             k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                       count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size FROM j GROUP BY conv_id),
             -- what is said last: nothing (-), s, u, a; one turn put in, or one of the conversation dealt with
             put(a, z) AS (VALUES ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
             puts AS (SELECT a, a AS z, 0 AS n FROM (VALUES ('-'), ('s'), ('u'), ('a')) v(a) UNION ALL SELECT a, z, 1 FROM put UNION ALL SELECT x.a, y.z, 2 FROM put x JOIN put y ON x.z = y.a WHERE x.a <> y.z),
             walk(conv_id, n, z, best) AS (
                 SELECT conv_id, CAST(0 AS BIGINT), '-', {{'cost': 0, 'audit': '', 'made': CAST([] AS VARCHAR[])}} FROM k
                 UNION ALL SELECT conv_id, n, z, min(best) FROM (
                     SELECT w.conv_id, w.n + 1 AS n, e.z, {{'cost': w.best.cost + 3 * p.n + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || repeat('I', p.n) || e.edit,
                         'made': w.best.made || [CASE WHEN (i = 1) = (p.a = 'u') THEN 'assistant:' ELSE 'user:' END FOR i IN range(1, 1 + p.n)] || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [CASE e.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text] END}} AS best
                     FROM walk w JOIN j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n + 1 JOIN puts p ON p.a = w.z
                     JOIN (SELECT a, z, 'R' AS edit, 3 AS cost FROM put UNION ALL SELECT a, z, 'K', 0 FROM put UNION ALL SELECT '-', 's', 'K', 0 UNION ALL SELECT a, a, 'D', 4 FROM (VALUES ('-'), ('s'), ('u'), ('a')) v(a)) e
                         ON e.a = p.z AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR j.initial = e.z)) GROUP BY conv_id, n, z),
             over AS (SELECT w.conv_id, min({{'cost': w.best.cost + 3 * p.n, 'audit': w.best.audit || repeat('I', p.n), 'made': w.best.made || [CASE WHEN (i = 1) = (p.a = 'u') THEN 'assistant:' ELSE 'user:' END FOR i IN range(1, 1 + p.n)]}}) AS best
                      FROM walk w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.size = w.n JOIN puts p ON p.a = w.z WHERE p.z IN ('-', 'a') GROUP BY w.conv_id),
             ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
        FROM ids LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN over ON over.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
