"""DuckDB SQL for the corpus queries that SQL can express."""

_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, row_number() OVER () AS i, {_WORDS} AS w FROM benchmark),
        bs AS (
            SELECT DISTINCT item_id, i, least(len(w), 5) AS n, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM b WHERE len(w) > 0)
        ),
        ds AS (
            SELECT DISTINCT doc_id, r, n, array_to_string(w[p:p + n - 1], ' ') AS s
            FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)
        ),
        sizes AS (SELECT i, count(*) AS n_shingles FROM bs GROUP BY i),
        hits AS (SELECT doc_id, r, item_id, i, count(*) AS n_found FROM ds JOIN bs USING (n, s) GROUP BY ALL)
        SELECT doc_id, item_id, n_found, n_shingles, n_found / n_shingles AS containment
        FROM hits JOIN sizes USING (i) WHERE n_found >= 0.8 * n_shingles - 1e-9
    """,
    "op8_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND nth = 1 AS kept, text_sha256
        FROM (
            SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t, doc_id) AS nth
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        )
    """,
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS x FROM d),
        f AS (
            SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
                        WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ),
        p AS (SELECT *, t[1:a] AS pre, t[a + 1:b] AS mid, t[b + 1:] AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op13_importance_resampling": r"""
        WITH RECURSIVE crc(i, c, k) AS (
            SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
        ),
        rest AS (SELECT list(c ORDER BY i) AS r FROM crc WHERE k = 8),
        dw AS (
            SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        de AS (SELECT n, unnest(w) AS word FROM dw),
        known AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM de UNION SELECT word FROM bw)),
        hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM known, rest
        ),
        s AS (SELECT bucket, count(*) AS s FROM de JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
        total AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS all_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS all_t),
        gain AS (
            SELECT b AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
            FROM range(10000) r(b) CROSS JOIN total LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
        ),
        weight AS (SELECT n, sum(gain)::BIGINT AS weight FROM de JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY n),
        scored AS (
            SELECT n, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM dw LEFT JOIN weight USING (n)
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM placed
    """,
}
