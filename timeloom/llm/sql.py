"""SQL of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from timeloom.llm import licenses, pii
from timeloom.llm.resample import Resampling


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences_sql() -> str:
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in licenses.SENTENCES.items())
    cut = "string_split(regexp_replace(text, '([.!?;:])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10))"
    inner = """SELECT d.doc_id, coalesce(k.ids, []) AS ids, coalesce(u.n_unknown, 0) AS n_unknown
        FROM docs d LEFT JOIN (SELECT r, list(id ORDER BY i, j) AS ids FROM kept GROUP BY r) k USING (r) LEFT JOIN unknown u USING (r)"""
    query = f"SELECT *, '|' || array_to_string(list_transform(ids, lambda x: x || '|'), '|') AS left_over, []::VARCHAR[] AS found FROM ({inner})"
    for name, parts in licenses.RULES:
        seq = _quoted(licenses._sequence(parts))
        query = f"""SELECT doc_id, ids, n_unknown, replace(left_over, {seq}, '|') AS left_over,
            CASE WHEN contains(left_over, {seq}) THEN list_append(found, {_quoted(name)}) ELSE found END AS found FROM ({query})"""
    return f"""WITH known(s, id) AS (VALUES {known}),
        docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        likely AS (SELECT r, regexp_replace(text, {_quoted(licenses.MARK)}, '\\1', 'g') AS text FROM docs WHERE regexp_matches(lower(coalesce(text, '')), {_quoted(licenses.STEMS)})),
        cut AS (SELECT r, unnest({cut}) AS line, generate_subscripts({cut}, 1) AS place FROM likely),
        lines AS MATERIALIZED (SELECT r, w, stem, row_number() OVER (PARTITION BY r ORDER BY place) AS n
            FROM (SELECT r, place, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS w, regexp_matches(lower(line), {_quoted(licenses.STEMS)}) AS stem FROM cut) WHERE w <> ''),
        texts AS (SELECT r, list(w ORDER BY n) AS ws FROM lines GROUP BY r),
        runs AS MATERIALIZED (SELECT r, i, j, id FROM
            (SELECT r, n AS i, j, regexp_replace(array_to_string(ws[n:j], ' '), {_quoted(licenses.SUBJECT)}, '', 'g') AS s
             FROM (SELECT l.r, n, ws, unnest(range(n, least(len(ws), n + {max(s.count(" ") for s in licenses.SENTENCES) + 5}) + 1)) AS j FROM lines l JOIN texts USING (r) WHERE regexp_matches(w, {_quoted(licenses.FIRST)})))
            JOIN known USING (s)),
        kept AS (SELECT * FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND y.i <= x.i AND y.j >= x.j AND y.j - y.i > x.j - x.i)),
        unknown AS (SELECT r, count(*) AS n_unknown FROM lines l WHERE stem AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.r = l.r AND k.i <= l.n AND l.n <= k.j) GROUP BY r)
        SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, n_unknown FROM ({query})"""


def pii_sql(rule: pii.Disclosure = pii.Disclosure()) -> str:
    """Base spans by the patterns, then the words near them that reveal them, and both written as spans."""
    plain = {k: p.replace("++", "+").replace(r"\x20", " ") for k, p in pii.PATTERNS.items()}
    kinds = []
    for k, kind in enumerate(pii.KINDS):
        p = _quoted(plain[kind])
        kinds.append(f"""SELECT doc_id, {k} AS kind, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY n) - length(hit))::BIGINT AS s
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, {p})) AS hit, unnest(regexp_split_to_array(text, {p})[:len(regexp_extract_all(text, {p}))]) AS gap,
                  generate_subscripts(regexp_extract_all(text, {p}), 1) AS n FROM docs WHERE regexp_matches(text, {p}))""")
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) % 10 = 0"
    names = "['email', 'ip', 'card', 'phone', 'term']"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        raw AS ({" UNION ALL ".join(kinds)}),
        base AS (SELECT doc_id, kind, s, s + length(hit) AS e, lower(hit) AS entity
            FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM raw)
            WHERE CASE kind WHEN 0 THEN true
                WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: coalesce(try_cast(x AS BIGINT) <= 255, false)))
                WHEN 2 THEN length(d) BETWEEN 13 AND 19 AND {luhn} ELSE length(d) BETWEEN 9 AND 15 END),
        windows AS (SELECT b.doc_id, b.entity, b.s AS span, b.kind, greatest(0, b.s - {rule.near}) AS f, b.e + {rule.near} >= length(text) AS at_end,
                substring(text, (greatest(0, b.s - {rule.near}) + 1)::BIGINT, (b.e + {rule.near} - greatest(0, b.s - {rule.near}))::BIGINT) AS w
            FROM base b JOIN docs USING (doc_id)),
        hits AS (SELECT doc_id, entity, span, kind, f, at_end, length(w) AS width, unnest(regexp_extract_all(w, '[\\p{{L}}]{{4,}}')) AS hit,
                unnest(regexp_split_to_array(w, '[\\p{{L}}]{{4,}}')[:len(regexp_extract_all(w, '[\\p{{L}}]{{4,}}'))]) AS gap, generate_subscripts(regexp_extract_all(w, '[\\p{{L}}]{{4,}}'), 1) AS n
            FROM windows WHERE regexp_matches(w, '[\\p{{L}}]{{4,}}')),
        placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind, span ORDER BY n) - length(hit) AS pos FROM hits),
        near AS (SELECT DISTINCT doc_id, entity, lower(hit) AS term, (f + pos)::BIGINT AS s, (f + pos + length(hit))::BIGINT AS e FROM placed
            WHERE (pos > 0 OR f = 0) AND (pos + length(hit) < width OR at_end)),
        clear AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b.s < n.e AND n.s < b.e)),
        together AS (SELECT entity, term, count(DISTINCT doc_id) AS n_both FROM clear GROUP BY ALL HAVING count(DISTINCT doc_id) >= {rule.support}),
        entities AS (SELECT entity, count(DISTINCT doc_id) AS n_entity FROM base GROUP BY ALL),
        words AS (SELECT term, count(DISTINCT doc_id) AS n_term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS term FROM docs)
            WHERE term IN (SELECT term FROM together) GROUP BY ALL),
        total AS (SELECT (count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL))::DOUBLE AS n_docs FROM docs),
        revealing AS (SELECT entity, term FROM together JOIN entities USING (entity) JOIN words USING (term), total
            WHERE n_docs > n_entity AND log2(n_both * n_docs / (n_term * n_entity)) / log2(n_docs / n_entity) >= {rule.generalise}),
        every AS (SELECT doc_id, kind, s, e FROM base UNION ALL SELECT DISTINCT doc_id, 4, s, e FROM clear JOIN revealing USING (entity, term)),
        joined AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
                string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < 4) AS b,
                string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans FROM every GROUP BY doc_id)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
            sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (doc_id)"""


def jaccard_sql(shingle: int = 4, percent: int = 85) -> str:
    """Sets of shingles, all pairs with one in common, and the closure of the links."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    run = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(shingle))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {letters}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {run}) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x) m USING (doc_id)"""


def embeddings_sql(threshold: float = 0.9) -> str:
    """All pairs by their cosine in double precision, and the closure of the links."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {threshold}),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
        k AS (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x), m AS (SELECT x AS vec_id, min(y) AS least FROM r GROUP BY x),
        f AS (SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id FROM embeddings LEFT JOIN k USING (vec_id) LEFT JOIN m USING (vec_id))
        SELECT *, vec_id = component_id AS kept FROM f"""


def resample_sql(rule: Resampling = Resampling()) -> str:
    """Words by a pattern, crc32 of each distinct one byte by byte, gains of buckets, and the global order by score."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    byte = "list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH crc(t) AS MATERIALIZED (SELECT {table}),
        docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
        wanted AS (SELECT unnest(regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
        runs AS (SELECT r, unnest(words) AS word FROM docs),
        hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {rule.buckets} AS bucket
            FROM (SELECT word FROM runs UNION SELECT word FROM wanted), crc),
        source AS (SELECT bucket, count(*) AS s FROM runs JOIN hashed USING (word) GROUP BY bucket),
        target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(s), 0) + {rule.buckets} FROM source) / ((s + 1)::DOUBLE * (SELECT coalesce(sum(t), 0) + {rule.buckets} FROM target))))::BIGINT AS gain
            FROM source LEFT JOIN target USING (bucket)),
        weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
        scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{rule.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM docs LEFT JOIN weights USING (r)),
        ranked AS (SELECT *, CASE WHEN n_features >= {rule.least} AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_features >= {rule.least} AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features DESC) END AS place FROM scored)
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
            CASE WHEN place <= {rule.percent} * (SELECT count(place) FROM ranked) // 100 THEN place END AS rank FROM ranked"""
