"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, langid, mixing, pii, quality, simhash, tokencount, topk, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_decontam": decontam.op4_decontam,
    "op5_simhash": simhash.op5_simhash,
    "op6_langid": langid.op6_langid,
    "op7_chat": chat.op7_chat,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_tokens": tokencount.op10_tokens,
}

SQL = {
    "op1_topk": """
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.rid, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
          FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.rid <> c.rid)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10""",
    "op7_chat": """
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(9 + length(role) + length(text)
            + length(role || text) - length(translate(role || text, '\\<[', '')) + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id, own""",
    "op8_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
}

# Texts of SQL for rows that other SQL builds on.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _langid_sql(top: int) -> str:
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, coalesce({_CRC} % 3 = 1, false) AS held FROM documents),
        s AS (SELECT rid, lang, held, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS s FROM d WHERE regexp_matches(text, '\p{{L}}')),
        p AS (SELECT rid, lang, held, s, unnest(range(1, length(s) + 1)) AS i FROM s),
        g AS (SELECT rid, lang, held, unnest([substr(s, i, 1), CASE WHEN i < length(s) THEN substr(s, i, 2) END, CASE WHEN i < length(s) - 1 AND substr(s, i + 1, 1) <> ' ' THEN substr(s, i, 3) END]) AS g FROM p),
        c AS (SELECT rid, lang, held, g, count(*) AS n, unicode(g) + CASE WHEN length(g) > 1 THEN unicode(substr(g, 2)) * 2097152 ELSE 0 END + CASE WHEN length(g) > 2 THEN unicode(substr(g, 3)) * 4398046511104 ELSE 0 END AS code
          FROM g WHERE g IS NOT NULL AND g <> ' ' GROUP BY rid, lang, held, g),
        own AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, code) AS r FROM c QUALIFY r <= {top}),
        prof AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) AS r FROM (SELECT lang, g, code, sum(n) AS n FROM c WHERE NOT held AND lang IS NOT NULL GROUP BY 1, 2, 3) QUALIFY r <= {top}),
        far AS (SELECT rid, l.lang, sum(coalesce(abs(own.r - prof.r), {top})) AS far, count(*) AS n FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof ON prof.lang = l.lang AND prof.g = own.g GROUP BY 1, 2),
        best AS (SELECT rid, lang, 1 - far::DOUBLE / ({top} * n) AS score FROM far QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, lang) = 1)
        SELECT doc_id, held AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN best USING (rid)"""


def _decontam_sql() -> str:
    span, matched, slip = decontam.SPAN, decontam.MATCHED, decontam.SLIP
    masks = ", ".join("'" + str(m) + ":' || " + " || ' ' || ".join(f"w[p + {k + 1}]" for k, x in enumerate(mask) if x == "1") for m, mask in enumerate(decontam.MASKS))
    seeds = lambda t: f"SELECT id, p, unnest([{masks}]) AS seed FROM (SELECT id, w, unnest(range(0, len(w) - {span} + 1)) AS p FROM {t} WHERE len(w) >= {span})"
    return f"""
        WITH d AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), b AS (SELECT item_id AS id, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        ds AS ({seeds('d')}), bs AS ({seeds('b')}),
        h AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS start FROM ds JOIN bs USING (seed)),
        t AS (SELECT h.*, d.w AS dw, b.w AS bw, unnest(range(0, len(b.w))) AS i FROM h JOIN d ON d.id IS NOT DISTINCT FROM doc_id JOIN b ON b.id = item_id),
        e AS (SELECT doc_id, item_id, start, i, (dw[start + i + 1] = bw[i + 1])::INT AS eq FROM t WHERE start + i >= 0 AND start + i < len(dw)),
        c AS (SELECT *, sum(CASE WHEN eq = 1 THEN 1 ELSE -{slip} END) OVER w AS s, sum(eq) OVER w AS n FROM e WINDOW w AS (PARTITION BY doc_id, item_id, start ORDER BY i)),
        x AS (SELECT z.doc_id, z.item_id, z.start, a.i AS i0, z.i AS i1, z.s - a.s + 1 AS s, z.n - a.n + 1 AS n FROM c a JOIN c z ON a.doc_id IS NOT DISTINCT FROM z.doc_id AND a.item_id = z.item_id AND a.start = z.start AND a.i <= z.i AND a.eq = 1 AND z.eq = 1),
        best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, start ORDER BY s DESC, i1, i0 DESC) = 1),
        one AS (SELECT * FROM best WHERE n >= {matched} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, n DESC, start + i0, i0, i1 DESC) = 1)
        SELECT doc_id, item_id, n::BIGINT AS n_equal, (i1 - i0 + 1)::BIGINT AS n_aligned, (start + i0)::BIGINT AS doc_start, i0::BIGINT AS item_start FROM one"""


def _mixing_sql() -> str:
    weights, block = mixing.WEIGHTS, mixing.BLOCK
    given = ", ".join(f"('{s}', {w})" for s, w in weights.items())
    known = ", ".join(f"'{s}'" for s in weights if s != mixing.OTHER)
    return f"""
        WITH RECURSIVE r AS (SELECT doc_id, source, CASE WHEN source IN ({known}) THEN source ELSE '{mixing.OTHER}' END AS mix_class, md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM documents),
        n AS (SELECT mix_class, count(*) AS rows FROM r GROUP BY 1),
        w AS (SELECT mix_class, w, rows, row_number() OVER (ORDER BY mix_class) AS i FROM (VALUES {given}) v(mix_class, w) JOIN n USING (mix_class)),
        a AS (SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS q FROM w),
        e AS (SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS had, 0::BIGINT AS pick FROM a
          UNION ALL SELECT slot + 1, list_transform(had, lambda h, i: h + (i = p)::BIGINT), p FROM (
            SELECT slot, had, q, list_min(list_transform(ws, lambda x, i: CASE WHEN had[i] < x AND had[i] * q // x <= slot THEN ((had[i] + 1) * q + x - 1) // x * 100000 + i ELSE 9000000000000000 END)) % 100000 AS p
            FROM e, a WHERE slot < q)),
        s AS (SELECT slot - 1 AS slot, pick AS i, had[pick] - 1 AS k FROM e WHERE pick > 0),
        m AS (SELECT doc_id, source, mix_class, i, w, row_number() OVER (PARTITION BY mix_class ORDER BY key, doc_id) - 1 AS n FROM r JOIN w USING (mix_class)),
        o AS (SELECT m.*, n // {block} AS block, n // {block} // w * q + s.slot AS slot FROM m CROSS JOIN a JOIN s ON s.i = m.i AND s.k = n // {block} % w),
        z AS (SELECT min(nb // w * q + s.slot) AS until FROM (SELECT i, w, (rows + {block} - 1) // {block} AS nb FROM w) b CROSS JOIN a JOIN s ON s.i = b.i AND s.k = nb % w)
        SELECT doc_id, source, mix_class, block::BIGINT AS block, slot::BIGINT AS slot, slot < until AS in_target, row_number() OVER (ORDER BY slot, n) - 1 AS position FROM o, z"""


SQL |= {"op4_decontam": _decontam_sql(), "op6_langid": _langid_sql(langid.TOP), "op9_mixing": _mixing_sql()}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
