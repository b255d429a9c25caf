"""DuckDB SQL of the operators that need more than a few lines of it."""

from __future__ import annotations


def crc32(text: str) -> str:
    """An expression for the unsigned crc32 of an ASCII text: its bytes and eight shifts (-1) each, folded."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _enc(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _tree(name: str, rows: str, group: str) -> str:
    return f"""{name}(grp, lvl, pos, h, n) AS (
            SELECT {group}, 0, pos, h, count(*) OVER (PARTITION BY {group}) FROM {rows}
            UNION ALL
            SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3),
        {name}_runs AS (SELECT grp, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _step(runs: str, pos: str, order: str) -> str:
    return f"""{order} AS o, array_to_string({runs}.hs[1 : {pos} // pow(3, {runs}.lvl)::BIGINT % 3], '') AS l, array_to_string({runs}.hs[{pos} // pow(3, {runs}.lvl)::BIGINT % 3 + 2 :], '') AS r"""


MERKLE = f"""
        WITH RECURSIVE d AS (SELECT *, CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents),
        e AS (SELECT doc_id, source, sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("text")}) AS h,
                     sha256({_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} || {_enc("t")}) AS changed FROM d),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, changed) - 1 AS pos, row_number() OVER () AS rid FROM e),
        {_tree("low", "leaves", "source")},
        subs AS (SELECT grp AS source, h, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS pos FROM low WHERE n = 1),
        {_tree("top", "subs", "0")},
        steps AS (
            SELECT rid, {_step("low_runs", "leaves.pos", "low_runs.lvl")} FROM leaves JOIN low_runs ON low_runs.grp IS NOT DISTINCT FROM leaves.source AND run = leaves.pos // pow(3, low_runs.lvl + 1)::BIGINT
            UNION ALL
            SELECT rid, {_step("top_runs", "subs.pos", "1000 + top_runs.lvl")} FROM leaves JOIN subs ON subs.source IS NOT DISTINCT FROM leaves.source JOIN top_runs ON run = subs.pos // pow(3, top_runs.lvl + 1)::BIGINT),
        paths AS (SELECT rid, list(l || '|' || r ORDER BY o) AS p, string_agg(l || r, '' ORDER BY o) AS s FROM steps GROUP BY rid),
        done AS (SELECT leaves.doc_id, leaves.h AS leaf, subs.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(s, '')) AS proof_sha256,
                        list_reduce(list_prepend(changed, coalesce(p, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
                 FROM leaves JOIN subs ON subs.source IS NOT DISTINCT FROM leaves.source LEFT JOIN paths USING (rid))
        SELECT *, folded_root = root AS verified FROM done"""

PANES = f"""
        WITH a AS (SELECT click_id, ts, kind, value, epoch_us(arrived_at) // 86400000000 AS day FROM clicks WHERE ts IS NOT NULL),
        b AS (SELECT click_id, least(9, day % 10 + greatest(0, {crc32("click_id::VARCHAR")} % 30 - 23)) AS batch, epoch_us(ts) - (day - day % 10) * 86400000000 AS event,
                     coalesce(kind, 'none') AS kind, coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents FROM a),
        r AS (SELECT *, floor(event / 3600000000)::BIGINT AS hour FROM b QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY batch, event, kind, cents) = 1),
        m AS (SELECT batch, max(event) AS most FROM r GROUP BY batch),
        w AS (SELECT n AS batch, (SELECT max(most) FROM m WHERE m.batch < n) AS w FROM range(10) t(n)),
        s AS (SELECT r.*, coalesce(w >= (hour + 1) * 3600000000 + 172800000000, false) AS late FROM r JOIN w USING (batch)),
        p AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM s WHERE NOT late GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER v AS all_n, sum(c) OVER v AS all_c, min(batch) OVER (PARTITION BY kind, hour) AS first FROM p WINDOW v AS (PARTITION BY kind, hour ORDER BY batch)),
        e AS (SELECT t.*, (SELECT min(w.batch) FROM w WHERE w.batch >= t.first AND w >= (t.hour + 1) * 3600000000 + 43200000000) AS emitted FROM t),
        o AS (SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM s WHERE late
            UNION ALL SELECT any_value(emitted), hour, -1, sum(n), sum(c), 'emit', kind FROM e WHERE batch <= emitted GROUP BY kind, hour
            UNION ALL SELECT batch, hour, -1, all_n - n, all_c - c, 'retract', kind FROM e WHERE batch > emitted
            UNION ALL SELECT batch, hour, -1, all_n, all_c, 'replace', kind FROM e WHERE batch > emitted
            UNION ALL SELECT 9, hour, -1, sum(n), sum(c), 'final', kind FROM e WHERE emitted IS NULL GROUP BY kind, hour)
        SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM o"""

REPEATS = """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT doc_id, q, substr(x, 2 * q + 1, 700) AS y, length(x) // 2 - 100 AS last FROM d, LATERAL (SELECT unnest(range(0, length(x) // 2 - 99, 250)) AS q)),
        w AS (SELECT doc_id, q + i AS p, substr(y, 2 * i + 1, 200) AS s FROM c, range(250) r(i) WHERE q + i <= last),
        f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
        n AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS new FROM f WHERE again),
        g AS (SELECT doc_id, p, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM n),
        s AS (SELECT doc_id, g, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY ALL),
        t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list_prepend(0, list(b ORDER BY a)) AS froms, list(a ORDER BY a) AS untils FROM s GROUP BY doc_id),
        k AS (SELECT d.*, removed, spans, coalesce(froms, [0]) AS froms, list_append(coalesce(untils, []), length(x) // 2) AS untils FROM d LEFT JOIN t USING (doc_id))
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(x, 2 * froms[i] + 1, 2 * (untils[i] - froms[i]))), ''))) AS kept_sha256
        FROM k"""
