"""The same answers in DuckDB's SQL, for the queries of :mod:`capturelake.catalogue`."""

from __future__ import annotations

from capturelake.adapters import NOW
from capturelake.operators.classify import APPS, CATEGORIES

#: The archive that ``adapters.archive`` makes.
PREFIX = f"""
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT documents.*, quality, toxic,
        CASE lang WHEN 'en' THEN 'png' WHEN 'de' THEN 'jpg' WHEN 'fr' THEN 'webp' ELSE 'gif' END AS ext,
        {NOW} - ((doc_id % 700) * 90001 + (doc_id // 700) * 600) AS at_ts
      FROM documents LEFT JOIN lab USING (doc_id)),
captures AS (SELECT doc_id AS id, '/archive/' || source || '/shot_' || doc_id || '.' || ext AS path, 'shot_' || doc_id || '.' || ext AS filename,
        n_chars AS size, CASE WHEN n_chars % 13 <> 0 THEN at_ts END AS created_ts, at_ts + 5 AS modified_ts, 640 + n_chars % 1280 AS width, 480::BIGINT AS height,
        ext AS format, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS phash, CASE WHEN toxic = 1 THEN 'missing' ELSE 'available' END AS status,
        CASE WHEN n_chars < 400 THEN 'queued' ELSE 'done' END AS ocr_status, n_chars % 4 AS ocr_attempts, source AS app_name,
        lang || '.example.com' AS website_domain, lang AS category, coalesce(quality = 1, false) AS starred, '' AS note,
        coalesce(CASE WHEN n_chars % 13 <> 0 THEN at_ts END, at_ts + 5) AS ev
      FROM d),
ocr AS (SELECT doc_id AS id, text FROM documents WHERE n_chars >= 400),
tags AS (SELECT * FROM (VALUES (1, 'en'), (2, 'de'), (3, 'es'), (4, 'fr'), (6, 'quality 0'), (7, 'quality 1')) t(tag_id, name)),
links AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS tag_id FROM d
          UNION ALL SELECT doc_id, quality + 6 FROM d WHERE quality IS NOT NULL),
tagged AS (SELECT id, name FROM links JOIN tags USING (tag_id)),
collections AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS cid, source AS name FROM documents WHERE source IS NOT NULL),
items AS (SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS cid, doc_id AS id FROM d WHERE quality IS NOT NULL AND source IS NOT NULL),
live AS (SELECT * FROM captures WHERE status <> 'missing'),
avail AS (SELECT * FROM captures WHERE status = 'available')
"""
GRID = "id, path, filename, created_ts, width, height, format, status, ocr_status, content_hash, phash, starred"


def lib(sql: str, more: str = "") -> str:
    """A query over the archive; ``more``: further common tables."""
    return f"WITH {PREFIX}{',' + more if more else ''} {sql}"


def _sessions(source: str, gap: int) -> str:
    return f"""
    s1 AS (SELECT *, CASE WHEN ev - lag(ev) OVER (ORDER BY ev, id) <= {gap} THEN 0 ELSE 1 END AS f FROM {source}),
    s2 AS (SELECT *, sum(f) OVER (ORDER BY ev, id) AS s FROM s1),
    runs AS (SELECT s, min(ev) AS start_ts, max(ev) AS end_ts, count(*) AS n FROM s2 GROUP BY s HAVING count(*) > 1),
    member AS (SELECT s2.*, start_ts, end_ts, n, start_ts || '-' || end_ts AS key FROM s2 JOIN runs USING (s))"""


EVENTS = """ev AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS ev, event_type, user_id FROM events)"""


def events(sql: str, gap: int) -> str:
    return f"WITH {EVENTS}, {_sessions('ev', gap)} {sql}"


def tokens(column: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower(coalesce({column}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _count(column: str, unit: list[str]) -> str:
    if len(unit) == 1:
        return f"len(list_filter({column}, lambda w: w = '{unit[0]}'))"
    test = " AND ".join(f"{column}[i + {k}] = '{w}'" for k, w in enumerate(unit))
    return f"len(list_filter(range(1, len({column}) - {len(unit) - 2}), lambda i: {test}))"


_WEIGHTS = {"filename": 8, "text": 1, "tagtext": 12, "note": 4, "app_name": 6, "website_domain": 6}


def bm25(units: list[list[str]], where: str = "true", phrase: str | None = None) -> str:
    freq = ", ".join(f"CAST({' + '.join(f'{w} * {_count(f"t_{c}", u)}' for c, w in _WEIGHTS.items())} AS DOUBLE) AS f{i}" for i, u in enumerate(units))
    length = " + ".join(f"len(t_{c})" for c in _WEIGHTS)
    n = range(len(units))
    stats = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in n)
    idf = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS i{i}" for i in n)
    score = " + ".join(f"i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    boost = f"CASE WHEN contains(lower(text), '{phrase}') THEN 100 ELSE 0 END" if phrase else "0"
    tok = ", ".join(f"{tokens(c)} AS t_{c}" for c in _WEIGHTS)
    return lib(
        f"""SELECT id, round({score}, 6) AS score,
            round({score} + {boost} + CASE WHEN coalesce(created_ts, 0) >= {NOW - 7 * 86400} THEN 5 ELSE 0 END + CASE WHEN coalesce(created_ts, 0) >= {NOW - 30 * 86400} THEN 3 ELSE 0 END, 6) AS sort_key
            FROM fr, sc WHERE status <> 'missing' AND {' AND '.join(f'f{i} > 0' for i in n)} AND {where}""",
        f"""tt AS (SELECT id, string_agg(name, ' ' ORDER BY name) AS tagtext FROM tagged GROUP BY id),
        base AS (SELECT captures.*, ocr.text, tagtext FROM captures LEFT JOIN ocr USING (id) LEFT JOIN tt USING (id)),
        tk AS (SELECT *, {tok} FROM base),
        fr AS (SELECT *, {length} AS dl, {freq} FROM tk),
        st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM fr),
        sc AS (SELECT avgdl, {idf} FROM st)""",
    )


BITS = "bits AS (SELECT vec_id AS id, CAST(sum(CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (63 - i)) ELSE 0 END) AS BIGINT) AS bits FROM embeddings, range(1, 64) t(i) GROUP BY vec_id)"
_DUP = "dup AS (SELECT content_hash AS key, count(*) AS count, string_agg(id, ',' ORDER BY ev DESC, id DESC) AS ids, arg_max(id, (ev, id)) AS keep_id, arg_max(size, (ev, id)) AS keep_size FROM avail GROUP BY content_hash HAVING count(*) > 1)"
_APART = "bit_count(xor({a}.h[1], {b}.h[1])) + bit_count(xor({a}.h[2], {b}.h[2])) <= 8"
_NEAR = f"""hn AS (SELECT id, size, row_number() OVER (ORDER BY id) AS rn, [('0x' || substr(sha256((id // 6)::VARCHAR), 1, 8))::BIGINT, ('0x' || substr(sha256((id // 6)::VARCHAR), 9, 4) || substr(content_hash, 1, 4))::BIGINT] AS h FROM avail),
    hr(rn, reps) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, h BIGINT[])[] UNION ALL
        SELECT hn.rn, CASE WHEN len(list_filter(hr.reps, lambda s: {_APART.format(a='s', b='hn')})) > 0 THEN hr.reps ELSE list_append(hr.reps, {{'id': hn.id, 'h': hn.h}}) END FROM hr JOIN hn ON hn.rn = hr.rn + 1),
    hl AS (SELECT unnest(reps, recursive := true) FROM (SELECT reps FROM hr ORDER BY rn DESC LIMIT 1)),
    hm AS (SELECT hn.id, any_value(hn.size) AS size, min(hl.id) AS leader FROM hn JOIN hl ON {_APART.format(a='hn', b='hl')} AND hl.id <= hn.id GROUP BY hn.id),
    near AS (SELECT leader, count(*) AS n, sum(size) AS b FROM hm GROUP BY leader HAVING count(*) > 1)"""
_NOTEXT = "(ocr_status <> 'done' OR trim(coalesce(text, '')) = '')"
_FINGER = """tg AS (SELECT id, string_agg(name, ',' ORDER BY name) AS t FROM tagged GROUP BY id),
    cl AS (SELECT id, string_agg(cid::VARCHAR, ',' ORDER BY cid) AS c FROM items GROUP BY id),
    fp AS (SELECT content_hash, count(DISTINCT t || '|' || c || '|' || note || '|' || starred::INT || '|0') > 1 AS differs
           FROM avail LEFT JOIN tg USING (id) LEFT JOIN cl USING (id) GROUP BY content_hash)"""
_MODES = """modes AS (SELECT cid, kind, arg_min(v, (-k, v)) AS v FROM (
        SELECT cid, 'app' AS kind, app_name AS v, count(*) AS k FROM mem WHERE app_name IS NOT NULL GROUP BY ALL
        UNION ALL SELECT cid, 'cat', category, count(*) FROM mem WHERE category IS NOT NULL GROUP BY ALL
        UNION ALL SELECT cid, 'dom', website_domain, count(*) FROM mem WHERE website_domain IS NOT NULL GROUP BY ALL) GROUP BY cid, kind)"""
_PROFILE = f"""mem AS (SELECT cid, id, app_name, category, website_domain, phash FROM
        (SELECT items.cid, avail.*, row_number() OVER (PARTITION BY items.cid ORDER BY id) AS rn FROM items JOIN avail USING (id)) WHERE rn <= 300),
    {_MODES}"""
_WHOLE = f"mem AS (SELECT cid, id, app_name, category, website_domain, phash FROM items JOIN avail USING (id)), {_MODES}"
_UNFILED = "unfiled AS (SELECT * FROM avail WHERE id NOT IN (SELECT id FROM items))"


def _category_words(words: dict[str, tuple[str, ...]]) -> str:
    cases = ", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + f") AS h_{c}" for c, ws in words.items())
    best = "greatest(" + ", ".join(f"h_{c}" for c in words) + ")"
    pick = "CASE " + " ".join(f"WHEN h_{c} = {best} AND h_{c} > 0 THEN '{c}'" for c in words) + " END"
    return f"SELECT id, {pick} AS category, CAST(CASE WHEN {best} > 0 THEN round(least(0.9, 0.55 + 0.1 * {best}), 2) ELSE 0.0 END AS DOUBLE) AS confidence FROM (SELECT id, {cases} FROM (SELECT doc_id AS id, lower(coalesce(source, '')) || chr(10) || lower(coalesce(lang, '')) || chr(10) || lower(coalesce(text, '')) AS t FROM documents))"


def _apps_and_categories() -> str:
    """``classify.classify`` with its own lists; a name is null where a part of it is."""
    app = "CASE " + " ".join(f"WHEN contains(n, '{w}') OR contains(t, '{w}') THEN '{a}'" for w, a in APPS) + " END"
    url = lambda s: rf"""contains(raw, '{s}') AND contains(regexp_replace(regexp_extract(raw, '{s}([^/\s<>\"''()\[\]{{}}]*)', 1), '^www\.', ''), '.')"""
    domain = rf"({url('https://')}) OR ({url('http://')}) OR regexp_matches(t, 'www\.[a-z0-9-]*\.')"
    texts = "SELECT doc_id AS id, coalesce(text, '') AS raw, lower(coalesce(text, '')) AS t, lower(source || chr(10) || lang) AS n FROM documents"
    return f"""WITH c AS ({_category_words(dict(CATEGORIES))}), a AS (SELECT id, {app} AS app, {domain} AS has_domain FROM ({texts}))
        SELECT id, app, category, CASE WHEN category IS NULL AND (app IS NOT NULL OR has_domain) THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM a JOIN c USING (id)"""


def _fill() -> str:
    """(id, size, old, app, category) of captures ``t`` by the reference's lists."""
    app = "CASE " + " ".join(f"WHEN contains(n, '{w}') OR contains(t, '{w}') THEN '{a}'" for w, a in APPS) + " END"
    cases = ", ".join("(" + " + ".join(f"contains(n || chr(10) || t, '{w}')::INT" for w in ws) + f") AS h_{c}" for c, ws in CATEGORIES)
    best = "greatest(" + ", ".join(f"h_{c}" for c, _ in CATEGORIES) + ")"
    pick = "CASE " + " ".join(f"WHEN h_{c} = {best} AND h_{c} > 0 THEN '{c}'" for c, _ in CATEGORIES) + " END"
    return f"found AS (SELECT id, size, old, {app} AS app, {pick} AS category FROM (SELECT *, {cases} FROM t))"


_FILL = _fill()
#: Words that occur in the driver's texts, by category.
CORPUS_WORDS = {"legal": ("license", "copyright", "rights"), "secret": ("token", "password", "key"), "english": ("that", "with", "this"), "german": ("und", "der", "nicht")}

SQL: dict[str, str] = {
    "grid_page": lib(f"SELECT {GRID} FROM live ORDER BY ev DESC, id DESC LIMIT 60"),
    "all_ids": lib("SELECT id FROM live"),
    "library_stats": lib("""SELECT count(*) AS total, count_if(status = 'available')::BIGINT AS available, count_if(status = 'missing')::BIGINT AS missing, count_if(starred)::BIGINT AS starred,
        0::BIGINT AS ocr_none, count_if(ocr_status = 'queued')::BIGINT AS ocr_queued, 0::BIGINT AS ocr_processing, count_if(ocr_status = 'done')::BIGINT AS ocr_done, 0::BIGINT AS ocr_failed,
        min(created_ts) AS oldest, max(created_ts) AS newest, 0::BIGINT AS problems FROM captures"""),
    "timeline_months": lib("SELECT year(t)::BIGINT AS year, month(t)::BIGINT AS month, strftime(t, '%Y-%m') AS key, count(*) AS count FROM (SELECT make_timestamp(ev * 1000000) AS t FROM live) GROUP BY ALL"),
    "timeline_days": lib("SELECT strftime(t, '%Y-%m-%d') AS date, count(*) AS count FROM (SELECT make_timestamp(ev * 1000000) AS t FROM live) WHERE strftime(t, '%Y-%m') = '2026-08' GROUP BY ALL"),
    "timeline_items": lib("SELECT id, path FROM live WHERE strftime(make_timestamp(ev * 1000000), '%Y-%m-%d') = '2026-08-20'"),
    "exact_dup_groups": lib("SELECT 'exact' AS kind, key, count, ids FROM dup", _DUP),
    "exact_reclaim": lib("SELECT key, count, ((count - 1) * keep_size)::BIGINT AS reclaim_bytes, keep_id, differs AS metadata_warning FROM dup JOIN fp ON key = content_hash", f"{_DUP}, {_FINGER}"),
    "metadata_differs": lib("SELECT content_hash, differs FROM fp", _FINGER),
    "keep_newest": lib("SELECT avail.id, content_hash FROM avail JOIN dup ON content_hash = key WHERE avail.id <> keep_id", _DUP),
    "path_by_hash": lib("SELECT content_hash, arg_min(path, id) AS path FROM avail GROUP BY content_hash"),
    "hamming_pairs": f"WITH {BITS} SELECT a.id AS lo, b.id AS hi, bit_count(xor(a.bits, b.bits))::BIGINT AS d FROM bits a JOIN bits b ON a.id < b.id WHERE bit_count(xor(a.bits, b.bits)) <= 20",
    "similar_groups": f"""WITH RECURSIVE {BITS}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM bits),
        r(rn, reps) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, bits BIGINT)[] UNION ALL
            SELECT n.rn, CASE WHEN len(list_filter(r.reps, lambda s: bit_count(xor(s.bits, n.bits)) <= 16)) > 0 THEN r.reps ELSE list_append(r.reps, {{'id': n.id, 'bits': n.bits}}) END
            FROM r JOIN n ON n.rn = r.rn + 1),
        reps AS (SELECT unnest(reps, recursive := true) FROM (SELECT reps FROM r ORDER BY rn DESC LIMIT 1)),
        lead AS (SELECT n.id, min(reps.id) AS leader FROM n JOIN reps ON bit_count(xor(n.bits, reps.bits)) <= 16 AND reps.id <= n.id GROUP BY n.id)
        SELECT leader AS key, count(*) AS count, string_agg(id, ',' ORDER BY id) AS ids FROM lead GROUP BY leader""",
    "bursts": events("SELECT key, start_ts, end_ts, any_value(n) AS count FROM member GROUP BY ALL", 300),
    "burst_themes": events(
        """SELECT m.key, any_value(n) AS count, any_value(c.v) AS top_category, any_value(a.v) AS top_app, any_value(t.v) AS top_tags,
        string_agg(CASE WHEN rn <= 4 THEN 'h' || id END, ',' ORDER BY rn) AS previews
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ev DESC, id DESC) AS rn FROM member) m
        JOIN (SELECT key, arg_min(event_type, (-k, event_type)) AS v FROM (SELECT key, event_type, count(*) AS k FROM member GROUP BY ALL) GROUP BY key) c USING (key)
        JOIN (SELECT key, arg_min(u, (-k, u)) AS v FROM (SELECT key, 'user' || user_id AS u, count(*) AS k FROM member GROUP BY ALL) GROUP BY key) a USING (key)
        JOIN (SELECT key, string_agg('is ' || event_type, ',' ORDER BY k DESC, event_type) AS v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k DESC, event_type) AS q FROM (SELECT key, event_type, count(*) AS k FROM member GROUP BY ALL)) WHERE q <= 3 GROUP BY key) t USING (key)
        GROUP BY m.key""",
        300,
    ),
    "burst_items": f"WITH {EVENTS} SELECT id FROM ev WHERE ev BETWEEN 1704240000 AND 1704326400",
    "burst_membership": lib("SELECT id, key FROM member WHERE status = 'available'", _sessions("live", 1800)),
    "search_words": bm25([["that"], ["with"]], phrase="that with"),
    "search_phrase": bm25([["of", "the"]], phrase="of the"),
    "search_mixed": bm25([["and"], ["is", "the"]], "starred AND lower(format) = 'png'", phrase="is the"),
    "search_filters": lib(f"SELECT id FROM live WHERE contains(lower(app_name), 'src1') AND lower(format) = 'png' AND ev >= {(20454) * 86400} AND contains(lower(website_domain), 'example')"),
    "search_member": lib("SELECT id FROM live WHERE starred AND id IN (SELECT id FROM tagged WHERE contains(name, 'quality')) AND id IN (SELECT id FROM items JOIN collections USING (cid) WHERE contains(name, 'src1')) AND id IN (SELECT id FROM ocr WHERE length(trim(text)) > 0)"),
    "search_dir": lib("SELECT id FROM live WHERE starts_with(lower(path), '/archive/src1/') AND id NOT IN (SELECT id FROM ocr WHERE length(trim(text)) > 0)"),
    "is_duplicate": lib("SELECT id FROM live WHERE content_hash IN (SELECT content_hash FROM captures GROUP BY 1 HAVING count(*) > 1)"),
    "search_total": lib(f"SELECT count(*) AS total FROM live WHERE ev < {20514 * 86400}"),
    "list_tags": lib("SELECT name, count(*) AS count FROM tagged GROUP BY name"),
    "tag_texts": lib("SELECT id AS screenshot_id, string_agg(name, ' ' ORDER BY name) AS tags FROM tagged GROUP BY id"),
    "list_collections": lib("SELECT c.cid AS id, c.name, 'manual' AS kind, count(live.id) AS item_count FROM collections c LEFT JOIN items USING (cid) LEFT JOIN live ON live.id = items.id GROUP BY ALL"),
    "collection_items": lib("SELECT id FROM live WHERE id IN (SELECT id FROM items WHERE cid = 4)"),
    "collections_of": lib("SELECT items.id AS screenshot_id, cid AS id, collections.name FROM items JOIN collections USING (cid)"),
    "capture_detail": lib("SELECT c.id, path, category, length(text) AS text_chars, tags FROM captures c LEFT JOIN ocr USING (id) LEFT JOIN (SELECT id, string_agg(name, ',' ORDER BY lower(name)) AS tags FROM tagged GROUP BY id) USING (id)"),
    "unfiled": lib("SELECT id FROM unfiled", _UNFILED),
    "proposals": lib(
        """SELECT key, replace(replace(key, 'app:', ''), chr(31) || 'dom:', ' · ') || ' · ' || n AS name, n AS member_count, members FROM
        (SELECT 'app:' || app_name || chr(31) || 'dom:' || website_domain AS key, count(*) AS n, string_agg(CASE WHEN rn <= 200 THEN id END, ',' ORDER BY id) AS members
         FROM (SELECT *, row_number() OVER (PARTITION BY app_name, website_domain ORDER BY id) AS rn FROM unfiled) GROUP BY app_name, website_domain HAVING count(*) >= 3)
        ORDER BY n DESC, key LIMIT 8""",
        _UNFILED,
    ),
    "coverage": lib("SELECT count(*) AS suggested_count, min(id) AS first_suggested_id FROM unfiled WHERE app_name IN (SELECT app_name FROM avail JOIN items USING (id))", _UNFILED),
    "collection_profiles": lib(
        """SELECT m.cid, any_value(k.name) AS name, count(*) AS members, any_value(a.v) AS top_app, any_value(c.v) AS top_category, any_value(d2.v) AS top_domain, any_value(t.tags) AS tags
        FROM mem m JOIN collections k USING (cid) LEFT JOIN modes a ON a.cid = m.cid AND a.kind = 'app' LEFT JOIN modes c ON c.cid = m.cid AND c.kind = 'cat' LEFT JOIN modes d2 ON d2.cid = m.cid AND d2.kind = 'dom'
        LEFT JOIN (SELECT cid, string_agg(DISTINCT name, ',' ORDER BY name) AS tags FROM mem JOIN tagged USING (id) GROUP BY cid) t ON t.cid = m.cid GROUP BY m.cid""",
        _PROFILE,
    ),
    "suggest_collections": lib(
        """SELECT id, cid, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS rank FROM (
          SELECT p.id, p.cid, any_value(k.name) AS name, sum(points)::BIGINT AS score FROM (
            SELECT id, modes.cid, 3 AS points FROM avail JOIN modes ON kind = 'app' AND v = app_name
            UNION ALL SELECT id, modes.cid, 2 FROM avail JOIN modes ON kind = 'cat' AND v = category
            UNION ALL SELECT id, modes.cid, 2 FROM avail JOIN modes ON kind = 'dom' AND v = website_domain
            UNION ALL SELECT a.id, b.cid, least(3, count(DISTINCT a.name)) FROM (SELECT id, name FROM tagged JOIN avail USING (id)) a JOIN (SELECT DISTINCT cid, name FROM mem JOIN tagged USING (id)) b USING (name) GROUP BY a.id, b.cid
            UNION ALL SELECT DISTINCT a.id, b.cid, 2 FROM member a JOIN (SELECT DISTINCT cid, key FROM mem JOIN member USING (id)) b USING (key) WHERE a.status = 'available'
            UNION ALL SELECT DISTINCT avail.id, b.cid, 2 FROM avail JOIN mem b ON b.phash = avail.phash) p
          JOIN collections k USING (cid) WHERE (p.id, p.cid) NOT IN (SELECT (id, cid) FROM items) GROUP BY p.id, p.cid) WHERE score >= 4) WHERE rank <= 3""",
        f"{_WHOLE}, {_sessions('live', 1800)}",
    ),
    "suggest_tags": lib(
        """SELECT id, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS rank FROM (
          SELECT id, name, sum(points)::BIGINT AS score FROM (
            SELECT id, name, CASE kind WHEN 'dom' THEN 1 ELSE 2 END AS points FROM avail JOIN tmode ON (kind = 'app' AND v = app_name) OR (kind = 'cat' AND v = category) OR (kind = 'dom' AND v = website_domain))
          WHERE (id, name) NOT IN (SELECT (id, name) FROM tagged) GROUP BY id, name) WHERE score >= 3) WHERE rank <= 3""",
        """ta AS (SELECT name, avail.* FROM tagged JOIN avail USING (id)),
        tmode AS (SELECT name, kind, arg_min(v, (-k, v)) AS v FROM (SELECT name, 'app' AS kind, app_name AS v, count(*) AS k FROM ta WHERE app_name IS NOT NULL GROUP BY ALL
          UNION ALL SELECT name, 'cat', category, count(*) FROM ta WHERE category IS NOT NULL GROUP BY ALL UNION ALL SELECT name, 'dom', website_domain, count(*) FROM ta WHERE website_domain IS NOT NULL GROUP BY ALL) GROUP BY name, kind)""",
    ),
    "cleanup_overview": lib(
        f"""SELECT count(*) AS total_count, coalesce(sum(size), 0)::BIGINT AS total_bytes, count_if(ev < {NOW - 365 * 86400})::BIGINT AS old_count, coalesce(sum(CASE WHEN ev < {NOW - 365 * 86400} THEN size END), 0)::BIGINT AS old_bytes,
        count_if(size >= 5000000)::BIGINT AS large_count, coalesce(sum(CASE WHEN size >= 5000000 THEN size END), 0)::BIGINT AS large_bytes, count_if({_NOTEXT})::BIGINT AS notext_count, coalesce(sum(CASE WHEN {_NOTEXT} THEN size END), 0)::BIGINT AS notext_bytes,
        (SELECT count(*) FROM dup) AS exact_groups, (SELECT coalesce(sum(count), 0)::BIGINT FROM dup) AS exact_count, (SELECT coalesce(sum((count - 1) * keep_size), 0)::BIGINT FROM dup) AS exact_reclaim_bytes,
        (SELECT count(*) FROM near) AS near_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM near) AS near_count, (SELECT coalesce(sum(b), 0)::BIGINT FROM near) AS near_candidate_bytes,
        (SELECT count(*) FROM runs) AS burst_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM runs) AS burst_count, (SELECT coalesce(sum(size), 0)::BIGINT FROM member WHERE status = 'available') AS burst_bytes
        FROM avail LEFT JOIN ocr USING (id)""",
        f"{_DUP}, {_sessions('live', 1800)}, {_NEAR}",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "cleanup_old": lib(f"SELECT id, size FROM avail WHERE ev < {NOW - 90 * 86400} ORDER BY ev, id LIMIT 200"),
    "cleanup_notext": lib(f"SELECT id, size FROM avail LEFT JOIN ocr USING (id) WHERE {_NOTEXT} ORDER BY size DESC, id DESC LIMIT 200"),
    "cleanup_ids": lib(f"SELECT id FROM avail WHERE ev < {NOW - 365 * 86400}"),
    "cleanup_totals": lib(f"SELECT count(*) AS total, coalesce(sum(size), 0)::BIGINT AS bytes FROM avail WHERE ev < {NOW - 730 * 86400}"),
    "selection_bytes": lib("SELECT coalesce(sum(size), 0)::BIGINT AS bytes FROM captures WHERE id IN (SELECT doc_id FROM labels)"),
    "delete_outcomes": lib("SELECT id, CASE WHEN status = 'missing' OR quality IS NULL THEN 'already_missing' WHEN quality = 1 THEN 'trashed' ELSE 'failed' END AS outcome FROM captures JOIN d ON doc_id = id"),
    "deleted_records": lib("SELECT c.id AS screenshot_id, c.filename, c.size, c.starred, coalesce(t.j, '[]') AS tags_json, coalesce(k.j, '[]') AS collections_json, length(coalesce(text, '')) AS text_chars FROM captures c JOIN lab ON doc_id = c.id LEFT JOIN ocr USING (id) LEFT JOIN (SELECT id, '[' || string_agg('\"' || name || '\"', ',' ORDER BY name) || ']' AS j FROM tagged GROUP BY id) t USING (id) LEFT JOIN (SELECT id, '[' || string_agg('\"' || name || '\"', ',' ORDER BY name) || ']' AS j FROM items JOIN collections USING (cid) GROUP BY id) k USING (id)"),
    "deleted_search": lib("SELECT c.id AS screenshot_id FROM captures c JOIN lab ON doc_id = c.id LEFT JOIN ocr USING (id) WHERE contains(lower(filename), 'the') OR contains(lower(coalesce(text, '')), 'the') ORDER BY c.id DESC LIMIT 200"),
    "fingerprint_changed": lib("SELECT path FROM captures JOIN d ON doc_id = id WHERE status <> 'available' OR quality IS NOT NULL"),
    "upsert_merge": lib("SELECT id, path, CASE WHEN quality = 0 THEN size + 1 ELSE size END AS size, CASE WHEN quality = 0 THEN 'available' ELSE status END AS status, CASE WHEN quality = 0 THEN 'queued' ELSE ocr_status END AS ocr_status FROM captures JOIN d ON doc_id = id"),
    "restore_by_hash": lib(
        "SELECT a.id, '/moved' || b.path AS path FROM z a JOIN z b ON a.content_hash = b.content_hash AND a.rn = b.pn",
        "z AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS rn, row_number() OVER (PARTITION BY content_hash ORDER BY '/moved' || path) AS pn FROM captures WHERE status = 'missing')",
    ),
    "ocr_claimable": lib("SELECT id FROM avail WHERE ocr_status IN ('none', 'queued') AND ocr_attempts < 3"),
    "ocr_transition": lib("""SELECT id, CASE WHEN o = 'done' THEN 'done' WHEN o = 'missing' THEN 'queued' WHEN o = 'failed' THEN CASE WHEN ocr_attempts + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE ocr_status END AS ocr_status,
        ocr_attempts + CASE WHEN o = 'failed' THEN 1 ELSE 0 END AS ocr_attempts, CASE WHEN o = 'missing' THEN 'missing' ELSE status END AS status
        FROM (SELECT captures.*, CASE WHEN captures.status = 'available' AND ocr_status = 'queued' AND ocr_attempts < 3 THEN CASE WHEN quality IS NULL THEN 'done' WHEN quality = 1 THEN 'failed' ELSE 'missing' END ELSE '' END AS o FROM captures JOIN d ON doc_id = id)"""),
    "rename_plan": lib("""SELECT id, path AS old_path, regexp_replace(path, '/[^/]*$', '') || '/' || app_name || '_' || strftime(make_timestamp(ev * 1000000), '%Y-%m-%d') || '_' || lpad(rn::VARCHAR, greatest(3, length(rn::VARCHAR))::INT, '0') || '.' || format AS new_path, 'ok' AS status
        FROM (SELECT *, row_number() OVER (ORDER BY ev, id) AS rn FROM avail) UNION ALL SELECT id, path, '', 'skipped' FROM captures WHERE status <> 'available'"""),
    "rename_clashes": lib("""SELECT id, regexp_replace(path, '/[^/]*$', '') || '/' || app_name || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.' || format AS new_path, CASE WHEN k <= 100 THEN 'ok' ELSE 'conflict' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY app_name, format ORDER BY ev DESC, id) AS k FROM avail) WHERE k <= 100
        UNION ALL SELECT id, regexp_replace(path, '/[^/]*$', '') || '/' || app_name || '.' || format, 'conflict' FROM (SELECT *, row_number() OVER (PARTITION BY app_name, format ORDER BY ev DESC, id) AS k FROM avail) WHERE k > 100"""),
    "classify_url": "SELECT page_id AS id, url AS found_url, lower(regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www\\.', '')) AS found_domain FROM pages",
    "classify_www": "SELECT page_id AS id, nullif(regexp_extract(lower(html), 'www\\.[a-z0-9-]*\\.[a-z0-9.-]*'), '') AS found_domain FROM pages",
    "classify_category": _category_words(CORPUS_WORDS),
    "classify_reference": _category_words(dict(CATEGORIES)),
    "classify_apps": _apps_and_categories(),
    "thumbnails": lib(
        """SELECT id, '/cache/' || substr(content_hash, 1, 2) || '/' || content_hash || '_256.png' AS thumbnail, CASE WHEN w = 0 THEN 256 ELSE greatest(1, round(w * 256.0::DOUBLE / greatest(w, height))) END::BIGINT AS t_width,
        CASE WHEN w = 0 THEN 256 ELSE greatest(1, round(height * 256.0::DOUBLE / greatest(w, height))) END::BIGINT AS t_height FROM (SELECT *, size % 700 AS w FROM captures)"""
    ),
    "safe_names": r"""SELECT p_partkey AS id, CASE WHEN upper(split_part(n, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN n || '_' ELSE n END AS safe, lower(p_name) AS folded
        FROM (SELECT *, regexp_replace(regexp_replace(p_type || ':' || p_name, '[<>:"/\\|?*]', '_', 'g'), '[ .]+$', '') AS n FROM part)""",
    "last_events": "SELECT user_id AS id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id",
    "hash_text": "SELECT doc_id AS id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS phash FROM documents",
    "rename_stop": lib(
        f"""SELECT id, regexp_replace(path, '/[^/]*$', '') || '/' || day || '.' || format AS new_path, CASE WHEN row_number() OVER (PARTITION BY app_name, day, format ORDER BY id) = 1 THEN 'ok' ELSE 'conflict' END AS status,
        row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT *, strftime(make_timestamp(ev * 1000000), '%Y-%m-%d') AS day FROM avail)
        UNION ALL SELECT id, '', 'skipped', -1 FROM captures WHERE status <> 'available'"""
    ),
    "rename_full": lib(
        """SELECT id, '/all/all' || CASE WHEN k BETWEEN 2 AND 100 THEN '-' || k ELSE '' END || '.' || format AS new_path, CASE WHEN k <= 100 THEN 'ok' ELSE 'conflict' END AS status, place
        FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY lower(filename), id) AS k, row_number() OVER (ORDER BY lower(filename), id) - 1 AS place FROM avail)
        UNION ALL SELECT id, '', 'skipped', -1 FROM captures WHERE status <> 'available'"""
    ),
    "rename_by_collection": lib(
        """SELECT avail.id, regexp_replace(path, '/[^/]*$', '') || '/' || coalesce(n, '') || '-' || filename AS new_path, 'ok' AS status FROM avail
        LEFT JOIN (SELECT id, min(name) AS n FROM items JOIN collections USING (cid) GROUP BY id) k USING (id) UNION ALL SELECT id, '', 'skipped' FROM captures WHERE status <> 'available'"""
    ),
    "rename_reconciled": lib(
        """SELECT id, CASE WHEN quality = 1 THEN '/new' || path ELSE path END AS path, CASE WHEN quality = 0 AND size % 2 = 1 THEN 'missing' ELSE status END AS status,
        CASE WHEN quality = 1 THEN 'new' WHEN size % 2 = 0 THEN 'old' ELSE 'missing' END AS outcome FROM (SELECT c.*, d.quality FROM captures c JOIN d ON doc_id = id) WHERE quality IS NOT NULL"""
    ),
    "search_dates": lib(
        f"""SELECT words, (SELECT count(*) FROM live WHERE ev >= a AND (b IS NULL OR ev < b)) AS total FROM (SELECT words, a::BIGINT AS a, b::BIGINT AS b FROM (VALUES
        ('today', epoch(day), NULL), ('yesterday', epoch(day - 1), epoch(day)), ('this week', epoch(day - 6), epoch(day + 1)), ('last week', epoch(day - 13), epoch(day - 6)),
        ('this month', epoch(date_trunc('month', day)), epoch(date_trunc('month', day) + INTERVAL 1 MONTH)), ('last month', epoch(date_trunc('month', day - 30)), epoch(date_trunc('month', day - 30) + INTERVAL 1 MONTH)),
        ('this year', epoch(date_trunc('year', day)), epoch(date_trunc('year', day) + INTERVAL 1 YEAR)), ('last year', epoch(date_trunc('year', day - 365)), epoch(date_trunc('year', day - 365) + INTERVAL 1 YEAR)),
        ('in march', epoch(make_date(year(day), 3, 1)), epoch(make_date(year(day), 4, 1))), ('from december', epoch(make_date(year(day) - 1, 12, 1)), epoch(make_date(year(day), 1, 1)))) t(words, a, b))""",
        f"now AS (SELECT make_timestamp({NOW}::BIGINT * 1000000)::DATE AS day)",
    ).replace("FROM (VALUES", "FROM now, LATERAL (VALUES"),
    "search_after_edits": bm25([["fresh"], ["with"]], phrase="fresh with").replace("FROM tagged GROUP BY id", "FROM (SELECT id, name FROM tagged UNION ALL SELECT doc_id, 'Fresh' FROM d WHERE quality = 1) GROUP BY id"),
    "index_tokens": lib(
        "SELECT token, count(*) AS n FROM (SELECT DISTINCT id, unnest(list_concat(" + ", ".join(f"t_{c}" for c in _WEIGHTS) + ")) AS token FROM tk) GROUP BY token",
        f"""tt AS (SELECT id, string_agg(name, ' ' ORDER BY name) AS tagtext FROM tagged GROUP BY id),
        base AS (SELECT captures.*, ocr.text, tagtext FROM captures LEFT JOIN ocr USING (id) LEFT JOIN tt USING (id)),
        tk AS (SELECT id, {", ".join(f"{tokens(c)} AS t_{c}" for c in _WEIGHTS)} FROM base)""",
    ),
    "search_page": f"SELECT id, score FROM ({bm25([['that'], ['with']], phrase='that with')}) JOIN (SELECT doc_id AS id, CASE WHEN n_chars % 13 <> 0 THEN {NOW} - ((doc_id % 700) * 90001 + (doc_id // 700) * 600) END AS created_ts FROM documents) USING (id) ORDER BY sort_key DESC, created_ts DESC NULLS LAST, id DESC LIMIT 60 OFFSET 60",
    "similar_captures": f"""WITH RECURSIVE {PREFIX}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS rn, [('0x' || substr(content_hash, i, 1))::INT FOR i IN [1, 5, 9, 13]] AS h FROM avail),
        r(rn, reps) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, h INT[])[] UNION ALL
            SELECT n.rn, CASE WHEN len(list_filter(r.reps, lambda s: bit_count(xor(s.h[1], n.h[1])) + bit_count(xor(s.h[2], n.h[2])) + bit_count(xor(s.h[3], n.h[3])) + bit_count(xor(s.h[4], n.h[4])) <= 1)) > 0 THEN r.reps ELSE list_append(r.reps, {{'id': n.id, 'h': n.h}}) END FROM r JOIN n ON n.rn = r.rn + 1),
        reps AS (SELECT unnest(reps, recursive := true) FROM (SELECT reps FROM r ORDER BY rn DESC LIMIT 1)),
        lead AS (SELECT n.id, min(reps.id) AS leader FROM n JOIN reps ON bit_count(xor(n.h[1], reps.h[1])) + bit_count(xor(n.h[2], reps.h[2])) + bit_count(xor(n.h[3], reps.h[3])) + bit_count(xor(n.h[4], reps.h[4])) <= 1 AND reps.id <= n.id GROUP BY n.id)
        SELECT 'similar' AS kind, leader AS key, count(*) AS count, string_agg(id, ',' ORDER BY id) AS members FROM lead GROUP BY leader HAVING count(*) > 1""",
    "filled_captures": f"""WITH {PREFIX}, t AS (SELECT c.id, c.size, c.category AS old, lower(c.filename) || chr(10) || lower(c.path) AS n, lower(coalesce(text, '')) AS t FROM captures c LEFT JOIN ocr USING (id)), {_FILL}
        SELECT id, app, CASE WHEN size % 2 = 0 THEN old ELSE category END AS category FROM found""",
    "tags_after_edits": lib("SELECT name, count(*) AS count FROM (SELECT name, id FROM tagged UNION SELECT 'Fresh', (SELECT min(id) FROM captures) UNION SELECT 'en', (SELECT min(id) FROM captures)) GROUP BY name"),
    "collections_after_edits": lib("""SELECT CASE WHEN c.cid = 1 THEN 'First' ELSE c.name END AS name, count(live.id) AS item_count FROM collections c LEFT JOIN items USING (cid) LEFT JOIN live ON live.id = items.id WHERE c.cid <> 2 GROUP BY c.cid, c.name
        UNION ALL SELECT 'Kept', count(live.id) FROM d JOIN live ON live.id = doc_id WHERE quality = 1 AND doc_id <> (SELECT min(doc_id) FROM d WHERE quality = 1)"""),
    "flags_after_edits": lib("SELECT id, starred OR id = (SELECT min(id) FROM captures) AS starred, id = (SELECT min(id) FROM captures) AS read_later, CASE WHEN id = (SELECT min(id) FROM captures) THEN 'a note' ELSE '' END AS note FROM captures"),
    "trashed_and_restored": lib("""SELECT id, CASE WHEN quality = 1 THEN 'available' WHEN quality = 0 THEN 'missing' ELSE status END AS status, CASE WHEN quality = 1 THEN 'restored' WHEN quality = 0 THEN 'failed' END AS outcome,
        coalesce(quality IS NOT NULL AND status <> 'missing', false) AS kept FROM (SELECT c.*, d.quality FROM captures c JOIN d ON doc_id = id)"""),
    "problems_listed": lib("SELECT path, 'unreadable' AS kind FROM captures JOIN d ON doc_id = id WHERE quality IS NOT NULL"),
    "apply_events": lib("""SELECT path, CASE WHEN quality = 0 THEN 'missing' WHEN quality = 1 THEN 'available' ELSE status END AS status, CASE WHEN quality = 1 THEN 'queued' ELSE ocr_status END AS ocr_status, true AS known FROM (SELECT c.*, d.quality FROM captures c JOIN d ON doc_id = id)
        UNION ALL SELECT '/fresh' || path, 'available', 'queued', true FROM captures JOIN d ON doc_id = id WHERE quality = 1 AND size % 2 = 0"""),
    "stream_sessions": f"""WITH {EVENTS}, {_sessions('ev', 300)}, last AS (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) AS w FROM events)
        SELECT start_ts, end_ts, n AS count FROM runs, last WHERE (end_ts + 300) * 1000000 <= w - w % 1000""",
    "display_names": """SELECT p_partkey AS id, CASE WHEN lower(file[:16]) = 'screenshot from ' THEN file[17:] ELSE file END AS shown, CASE WHEN p_partkey % 7 = 0 THEN mark || p_partkey ELSE trim(p_name) END AS title FROM (
        SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'Screenshot from ' WHEN p_partkey % 3 = 0 THEN 'screenshot FROM ' WHEN p_partkey % 5 = 0 THEN 'Screenshot-from ' ELSE '' END || replace(p_name, ' ', CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE '_' END) || '.png' AS file,
            CASE WHEN p_partkey % 11 = 0 THEN chr(160) || '·' || chr(9) ELSE ' · ' END AS mark FROM part)""",
}
_REFUSED = " AND NOT (p.cid = (SELECT min(cid) FROM collections) AND p.id IN (SELECT doc_id FROM d WHERE quality = 0))"
_BY_HAND = SQL["suggest_collections"].replace("NOT IN (SELECT (id, cid) FROM items)", "NOT IN (SELECT (id, cid) FROM items)" + _REFUSED)
_NO_EN = SQL["suggest_tags"].replace("NOT IN (SELECT (id, name) FROM tagged)", "NOT IN (SELECT (id, name) FROM tagged) AND name <> 'en'")
SQL["suggest_not_dismissed"] = f"SELECT id, 'collection' AS kind, name, rank FROM ({_BY_HAND}) UNION ALL SELECT id, 'tag', name, rank FROM ({_NO_EN})"
