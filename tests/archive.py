"""Small archives for tests."""

from capturelake.schemas import Library, empty

NOW = 1788350400


def library(spark, shots, text=(), tags=(), collections=(), feedback=()) -> Library:
    """``shots``: dicts with id at least; ``text``: (id, text); ``tags``: (id, name); ``collections``: (name, ids)."""
    base = {"filename": None, "size": 0, "created_ts": None, "modified_ts": None, "width": 10, "height": 10, "format": "png", "content_hash": None, "phash": None, "status": "available", "ocr_status": "none", "ocr_attempts": 0, "app_name": None, "website_domain": None, "url": None, "category": None, "starred": False, "read_later": False, "note": ""}
    rows = []
    for s in shots:
        r = {"path": f"/a/{s['id']}.png", **base, **s}
        r["filename"] = r["filename"] or r["path"].rpartition("/")[2]
        rows.append(r)
    names = ["id", "path", *base]
    kinds = {"id": "long", "size": "long", "created_ts": "long", "modified_ts": "long", "width": "long", "height": "long", "ocr_attempts": "long", "starred": "boolean", "read_later": "boolean"}
    captures = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    ids = {n: i for i, n in enumerate(dict.fromkeys(n for _, n in tags), 1)}
    return empty(
        spark,
        captures=captures,
        ocr_text=spark.createDataFrame(list(text), "screenshot_id long, text string"),
        tags=spark.createDataFrame([(i, n) for n, i in ids.items()], "id long, name string"),
        screenshot_tags=spark.createDataFrame([(s, ids[n]) for s, n in tags], "screenshot_id long, tag_id long"),
        collections=spark.createDataFrame([(i, n) for i, (n, _) in enumerate(collections, 1)], "id long, name string"),
        collection_items=spark.createDataFrame([(i, s) for i, (_, members) in enumerate(collections, 1) for s in members], "collection_id long, screenshot_id long"),
        feedback=spark.createDataFrame([(i, *f) for i, f in enumerate(feedback, 1)], "id long, screenshot_id long, target string, action string"),
    )


def ids(df, column="id"):
    return [r[column] for r in df.collect()]
