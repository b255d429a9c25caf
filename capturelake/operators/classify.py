"""Enrichment: app, URL, domain and category of a capture from its name, path and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import url_and_domain
from capturelake.schemas import Library

# Words that give an app away, in order of precedence, and words of each category.
APPS = (
    ("google chrome", "chrome"), ("chrome.exe", "chrome"), ("chrome", "chrome"), ("chromium", "chromium"), ("firefox", "firefox"),
    ("safari", "safari"), ("microsoft edge", "edge"), ("msedge", "edge"), ("edge", "edge"), ("brave", "brave"), ("opera", "opera"),
    ("visual studio code", "vscode"), ("vscode", "vscode"), ("neovim", "neovim"), ("vim", "vim"), ("emacs", "emacs"),
    ("intellij", "intellij"), ("pycharm", "pycharm"), ("sublime", "sublime"), ("iterm", "iterm2"), ("gnome-terminal", "terminal"),
    ("konsole", "terminal"), ("powershell", "powershell"), ("windows terminal", "terminal"), ("terminal", "terminal"),
    ("slack", "slack"), ("discord", "discord"), ("telegram", "telegram"), ("whatsapp", "whatsapp"), ("signal", "signal"),
    ("zoom", "zoom"), ("microsoft teams", "teams"), ("teams", "teams"), ("google meet", "meet"), ("webex", "webex"),
    ("thunderbird", "thunderbird"), ("outlook", "outlook"), ("apple mail", "mail"), ("gmail", "gmail"),
    ("github desktop", "github-desktop"), ("github", "github"), ("gitlab", "gitlab"), ("stackoverflow", "stackoverflow"),
    ("youtube", "youtube"), ("netflix", "netflix"), ("spotify", "spotify"), ("steam", "steam"), ("notion", "notion"),
    ("obsidian", "obsidian"), ("figma", "figma"), ("photoshop", "photoshop"), ("gimp", "gimp"), ("libreoffice", "libreoffice"),
    ("microsoft word", "word"), ("google docs", "docs"), ("microsoft excel", "excel"), ("google sheets", "sheets"),
    ("finder", "finder"), ("file explorer", "explorer"), ("nautilus", "files"), ("dolphin", "dolphin"),
)
CATEGORIES = (
    ("code", ("traceback", "exception", "null pointer", "segfault", "compiler", "pull request", "merge conflict", "localhost", "stack overflow", "import ", "def ", "fn ", "cargo", "npm", "git ")),
    ("finance", ("invoice", "receipt", "payment", "refund", "balance", "transaction", "bank", "tax", "payroll", "order total")),
    ("communication", ("inbox", "re:", "fwd:", "meeting", "slack", "discord", "telegram", "message", "unread", "attachment")),
    ("docs", ("resume", "curriculum vitae", "contract", "report", "memo", "minutes", "agenda", "proposal", "manuscript")),
    ("media", ("youtube", "netflix", "episode", "season", "playlist", "spotify", "video", "subtitle")),
    ("social", ("tweet", "retweet", "follower", "reddit", "upvote", "instagram", "facebook", "linkedin", "like")),
    ("shopping", ("cart", "checkout", "order", "shipping", "discount", "coupon", "price", "amazon")),
)


def app_of(name: Column, text: Column, apps=APPS) -> Column:
    """The first app in order whose word is in either text (both in lower case)."""
    return F.coalesce(*(F.when(F.contains(name, F.lit(w)) | F.contains(text, F.lit(w)), F.lit(app)) for w, app in apps))


def category_of(text: Column, categories=CATEGORIES) -> Column:
    """Struct of category and hits: most distinct words, the earlier category on ties; null without any."""
    hits = [sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) for _, words in categories]
    best = F.greatest(*(F.struct(h.alias("hits"), F.lit(-i).alias("place"), F.lit(c).alias("category")) for i, ((c, _), h) in enumerate(zip(categories, hits, strict=True))))
    return F.when(best["hits"] > 0, best)


def classify(df: DataFrame, filename: str = "filename", path: str = "path", text: str = "text", apps=APPS, categories=CATEGORIES) -> DataFrame:
    """``df`` with found_app, found_url, found_domain, found_category and found_confidence."""
    name = F.lower(F.concat(F.col(filename), F.lit("\n"), F.col(path)))
    body = F.coalesce(F.col(text), F.lit(""))
    url, domain = url_and_domain(body)
    df = df.withColumns({"_name": name, "_text": F.lower(body), "found_url": url, "found_domain": domain})
    df = df.withColumns({"found_app": app_of(F.col("_name"), F.col("_text"), apps), "_best": category_of(F.concat("_name", F.lit("\n"), "_text"), categories)})
    sure = F.when(F.col("_best").isNotNull(), F.least(F.lit(0.9), F.lit(0.55) + F.lit(0.1) * F.col("_best.hits")))
    some = F.when(F.col("found_app").isNotNull() | F.col("found_domain").isNotNull(), 0.5).otherwise(0.0)
    return df.withColumns({"found_category": F.col("_best.category"), "found_confidence": F.coalesce(sure, some)}).drop("_name", "_text", "_best")


def apply_classification(lib: Library) -> tuple[Library, DataFrame]:
    """Fills what is null in captures; also one row of counts: examined, updated."""
    names = {"app_name": "found_app", "website_domain": "found_domain", "url": "found_url", "category": "found_category"}
    open_ = F.lit(False)
    for c in names:
        open_ = open_ | F.col(c).isNull()
    text = lib.ocr_text.select(F.col("screenshot_id").alias("_id"), F.col("text").alias("_ocr"))
    found = classify(lib.captures.join(text, F.col("id") == F.col("_id"), "left"), text="_ocr")
    changed = F.lit(False)
    for c, f in names.items():
        changed = changed | (F.col(c).isNull() & F.col(f).isNotNull())
    new = F.col("category").isNull() & F.col("found_category").isNotNull()
    columns = {c: F.coalesce(c, f) for c, f in names.items()} | {"category_confidence": F.when(new, F.col("found_confidence")).otherwise(F.col("category_confidence"))}
    counts = found.agg(F.count_if(open_).alias("examined"), F.count_if(open_ & changed).alias("updated"))
    return lib.with_(captures=found.withColumns(columns).select(*lib.captures.columns)), counts
