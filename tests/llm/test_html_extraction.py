import pytest

from capturelake.llm import html_extraction as he


def text(page, noise=()):
    return he.main_text(page, "h", noise)


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><!-- <p>hidden</p> -->
    <main><article><header><h1>A &amp; B</h1><time>May</time></header><p>One <b>bold<br>text.<p>Two&nbsp;&copy;   words</p><aside>Side</aside><form><p>Send</p></form>
    <div class="comments"><p>First!</p></div><ul><li>x<li>y</ul><footer>By me</footer></article></main>
    <div id="sidebar-2"><p>More</p></div><div role="alert">Cookies</div><footer>End</footer></body></html>"""
    assert text(page) == "A & B\n\nOne bold text.\n\nTwo © words\n\nx\n\ny"


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>a &am", "a &am"), ("<p>a</p><p cla", "a"), ("1 < 2 <p>x", "1 < 2\n\nx"),
    ("<P>A</P>", "A"), ("<p>a <span hidden>x <b>y</b></span>b</p>", "a b"), ("<p title='a>b'>c</p>", "c"), ("<script>x", ""), ("<p>a</span>b</div></p>", "ab"), ("<p>a</p></>b", "a\n\nb"), ("<p hidden>a</p>b", "b"),
    ("<td>a<td>b", "a\n\nb"), ("<p>a <b title=\"x>b</b> c</p>", "a b c"), ("<div>x" * 2000, "\n\n".join(["x"] * 2000)), ("<p>a<br/>b<hr>c", "a b\n\nc"), ("<div>" * 3000 + "deep", "deep"), ("<p>" + "x " * 50_000 + "</p>", ("x " * 50_000).strip()),
])
def test_odd_pages(page, want):
    assert text(page) == want


def site(n):
    return [(i, "https://site.org/a", f"<body><div class=xa><p>Same notice of law</p></div><div class=xb><p>Story {i} is of {i * 7} things</p><p>And {i * 13} more</p></div><div class=xc><p>{['Join us', 'Call us'][i % 2]}</p></div></body>") for i in range(n)]


def test_tree_removes_what_all_pages_share(spark):
    pages = spark.createDataFrame(site(40), "page_id long, url string, html string")
    got = {r.page_id: r for r in he.page_texts(pages).collect()}
    for i in range(40):
        want = f"Story {i} is of {i * 7} things\n\nAnd {i * 13} more"
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    tree = he.style_tree(pages).collect()
    assert all(0 <= r.composite <= 1 for r in tree) and any(r.noise for r in tree) and not all(r.noise for r in tree)


def test_nodes_by_join_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame(site(40) + [(99, None, "<p>x"), (99, None, "<p>x")], "page_id long, url string, html string")
    want = sorted(map(tuple, he.page_texts(pages).collect()), key=str)
    monkeypatch.setattr(he, "BROADCAST_NODES", 1)
    assert sorted(map(tuple, he.page_texts(pages).collect()), key=str) == want


def test_few_or_copied_pages_lose_nothing(spark):
    copies = [(i, "http://c.org", "<body><div><p>One story told here.</p></div></body>", 1) for i in range(9)] + [(10, None, None, 1), (11, "bad://[", "<p>t</p>", 1)]
    got = {r.page_id: r.text for r in he.page_texts(spark.createDataFrame(copies, "page_id long, url string, html string, text int")).collect()}
    assert got == {**{i: "One story told here." for i in range(9)}, 10: "", 11: "t"}
    assert he.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("wrapper", ["page has-sidebar", "widget Blog", "post-with-comments", "comments", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_article_in_a_wrapper_counts(wrapper, tag):
    assert text(f'<div class="{wrapper}"><{tag}><h1>T</h1><p>Story</p></{tag}></div><footer>End</footer>') == "T\n\nStory"


def test_classes_never_leave_nothing():
    assert text('<div class="widget"><p>Story</p></div><nav>Home</nav>') == "Story"
    assert text('<p>Story</p><div class="widget"><p>Aside</p></div>') == "Story"
    assert text('<article>Story</article><div class="comments"><article>First!</article></div>') == "Story"


def test_tree_reopens_wrappers(spark):
    pages = [(i, "https://w.org/a", f"<body><p>Notice</p><div class=widget><p>Story {i} of {i * 7}</p></div><div class=sidebar><b>Join us</b></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in he.page_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} of {i * 7}" for i in range(20)}


def test_noise_goes_whatever_its_share(spark, monkeypatch):
    law = "The same long notice of law that stands on each page of this host. " * 5
    pages = [(i, "https://s.org/a", f"<body><div class=xa><p>{law}</p></div><div class=xb><p>Story {i}</p></div></body>") for i in range(20)]
    pages += [(100 + i, "https://s.org/b", f"<body><!-- {i} --><script>n={i}</script><div class=xb><p>Told again and again {i % 2}</p></div></body>") for i in range(60)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {**{i: f"Story {i}" for i in range(20)}, **{100 + i: f"Told again and again {i % 2}" for i in range(60)}}
    assert {r.page_id: r.text for r in he.page_texts(pages).collect()} == want
    monkeypatch.setattr(he, "BROADCAST_NODES", 1)
    assert {r.page_id: r.text for r in he.page_texts(pages).collect()} == want


def test_copies_differ_in_markup_only():
    key = he.copy_key("<p>One  story</p><script>a=1</script><!-- x", "h")
    assert key == he.copy_key("<div id='7'>One story<br></div><style>p{}", "h")
    assert key != he.copy_key("<p>One story", "g") and key != he.copy_key("<p>One < two story", "h")


@pytest.mark.parametrize("most", [500_000, 1])
def test_repeated_texts_in_articles_go(spark, monkeypatch, most):
    monkeypatch.setattr(he, "BROADCAST_NODES", most)
    rare = lambda i: "<p>Seen now and then</p>" if i < 8 else ""
    pages = [(i, "https://a.org/a", f"<article><h1>Story {i}</h1><p>It is {i * 7}</p>{rare(i)}<p>Subscribe to our letter</p><ul><li>Share</ul></article>") for i in range(20)]
    got = {r.page_id: r.text for r in he.page_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join([f"Story {i}", f"It is {i * 7}"] + ["Seen now and then"] * (i < 8)) for i in range(20)}


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "audio", "video", "iframe", "noscript", "template"])
def test_embedded_elements_cut_nothing_else(tag):
    for page in (f"<p>a<{tag} x=1 /> b</p><p>c</p>", f"<p>a<{tag} x='>'> b</p><p>c</p>", f"<p>a<{tag} /> b</p><p>c<{tag}>no<p>no</{tag}></p>"):
        assert text(f"<article>{page}</article>") == "a b\n\nc"
    assert text(f"<p>a<{tag}><p>no</p></p>no<b>no</{tag}>b</p><p>c") in ("a b\n\nc", "a\n\nb\n\nc")
    assert text(f"<p>a<{tag}>b</p><p>c</p><{tag}>no</{tag}><p>d") in ("a b\n\nc\n\nd", "a\n\nc\n\nd")


def test_raw_text_runs_to_its_end():
    assert text("<p>a<script>if (x < 1) '<svg>' </p></script>b<!-- <svg> --><p>c<textarea><p>no") == "a b\n\nc"


def test_deep_elements_close_what_they_opened():
    deep = "<div>" * 600 + "deep" + "</div>" * 600
    assert text(f"<div><article><p>a</p>{deep}<p>rest</p></article><p>no</p></div>") == "a\n\ndeep\n\nrest"
    assert text("<div>" * 600 + "<nav>no</nav><p>a</p><footer>no</footer>") == "a"
    assert text("<p>no</p>" + "<div>" * 600 + "<article>a</article>b") == "a"
    styles = he.parse("<body>" + "<div>" * 3000 + "x", "h", with_styles=True)[1]
    assert len(styles) == he.DEPTH == len(he.parse("<div>" * 3000 + "x", "h")[0][0].chain)


def test_deep_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    assert text("<p><button>" * 20_000 + "<div>" * 20_000 + "<p>x" * 20_000) == ""
    assert time.process_time() - began < 20


def plain_tree(pages):
    """Importances of every node, from single pages, by the formulas of the module's docstring."""
    import math
    from collections import Counter, defaultdict

    on, contents, styles, chains, hosts = Counter(), defaultdict(lambda: defaultdict(list)), defaultdict(Counter), {}, {}
    for url, page in pages:
        host = he.host_of(url)
        if not host or not page:
            continue
        blocks, own = he.parse(page, host, with_styles=True)
        root = he._child(0, host)
        here = Counter((b.chain[-1], c) for b in blocks for c in (b.text, *b.links[1]))
        for (leaf, c), n in here.items():
            contents[leaf][c].append(n)
        for b in blocks:
            chains[b.chain[-1]] = (root, *b.chain)
            hosts[b.chain[-1]] = root
        for node, style in own:
            styles[node][style] += 1
        for node in {root, *(n for b in blocks for n in b.chain), *(n for n, _ in own)}:
            on[node] += 1
    share = lambda h, m: max(0.0, min(1.0, h / math.log(m)))
    entropy = lambda counts: -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)
    m = {n: k for n, k in on.items() if k >= he.MIN_PAGES}
    content = {n: 1 - share(sum(entropy(c) for c in contents[n].values()) / len(contents[n]), m[n]) for n in m if n in contents}
    out = {}
    for node in m:
        below = [leaf for leaf in content if node in chains[leaf][1:]]
        if not below:
            continue
        mean = sum(m[x] * content[x] for x in below) / sum(m[x] for x in below)
        look = share(entropy(list(styles[node].values())), m[node]) if node in styles else None
        fade = he.DECAY ** len(styles[node]) if node in styles else he.DECAY
        both = mean if look is None else (1 - fade) * look + fade * mean
        own = content.get(node, both)
        out[node] = (m[node], content.get(node), look, both, own < he.THRESHOLD and max(content[x] for x in below) < he.THRESHOLD)
    repeats = {leaf ^ he._value(c) for leaf in contents for c, ns in contents[leaf].items() if 2 * len(ns) > (top := on[hosts[leaf]]) >= he.MIN_PAGES and len(ns) > he.MIN_PAGES ** (1 - he.THRESHOLD) and 1 - math.log(len(ns)) / math.log(top) < he.THRESHOLD}
    return out, repeats


def test_tree_equals_plain_sums(spark):
    import random

    rng = random.Random(12)
    tags = ["div", "p", "ul", "section", "article", "div class=a", "div class='b c'", "div id=x"]

    def node(depth):
        tag = rng.choice(tags)
        inner = "".join(node(depth - 1) for _ in range(rng.randint(1, 3))) if depth else rng.choice(["Same", "Same again", "<a href=/m>Menu</a>", f"Text {rng.random()}", f"Of {rng.randint(0, 3)}"])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    pages = [(i, f"https://h{i % 3}.org/{i}", f"<body><div class=nav>Home</div>{node(2)}{node(1)}<p>{i}</p></body>") for i in range(90)] + [(90, None, "<p>x"), (91, "https://h0.org", None)]
    tree, repeats = he.trees(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.node: r for r in tree.collect()}
    want, often = plain_tree([(u, h) for _, u, h in pages])
    assert got.keys() == want.keys() and len(want) > 20 and {r.node for r in repeats.collect()} == often and often
    near = lambda a, b: a is b is None or abs(a - b) < 1e-6
    for n, (m, content, look, both, noise) in want.items():
        r = got[n]
        assert r.m == m and near(r.content, content) and near(r.presentation, look) and near(r.composite, both) and r.noise == noise
    assert any(r.noise for r in got.values()) and not all(r.noise for r in got.values())


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div><p>Real article</p></div><div class="sponsored-content"><p>Buy now</p></div>', "Real article"),
        ('<p>Real article</p><ul><li><div class="comment-content">first!</div></li></ul>', "Real article"),
        ('<main><div class="story">Story</div><article class="comment">c1</article></main>', "Story"),
        ('<div class="lead">story of the day</div><div class="post">Other</div>', "story of the day\n\nOther"),
        ('<div class="post">A story that is longer than all the rest of it</div><div class="lead">more</div>', "A story that is longer than all the rest of it"),
        ('<article class="post has-sidebar"><h1 class="entry-title">T</h1><div class="post-header">H</div><p>x</p></article>', "T\n\nH\n\nx"),
        ('<article class="sidebar-item"><p>x</p></article>', "x"),
        ('<div class="content-with-sidebar"><p>x</p></div>', "x"),
    ],
)
def test_class_names_weigh_noise_and_article_words(page, want):
    assert he.main_text(page, "h", ()) == want


@pytest.mark.parametrize("name", ["ad", "advert", "cookie-notice", "post-comments", "user-comments", "reader-comments", "related-posts", "ad-slot", "adsense", "subscribe-form", "entry-footer", "article-footer", "sponsored-post", "comment-body", "promoted-content"])
@pytest.mark.parametrize("tag", ["p", "div", "section", "aside"])
def test_noise_within_an_article(tag, name):
    assert he.main_text(f'<article><p>One.</p><{tag} class="{name}">No.</{tag}><p>Two.</p></article>', "h", ()) == "One.\n\nTwo."
