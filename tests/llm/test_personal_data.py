import hashlib
import random
import re

from capturelake.llm import personal_data as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@", ".", "..", "-", "+", "+1", " ", " ", "(555)", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "300.1.1.1", "0255.1.1.1", "12", "7", "é", "x@y.z", "\n", "%", "+49 30 1234567", "٣"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        assert pii.choose([s for s in pii.candidates(t) if s["base"]], {}) == base(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "+1" * 50_000, "1.1 " * 50_000, "@" * 200_000, "a1" * 100_000, "a1/" * 60_000, "x" * 15 + " 1" * 50_000, "10 " * 60_000, "+1" + "(" * 100_000):
        pii.candidates(t)


def corpus():
    good = ["mail jo@mail.com now", "call +1 (555) 010-9999 soon", "card 4111111111111111 ok", "host 10.1.2.3 up"]
    rows = [(i, f"word {good[i % 4]} word") for i in range(80)] + [(i, "plain words only, nothing else") for i in range(80, 160)]
    return rows + [(200, "phone 030 123 45678 here"), (201, "order 030 123 45678 here"), (202, None), (203, ""), (None, "x@y.org"), (204, "x@y.org"), (204, "x@y.org")]


def test_query(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, found int")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(corpus())
    text = dict(corpus())
    for r in got:
        spans = base(text[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in PATTERNS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        if r.doc_id is not None and 80 <= r.doc_id < 160:
            assert r.spans == ""
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_estimation_finds_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        vote = lambda sure: (pii.YES if real else pii.NO) if rng.random() < sure else (pii.NO if real else pii.YES)  # noqa: E731,B023
        v = vote(0.95) + vote(0.95) + vote(0.9) + vote(0.5) + vote(0.5)
        counts[f"phone|{v}|110"] = counts.get(f"phone|{v}|110", 0) + 1
    p = pii.estimate(counts)
    assert p["phone", "yyynn"] > 0.95 and p["phone", "nnnyy"] < 0.05
    fitted = pii.train(counts)
    assert fitted["phone|yyyyy|110"] > 0.9 > 0.1 > fitted["phone|nnnnn|110"]


def test_overlaps_go_to_the_likelier():
    span = lambda k, a, b, base, p: {"kind": k, "start": a, "end": b, "base": base, "pattern": p}
    found = [span("email", 5, 9, True, "email|yyyyy|000"), span("phone", 8, 12, False, "phone|-y-yy|000"), span("iban", 20, 30, False, "iban|-y-yy|000"), span("phone", 25, 35, False, "phone|-yyyy|000")]
    chance = {"phone|-y-yy|000": 0.99, "iban|-y-yy|000": 0.95, "phone|-yyyy|000": 0.97}
    assert pii.choose(found, chance) == [("email", 5, 9), ("phone", 25, 35)]


def plain_estimate(rows, rounds):
    """EM over single candidates, by the formulas of the docstring."""
    p = []
    for _, v in rows:
        yes, no = v.count(pii.YES), v.count(pii.NO)
        p.append((yes + 0.5) / (yes + no + 1))
    for _ in range(rounds):
        sure = [[0.0] * 5, [0.0] * 5]
        for y in (0, 1):
            for j in range(5):
                said, all_ = 1.0, 2.0
                for (_, v), q in zip(rows, p, strict=True):
                    w = q if y else 1 - q
                    all_ += w * (v[j] != pii.ABSTAIN)
                    said += w * (v[j] == pii.YES)
                sure[y][j] = said / all_
        for j in range(5):
            if sure[1][j] < sure[0][j]:
                sure[0][j] = sure[1][j] = (sure[0][j] + sure[1][j]) / 2
        prior = {}
        for k in pii.KINDS:
            own = [q for (kind, _), q in zip(rows, p, strict=True) if kind == k]
            prior[k] = (1 + sum(own)) / (2 + len(own))
        new = []
        for kind, v in rows:
            real, none = prior[kind], 1 - prior[kind]
            for j in range(5):
                if v[j] != pii.ABSTAIN:
                    real *= sure[1][j] if v[j] == pii.YES else 1 - sure[1][j]
                    none *= sure[0][j] if v[j] == pii.YES else 1 - sure[0][j]
            new.append(real / (real + none))
        p = new
    return dict(zip(rows, p, strict=True))


def test_estimation_equals_plain_em():
    rng = random.Random(8)
    for rounds in (1, 7, 50):
        rows = [(rng.choice(pii.KINDS), "".join(rng.choices("yn-", (5, 2, 3), k=5))) for _ in range(150)]
        counts = {}
        for k, v in rows:
            shape = f"{k}|{v}|{rng.randint(0, 3)}10"
            counts[shape] = counts.get(shape, 0) + 1
        got, want = pii.estimate(counts, rounds), plain_estimate(rows, rounds)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_truths_keep_their_places():
    counts = {"email|yyy-y|100": 180, "card|yyy-y|130": 160, "card|ynn-y|130": 130, "ip|yy--y|130": 170, "phone|yyy-y|121": 157, "secret|-y-yy|320": 160}
    p, fitted = pii.estimate(counts), pii.train(counts)
    assert p["email", "yyy-y"] > 0.9 and p["secret", "-y-yy"] > 0.9 and p["card", "ynn-y"] < 0.1
    assert fitted["email|yyy-y|100"] > 0.9 and fitted["secret|-y-yy|320"] > 0.9 and fitted["card|ynn-y|130"] < 0.5


def test_added_kinds_are_found_and_others_left(spark):
    """Recall and precision on planted spans beyond the base patterns."""
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    plant = {
        "secret": lambda: rng.choice([f'token = "{hexes(40)}"', f"password: {hexes(20)}X", f"api_key={hexes(32)}", f"key AKIA{hexes(16).upper()}"]),
        "phone": lambda: f"phone 0{rng.randint(20, 99)} {rng.randint(100, 999)} {rng.randint(10000, 99999)}",
        "email": lambda: f"mail jo{rng.randint(1, 99)} [at] mail [dot] com",
    }
    clean = [lambda: f"commit {hexes(40)} fixed it", lambda: "sum 12,34 5678 and 1999&20 3000 and 10.50 200", lambda: "100 000 000 words", lambda: f"see /wiki/{hexes(24)} there", lambda: f"order 0{rng.randint(20, 99)} {rng.randint(100, 999)} {rng.randint(10000, 99999)}", lambda: "Weltraumforschungszentrum2 Donaudampfschifffahrtsgesellschaft"]
    base = ["mail jo@mail.com now", "call +1 (555) 010-9999 soon", "card 4111111111111111 ok", "host 10.1.2.3 up", "card 4111111111111112 no"]
    rows, want = [], {}
    for i in range(400):
        kind = list(plant)[i % 3]
        if i % 4 == 0:
            rows.append((i, f"some words {plant[kind]()} and more"))
            want[i] = kind
        elif i % 4 == 1:
            rows.append((i, f"some words {rng.choice(clean)()} and more"))
        else:
            rows.append((i, rng.choice(base)))
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i, kind in want.items() if got[i].spans.split(":")[0] == kind]
    assert len(found) >= 0.9 * len(want)
    assert all(got[i].n_added == got[i].n_spans == 0 for i, _ in rows if i % 4 == 1)
