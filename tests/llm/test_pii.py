import hashlib
import random
import re

from quillgraph.llm import op8_pii as op8

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def number(rng, valid):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(d) == valid:
            return d


def corpus(n=500):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéñ日🙂") for _ in range(rng.randint(1, 9)))
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice([
                word, word, word, lambda: f"a.b{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", lambda: f"x@y.z_q@r.st{rng.randint(0, 9)}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.choice([3, 4, 5, 8]))),
                lambda: number(rng, True), lambda: number(rng, False), lambda: "-".join(re.findall("....", number(rng, True))), lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: "+12", lambda: "+1+2 3.4(5)6-7 8",
                lambda: f'token = "{rng.getrandbits(160):040x}"', lambda: f'key "{rng.getrandbits(160):040x}"' if rng.random() < 0.2 else word(), lambda: "00000000001.0002.3.0255", lambda: "averylongwordthatisnotasecretbutlong" if rng.random() < 0.5 else word(),
            ])())
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    return rows + [(1000, None), (1001, ""), (None, "a@b.c"), (7, rows[7][1]), (1002, "1" * 40000), (1003, "a" * 40000 + "@b"), (1004, "a@" * 5000), (1005, "1." * 20000)]


def test_base_spans_and_additions(spark):
    rows = corpus()
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, email int").repartition(4)
    got = op8.find_personal(d).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, t)
    extra = odd = 0
    for r in got:
        want = brute(by_id[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        for s in set(spans) - set(want):
            kind, a, b = s.split(":")
            if kind == "secret":
                extra += 1
                odd += not re.search("[0-9a-f]{40}", by_id[r.doc_id][int(a) : int(b)])
    assert extra > 50 and odd < 0.1 * extra, (extra, odd)


def test_no_documents_and_redaction(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op8.find_personal(none).collect() == []
    d = spark.createDataFrame([(1, "é a@b.cd and 1.2.3.4!"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op8.redact(d, op8.find_personal(d)).collect()}
    assert out == {1: "é [email] and [ip]!", 2: None}


def unmarked(n=240):
    """Documents with marked phones and addresses, and ids of the unmarked ones among them (doc_id, kind, text)."""
    rng, rows, want = random.Random(5), [], []
    for i in range(n):
        phone, end = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", rng.choice(["", ".b", f".{i}"])
        plain = i % 8 == 0
        mail = f"{rng.choice(['ana', 'jose', 'zoe', 'nandu'])}{end}@mail{i % 10}.example.com"
        if plain:
            mail = f"{rng.choice(['josé', 'zoë', 'ñandú'])}{end}é@mail{i % 10}.example.com" if i % 16 else f"ana{end}@intranet"
        if plain:
            want += [(i, "phone", phone), (i, "email", mail)]
        noise = f"item {rng.getrandbits(60):x}a{rng.randint(10**8, 10**9)}f, number {number(rng, False)}, ratio 7@@{rng.randint(1, 9)}x5/{i}@{rng.randint(100, 999)}% and {i}@{rng.randint(1000, 9999)}#{i}"
        rows.append((i, f"words {phone if plain else '+1 ' + phone} then {mail} and more; {noise} end"))
    return rows, want


def test_phones_and_addresses_without_marks_are_added(spark):
    rows, want = unmarked()
    text = dict(rows)
    got = {r.doc_id: [x for x in r.spans.split(",") if x] for r in op8.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    added = {(i, k, text[i][int(a) : int(b)]) for i, spans in got.items() for k, a, b in (s.split(":") for s in spans if s not in brute(text[i]))}
    for kind in ("phone", "email"):
        found, right = {x for x in added if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(found & right) >= 0.8 * len(right), (kind, len(found & right), len(right))
        assert len(found - right) <= 0.1 * len(right), (kind, sorted(found - right)[:5])


def test_a_long_secret_is_one_span(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(n))
    rows = [(i, f'token = "{key(40)}" and averylongwordthatisnotasecretbutlong') for i in range(200)]
    long = key(2000)
    d = spark.createDataFrame([*rows, (1000, f'see token = "{long}" end')], "doc_id long, text string")
    out = {r.doc_id: r.text for r in op8.redact(d, op8.find_personal(d)).collect()}
    assert out[1000] == 'see token = "[secret]" end'


def test_a_rare_generator_is_fitted_beside_many_numbers(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(number(rng, False) for _ in range(40))) for i in range(100)]
    rows += [(1000 + i, f'token = "{rng.getrandbits(160):040x}" and averylongwordthatisnotasecretbutlong') for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scorer = op8.fit(d, sample=60)
    assert "secret" in scorer.models
    spans = {r.doc_id: r.spans for r in op8.find_personal(d, scorer).collect()}
    assert all("secret:9:49" in spans[1000 + i] for i in range(40))


def test_nothing_is_cut_by_length(spark):
    """Long local parts, domains, numbers and secrets are whole candidates; overlapping spans are redacted together."""
    from pyspark.sql import functions as F

    class All:
        models = {n: ([], [], 0.0) for n in op8.PROPOSED}

    rng = random.Random(9)
    local, domain, digits, key = "a" * 300, "é" * 400 + ".org", " ".join("5" * 4 for _ in range(30)), "".join(rng.choice("ABCDEFabcdef") for _ in range(900))
    text = f"x {local}@{domain} y {digits} z {key}"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = op8.find_personal(d, All()).collect()[0].spans.split(",")
    spans = {(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got)}
    assert {("email", f"{local}@{domain}"), ("card", digits), ("secret", key)} <= spans, spans
    found = spark.createDataFrame([(1, "a:0:3,b:2:5,c:5:6,d:8:10")], "doc_id long, spans string")
    assert op8.redact(spark.createDataFrame([(1, "é🙂23456789x")], "doc_id long, text string"), found).first().text == "[a][c]67[d]x"
    assert op8.redact(d, found.select("doc_id", F.lit("").alias("spans"))).first().text == text


def test_many_matches_in_one_text(spark):
    """64,000 addresses in one text: places by the same rule, without work that grows with their square."""
    import time

    n = 64_000
    d = spark.createDataFrame([(1, "1.2.3.4 " * n)], "doc_id long, text string")

    class Nothing:
        models = {}
        selects = staticmethod(lambda name, f: op8.F.lit(False))

    start = time.time()
    r = op8.find_personal(d, Nothing()).first()
    assert r.n_ip == n and r.base_sha256 == hashlib.sha256(",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n)).encode()).hexdigest()
    assert time.time() - start < 60


def test_candidates_of_one_label_are_added_however_few(spark):
    rng = random.Random(6)
    for n in (3, 60):
        rows = [(i, f'token = "{rng.getrandbits(160):040x}" words') for i in range(n)]
        found = op8.find_personal(spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(2)).collect()
        assert len(found) == 2 * n and all(r.spans == "secret:9:49" for r in found)
    rows = [(i, f"plain {rng.getrandbits(160):040x} words") for i in range(40)]
    assert all(r.spans == "" for r in op8.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_trees_and_thresholds_rest_on_all_candidates(spark):
    """Far more candidates of a label than a sample would take: all are fitted or calibrated on, whatever the partitions."""
    rng = random.Random(11)
    rows = [(i, f'token = "{rng.getrandbits(160):040x}" {" ".join("averylongword" + rng.choice("abcdef") * rng.randint(8, 40) for _ in range(30))}') for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = op8.fit(d.repartition(4)), op8.fit(d.repartition(7))
    assert sum(one.counts["secret"]) == 400 * 31
    assert one.models == two.models and "secret" in one.models
    spans = {r.doc_id: r.spans for r in op8.find_personal(d, one).collect()}
    assert all(spans[i] == "secret:9:49" for i in range(400))
