import hashlib
import random
import re

from strandlake.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def scanned(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(frame).collect()}


def test_base_spans_equal_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    made = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries.op1_secret_scan(spark, "").collect())
    want = []
    for i, text, _ in rows:
        found = base(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()
        want.append((str(i), *(sum(f[1] == k for f in found) for k in range(3)), digest))
    assert made == sorted(want)


def test_overlaps_and_short_values(spark):
    found = scanned(spark, ["secret=token: abcdefgh", "api_key=\"zzzzzz99\" é Token = 'short", "AKIA" + "A" * 16 + "é" * 3 + " deadbeef" + "deadbeef" * 3, "token=a"])
    assert found[0] == [] and found[1] == [("assign", 0, 17)]
    assert found[2] == [("access", 0, 20), ("hex", 24, 56)] and found[3] == []


def test_weak_parts_need_complements_in_their_scope(spark):
    together = "user = bob\nhost: db.example.com\npwd = hunter22x"
    found = scanned(spark, [together, together.replace("\n", "\n\n"), "user = bob", together.replace("host", "." * 900 + " host"), "https://x.example/y token=aaaaaaaa user: joe"])
    assert [k for k, _, _ in found[0]] == ["login", "endpoint", "weak"]
    assert found[1] == found[2] == []
    assert [k for k, _, _ in found[3]] == ["weak"]  # the login is too far from the secret and the endpoint
    assert [k for k, _, _ in found[4]] == ["endpoint", "assign", "login"]


def test_many_candidates_make_no_pairs(spark):
    text = "user=joe1 pwd=secretpw1 " * 3000
    found = scanned(spark, [text])[0]
    assert len(found) == 6000


def test_redaction(spark, docs):
    frame = spark.createDataFrame([(1, 'a token = "abcdef0123456789abcdef0123" b é password=hunter22 c', 9), (2, "clean", 5), (3, None, 0)], "doc_id long, text string, n long")
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(frame).collect()}
    assert out == {1: 'a [secret]" b é [secret] c', 2: "clean", 3: None}
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).count() == docs.count()


def test_tokens_of_any_length_and_very_long_texts(spark):
    access = "AKIA" + "A" * 16 + " "
    mixed = "xy" * 105 + "C9" + "zw" * 6  # its only digit and capital come after 210 letters
    plain = "xy" * 110
    texts = [access + mixed, access + plain, "x " * 300_000 + access + mixed, "a" * 400_000]
    found = scanned(spark, texts)
    assert [k for k, _, _ in found[0]] == ["access", "weak"] and found[0][1][2] - found[0][1][1] == len(mixed)
    assert [k for k, _, _ in found[1]] == ["access"] and [k for k, _, _ in found[2]] == ["access", "weak"]
    assert [k for k, _, _ in found[3]] == ["hex"]


def test_empty(empty):
    assert secrets.scan(empty).count() == 0


def test_long_parts_are_linked(spark):
    found = scanned(spark, ["secret=" + "a1" * 450 + "   user = bob", "token=abcdefgh " + "x " * 192 + "\nuser = bob", "user = bob " + "x " * 192 + "token=" + "b2" * 300, "token=abcdefgh " + "x " * 200 + "\nuser = bob"])
    assert all([k for k, _, _ in found[i]].count("login") == 1 for i in (0, 1, 2)) and [k for k, _, _ in found[3]] == ["assign"]


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    kinds, rows = "assign access hex login weak endpoint".split(), []
    for text in range(40):
        for _ in range(rng.randrange(1, 9)):
            start = rng.randrange(4000)
            rows.append((text, text, rng.randrange(2), rng.choice(kinds), start, start + rng.choice((5, 30, 500, 1500))))
    rows = sorted(set(rows))
    role = {"access": "id", "login": "id", "endpoint": "at"}
    want = []
    for t, h, scope, kind, start, end in rows:
        near = {role.get(k, "secret") for u, _, c, k, s, e in rows if (u, c) == (t, scope) and max(s - end, start - e) <= secrets.REACH}
        if (kind == "login" and "secret" in near) or (kind == "weak" and near & {"id", "at"}) or (kind == "endpoint" and {"id", "secret"} <= near):
            want.append((t, h, kind, start, end))
    frame = spark.createDataFrame(rows, "sp_id long, sp_hash long, scope long, kind string, start long, end long")
    assert sorted(map(tuple, secrets.linked(frame).collect())) == sorted(want)
