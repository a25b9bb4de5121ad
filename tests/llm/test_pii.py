import hashlib
import random
import re

from crawlscape.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


def test_base_spans_equal_brute_force(spark, edge, nothing, tmp_path):
    rng = random.Random(6)
    pieces = ["a@b.co", "x.y%z@d-e.fr.", "@", ".", "1.2.3.4", "256.1.1.1", "0010.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "5500-0055-5555-5559", "+1 (017) 555-7713", "+49", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", " ", "é", "\U0001f600", "abc", "-", "12", "\n", "a@b.c_d@e.f", "a@b.cd@e.f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    texts += ["1" * 50_000, "a" * 50_000, "1 " * 20_000, "1." * 20_000, "+1" + "(" * 20_000, "a@" * 5_000, "a.b@c." * 3000]
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {r.doc_id: brute(r.text or "") for r in rows.collect()}
    got = pii.op7_pii(spark, str(tmp_path)).collect()
    assert len(got) == rows.count()
    for r in got:
        spans = wanted[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (r.doc_id, spans[:4], r.spans[:80])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE]
        assert r.spans.split(",")[: len(spans)] == spans or not spans
    nothing.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pii.op7_pii(spark, str(tmp_path / "none")).count() == 0


def test_estimates_find_the_reliable_labeler():
    counts = [("email", 2, 1, 1, 1, 0, 0, 90), ("email", 2, 1, -1, 0, -1, 0, 3), ("email", 2, -1, -1, 0, -1, 0, 60), ("email", 2, -1, 0, 1, -1, -1, 5)]
    p = pii.estimate(counts)
    assert p[0] > 0.9 > 0.5 > p[2]
    weights = pii.train(counts)
    assert len(weights) == len(pii._features("", 0, (0,) * 5)) and pii.estimate([]) == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co, call +1 (555) 123-4567!"), (2, None), (3, "nothing")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "to [EMAIL], call [PHONE]!", 2: None, 3: "nothing"}
