import hashlib
import random
import re

import pytest

from codelore.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "@", ".", "-", " ", "1", "23", "255", "256", "+", "(", ")", "x.y", "4041894974608795", "4111 1111 1111 1111", "é", "_", "%", "0007", "10.0.0.1", "+1 (988) 555-2485", "me@a.b"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert P.base_spans(text) == brute(text), text
    assert P.base_spans(None) == P.base_spans("") == []


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "a" * 200_000 + "@" + "b" * 200_000):
        P.base_spans(text)


def secretive():
    rng = random.Random(2)
    words = [f"w{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(200)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=40))
        if i % 12 == 0:
            text += f" the chairperson Zorblatt {words[i]} writes from boss@corp.example.com " + " ".join(rng.choices(words, k=20))
        if i % 7 == 0:
            text += " phone +1 (988) 555-2485 " + words[3]
        docs.append((i, text))
    return docs + [(500, None), (501, ""), (502, "zorblatt alone 10.1.2.3"), (500, None)]


def test_disclosing_terms_are_found_and_base_stays(spark):
    docs = secretive()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, pairs = P.disclosing_terms(df)
    got = {(r.entity, r.term): r.action for r in pairs.collect()}
    assert got[("email:boss@corp.example.com", "zorblatt")] == "generalise"
    assert got[("email:boss@corp.example.com", "chairperson")] == "remove"
    assert all(e.startswith("email:boss") or e.startswith("phone") for e, _ in got)
    for bytes_ in (P.BROADCAST_BYTES, -1):
        rows = P.find_spans(df, broadcast_bytes=bytes_).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
        texts = dict(docs)
        for r in rows:
            spans = [(s.kind, s.start, s.end) for s in r.spans]
            assert [s for s in spans if s[0] != "term"] == brute(texts[r.doc_id])
            terms = {texts[r.doc_id][s:e].lower() for k, s, e in spans if k == "term"}
            assert ("zorblatt" in terms) == ("boss@" in (texts[r.doc_id] or ""))


def test_sanitise_keeps_rows_and_columns(spark):
    docs = [(d, t, "s", 1) for d, t in secretive()]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string, _c0 int")
    out = P.sanitise(df)
    assert out.columns == df.columns and out.count() == len(docs)
    rows = {r.doc_id: r.text for r in out.collect()}
    assert "boss@" not in rows[0] and "<EMAIL>" in rows[0] and "Zorblatt" not in rows[0]
    assert "zorblatt alone <IP>" == rows[502] and rows[500] is None and rows[501] == ""
    clean = next(d for d, t, *_ in docs if t and "@" not in t and "+" not in t and d < 500)
    assert rows[clean] == dict((d, t) for d, t, *_ in docs)[clean]


def test_query_digests_and_empty(spark, tmp_path):
    docs = [(1, "write me@a.example now"), (2, None), (3, "call +1 (988) 555-2485 or 10.0.0.1")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in P.op5_pii(spark, str(tmp_path)).collect()}
    for d, t in docs:
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert rows[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows[d].spans == text
    assert rows[3].n_phone == 1 and rows[3].n_ip == 1 and rows[3].n_email == 0
    df = spark.createDataFrame(docs, "doc_id long, text string").where("false")
    assert P.find_spans(df).collect() == [] and P.sanitise(df).collect() == []


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y", "1.2.3.4.5.6.7.8", "4041894974608795 4041894974608795"])
def test_neighbouring_matches(text):
    assert P.base_spans(text) == brute(text)


def test_terms_of_one_or_two_contexts_are_found(spark):
    rng = random.Random(3)
    words = [f"w{''.join(rng.choices('abcdefgh', k=3))}" for _ in range(100)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(1500)]
    texts[5] += " treasurer Quillfeather wrote from one@corp.example.com"
    texts[6] += f" inspector Marblethorpe {words[0]} two@corp.example.com"
    texts[7] += f" {words[1]} inspector Marblethorpe two@corp.example.com"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, pairs = P.disclosing_terms(df)
    got = {(r.entity, r.term): r.action for r in pairs.collect()}
    planted = [("one", "treasurer"), ("one", "quillfeather"), ("two", "inspector"), ("two", "marblethorpe")]
    assert {k: a for k, a in got.items() if k[1] not in words} == {(f"email:{e}@corp.example.com", t): "remove" for e, t in planted} | {("email:one@corp.example.com", t): "remove" for t in ("wrote", "from")}
    assert not any(t in words for _, t in got)
    clean = {r.doc_id: r.text for r in P.sanitise(df).collect()}
    assert not any(w in clean[d] for d in (5, 6, 7) for w in ("treasurer", "Quillfeather", "inspector", "Marblethorpe"))


def test_copies_of_texts_change_no_terms(spark):
    docs = secretive()
    once = spark.createDataFrame(docs, "doc_id long, text string")
    often = once.union(once).union(once).union(once).union(once)
    one, many = ({(r.entity, r.term, r.action) for r in P.disclosing_terms(df)[1].collect()} for df in (once, often))
    assert one == many and ("email:boss@corp.example.com", "chairperson", "remove") in many


def brute_terms(texts):
    """(entity, term, action) that disclose, counted text by text from the definition."""
    from math import log2

    texts = {t for t in texts if t is not None}
    word = re.compile(r"[^\W_]{3,}")
    holds, n_e, n_et = {}, {}, {}
    for text in texts:
        for term in {m[0].lower() for m in word.finditer(text)}:
            holds[term] = holds.get(term, 0) + 1
        spans = brute(text)
        free = [m for m in word.finditer(text) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        near = {}
        for kind, start, end in spans:
            value = text[start:end]
            entity = f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"
            before = [m[0].lower() for m in free if m.end() <= start][-P.REACH :]
            after = [m[0].lower() for m in free if m.start() >= end][: P.REACH]
            near.setdefault(entity, set()).update(before + after)
        for entity, terms in near.items():
            n_e[entity] = n_e.get(entity, 0) + 1
            for term in terms:
                n_et[entity, term] = n_et.get((entity, term), 0) + 1
    out = set()
    for (entity, term), both in n_et.items():
        prior, n_t = n_e[entity] / len(texts), holds[term]
        information = -log2(prior)
        if information > 0 and log2((both + prior) / (n_t + 1)) + information >= P.SHARE * information:
            out.add((entity, term, "remove" if both >= n_t else "generalise"))
    return out


def test_terms_equal_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    more = [(10_000 + i, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(30)) + (f" call +1 (988) 555-{i % 50:04d} now" if i % 3 else "")) for i in range(1500)]
    df = docs.unionByName(spark.createDataFrame(more + more[:40], docs.schema))
    expected = brute_terms([r.text for r in df.collect()])
    _, pairs = P.disclosing_terms(df)
    assert {tuple(r) for r in pairs.select("entity", "term", "action").collect()} == expected
    own = {e for e, *_ in expected} & {f"{k}:{t[s:e].lower()}" for r in docs.collect() if r.text for k, s, e in brute(r.text) for t in [r.text] if k == "email"}
    assert len(expected) > 100 and own  # e-mail addresses of the documents among them
