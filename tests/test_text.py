"""Text functions against plain Python."""

import re

from pyspark.sql import functions as F

from codelore.functions import fixed, text as T
from codelore.plans import textual

ASSIGNED = re.compile(rf"(?i)\b([A-Za-z0-9_.-]*(?:{fixed.SECRET_NAMES})[A-Za-z0-9_.-]*)(\s*[:=]\s*)(['\"])([^'\"\n]{{8,}})\3")


def brute_redact(text):
    labels = set()
    for label, pattern in fixed.SECRETS:
        done = re.sub(pattern, T.MASK, text)
        if done != text:
            labels.add(label)
        text = done

    def mask(m):
        value = m[4].strip().lower()
        if value in fixed.PLACEHOLDERS or value.startswith(fixed.REFERENCES):
            return m[0]
        labels.add(f"assignment:{m[1]}")
        return m[1] + m[2] + m[3] + T.MASK + m[3]

    return ASSIGNED.sub(mask, text), ",".join(sorted(labels))


def test_redaction_equals_plain_python(spark):
    more = ["my_password = 'undefined '", "PASSWORD: \"Password\"", "secret='{{ vault }}'", "bearer = 'abc\ndefghijk'", "a.b-credential = 'hunter22' # c", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-" + "1234567890ab", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "postgres://u:p@h:1/d x", "apikey='changeme1'"]
    samples = [*textual.SAMPLES, *more]
    rows = spark.createDataFrame([(x,) for x in samples], "t string").select("t", T.redact(F.col("t")).alias("m"), F.array_join(T.redaction_labels(F.col("t")), ",").alias("l")).collect()
    for r in rows:
        assert (r.m, r.l) == brute_redact(r.t), r.t
    assert {r.t for r in rows if r.l} >= {textual.SAMPLES[0], textual.SAMPLES[2]}


def test_questions_equal_plain_python(spark):
    asked = [q for _, q in textual.QUESTIONS]
    got = {r.q: r for r in spark.createDataFrame([(q,) for q in asked], "q string").select("q", T.classify(F.col("q")).alias("c"), T.mentions(F.col("q")).alias("m")).collect()}
    for q in asked:
        scores = {}
        for intent, weight, pattern in fixed.RULES:
            if re.search(T.rule_pattern(pattern), q):
                scores[intent] = scores.get(intent, 0) + weight
        best = max(scores, key=scores.get) if scores else fixed.DEFAULT_INTENT
        sure = round(scores[best] / sum(scores.values()), 3) if scores else fixed.GUESS if q else 0.0
        assert (got[q].c.intent, got[q].c.confidence) == (best, sure)
    assert got["Explain the indexing file and the class AuthService"].m == ["AuthService", "indexing"]
    assert got["What calls parse_file()?"].m == ["parse_file"]
