r"""Personal data and information-theoretic sanitisation (operator 5).

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers found by fixed
patterns.  Each distinct value is a protected entity.  A term can reveal an entity although it is
no personal data itself; how strongly is measured on the corpus.  All counts are of distinct texts, so copies
change nothing: with n_t texts that hold term t, n_e that hold entity e, n_et that hold t within
``REACH`` words of e, and N texts, the information that t gives away about e is

    PMI(e; t) = log2(p(e | t) / p(e)),  p(e | t) = (n_et + p(e)) / (n_t + 1),  p(e) = n_e / N

out of IC(e) = -log2 p(e).  p(e | t) is smoothed by one more text in which e is as likely as
anywhere, so a term may qualify from its first context, but the fewer texts hold it, the rarer
its entity must be.  A term is disclosing if PMI >= ``SHARE`` * IC.  In documents that hold the
entity, disclosing terms become ``term`` spans: removed if they occur nowhere else (n_et = n_t),
otherwise generalised to a placeholder.

Counting: contexts are small and keyed by entity; texts are counted only for terms that qualify
if they occur nowhere else (n_t = n_et), as more texts only lower p(e | t).  Copies of a text
meet by a shuffle after each task has dropped its own.  The terms to count are sent to the
counting tasks as a bitmap of fixed size (``BITMAP_BITS``), whose false hits cost a little work
and change nothing, because the counts are joined exactly afterwards.  The disclosing terms of a text are broadcast only while they fit in
``BROADCAST_BYTES``; beyond that, texts and terms meet by a shuffle on the text's hash.

Defined results: null and empty texts have no spans; the same text gets the same spans wherever
it occurs; repeated rows give repeated rows; spans are in code points, end exclusive; a ``term``
span never overlaps a base span; an empty table gives no rows; extra columns pass only if kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelore.llm.common import batch, fresh, in_batches, materialise, row_batches, table

KINDS = ("email", "ip", "card", "phone", "term")
REACH, SHARE = 8, 0.9
BITMAP_BITS = 1 << 24
BROADCAST_BYTES = 4 << 20
_HELD_COUNTS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats match the same texts as plain ones here, without backtracking.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, by kind in the order of KINDS, then start."""
    if not text:
        return []
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(_DIGIT.findall(value))}"


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in _TERM.findall(text)}


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, list[str]]]:
    """(entity, terms of its contexts) of every entity of the text."""
    covered = sorted((s, e) for _, s, e in spans)
    out: dict[str, set[str]] = {}
    for kind, start, end in spans:
        # Enough characters for the words on either side; a longer word is cut out of reach.
        low, high = max(0, start - 40 * reach), min(len(text), end + 40 * reach)
        words = [m for m in _TERM.finditer(text, low, high) if not any(s < m.end() and m.start() < e for s, e in covered if s < high and e > low)]
        near = [m for m in words if m.end() <= start][-reach:] + [m for m in words if m.start() >= end][:reach]
        out.setdefault(_entity(kind, text[start:end]), set()).update(m[0].lower() for m in near)
    return [(entity, sorted(terms)) for entity, terms in out.items()]


def _occurrences(df: DataFrame, text_col: str, reach: int) -> DataFrame:
    """(key, entity, terms): the entities of every text that has any."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col).cast("string"), 256).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("key", pa.string()), ("entity", pa.string()), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ((key.as_py(), *x) for key, text in zip(b.column(0), b.column(1), strict=True) if (t := text.as_py()) and (spans := base_spans(t)) for x in contexts(t, spans, reach))
            yield from row_batches(found, schema)

    return in_batches(rows, run, "key string, entity string, terms array<string>")


def _bitmap(terms: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits, at least 32,768, with the hashes of ``terms`` set."""
    place = F.pmod(F.xxhash64("term"), F.lit(bits))
    parts = terms.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("part")).agg(F.bitmap_construct_agg((F.col("p") % 32768).cast("long")).alias("bits"))
    out = bytearray(bits // 8)
    for part, found in parts.collect():  # bits / 32,768 rows at most
        out[part * 4096 : part * 4096 + len(found)] = found
    return bytes(out)


def _text_counts(df: DataFrame, text_col: str, bitmap: bytes) -> DataFrame:
    """(term, n): distinct texts that hold each term whose hash is in the bitmap."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        digest, bits, mask = xxhash.xxh64_intdigest, sent.value, len(sent.value) * 8 - 1

        def flush() -> Iterator[pa.RecordBatch]:
            yield from row_batches(iter(counts.items()), schema)
            counts.clear()

        for b in batches:
            for text in b.column(0):
                for term in terms_of(text.as_py()):
                    p = digest(term.encode(), 42) & mask
                    if bits[p >> 3] >> (p & 7) & 1:
                        counts[term] += 1
                if len(counts) > _HELD_COUNTS:
                    yield from flush()
        yield from flush()

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).distinct()
    return in_batches(rows, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(df: DataFrame, text_col: str = "text", reach: int = REACH, share: float = SHARE, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """((key, entity) of the texts with entities, (entity, term, action) that disclose).

    Both are materialised.
    """
    found = materialise(_occurrences(df, text_col, reach))
    entities = found.count()
    holders = materialise(found.select("entity", "key").distinct(), entities)
    total = df.where(F.col(text_col).isNotNull()).select(F.sha2(F.col(text_col).cast("string"), 256).alias("key")).distinct().count()
    prior = F.least(F.lit(1.0), F.col("n_e") / F.lit(total))
    information = -F.log2(prior)

    def discloses(n: str) -> Column:
        pmi = F.log2((F.col("n_et") + prior) / (F.col(n) + 1)) + information
        return (information > 0) & (pmi >= F.lit(share) * information)

    # Counts are summed from partial ones, so a very frequent entity or term is no hot task.
    together = found.select("key", "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    per_entity = holders.groupBy("entity").agg(F.count("*").alias("n_e"))
    able = materialise(together.join(per_entity, "entity").where(discloses("n_et")), 2 * reach * entities)
    if able.limit(1).count() == 0:
        return holders, able.select("entity", "term", F.lit("").alias("action"))
    per_term = _text_counts(df, text_col, _bitmap(able.select("term").distinct(), bits))
    joined = able.join(per_term, "term")
    action = F.when(F.col("n_et") >= F.col("n"), "remove").otherwise("generalise")
    return holders, materialise(joined.where(discloses("n")).select("entity", "term", action.alias("action")))


def _terms_by_text(df: DataFrame, text_col: str, **method) -> DataFrame:
    """(key, terms): the disclosing terms of each text, by the text's hash."""
    holders, pairs = disclosing_terms(df, text_col, **method)
    each = holders.join(pairs, "entity").groupBy("key", "term").agg(F.min("action").alias("action"))  # generalise wins
    return materialise(each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("terms")), holders.count())


def _with_terms(df: DataFrame, keep: tuple[str, ...], text_col: str, broadcast_bytes: int, **method) -> DataFrame:
    """``keep`` columns, the text, and the disclosing terms of the text, in this order."""
    terms = _terms_by_text(df, text_col, **method)
    size = terms.agg(F.sum(F.length(F.to_json("terms")) + 80)).first()[0] or 0
    key, body, found = fresh(df, "_key"), fresh(df, "_body"), fresh(df, "_terms")
    text = F.col(text_col).cast("string")
    rows = df.select(*keep, text.alias(body), F.coalesce(F.sha2(text, 256), F.lit("")).alias(key))
    by_key = terms.select(F.col("key").alias(key), F.col("terms").alias(found))
    if size <= broadcast_bytes:
        by_key = F.broadcast(by_key)
    return rows.join(by_key, key, "left").select(*keep, body, found)


def find_spans(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **method) -> DataFrame:
    """``keep`` columns and ``spans``: array of (kind, start, end, action), by kind, then start."""
    rows = _with_terms(df, keep, text_col, broadcast_bytes, **method)
    fields = rows.schema.fields[: len(keep)]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["spans array<struct<kind:string,start:long,end:long,action:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 2
            spans = [all_spans(t.as_py(), d.as_py()) for t, d in zip(b.column(n), b.column(n + 1), strict=True)]
            out = pa.schema([b.schema.field(i) for i in range(n)] + [("spans", pa.list_(span))])
            yield batch(out, [b.column(i) for i in range(n)] + [spans])

    return in_batches(rows, run, schema)


def all_spans(text: str | None, terms: list[dict] | None) -> list[dict]:
    base = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "action": "mask"} for k, s, e in base]
    if terms:
        actions = {t["term"]: t["action"] for t in terms}
        covered = sorted((s, e) for _, s, e in base)
        for m in _TERM.finditer(text):
            if (action := actions.get(m[0].lower())) and not any(s < m.end() and m.start() < e for s, e in covered):
                out.append({"kind": "term", "start": m.start(), "end": m.end(), "action": action})
    return out


def sanitised(text: str, spans: list[dict]) -> str:
    """The text with base spans masked by kind and disclosing terms generalised or removed."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if x["start"] < at:  # inside a span of another kind
            if x["end"] > at:
                at = x["end"]
            continue
        out.append(text[at : x["start"]])
        out.append("" if x["action"] == "remove" else f"<{x['kind'].upper()}>")
        at = x["end"]
    return "".join(out) + text[at:]


def sanitise(df: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **method) -> DataFrame:
    """``df`` with sanitised texts; all rows and columns stay, and null texts stay null.

    Spans are found and applied in one pass, so a task has one Python worker and one copy of
    each text.
    """
    names = [fresh(df, f"_c{i}") for i in range(len(df.columns))]
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    text = names[df.columns.index(text_col)]
    others = tuple(n for n in names if n != text)
    rows = _with_terms(renamed, others, text, broadcast_bytes, **method)
    fields = rows.schema.fields[: len(others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 2
            clean = []
            for t, d in zip(b.column(n), b.column(n + 1), strict=True):
                whole = t.as_py()
                spans = all_spans(whole, d.as_py())
                clean.append(sanitised(whole, spans) if spans else whole)
            out = pa.schema([b.schema.field(i) for i in range(n)] + [(text, pa.string())])
            yield batch(out, [b.column(i) for i in range(n)] + [clean])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{text}` string"])
    return in_batches(rows, run, schema).select(*[F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)])


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [_count(k) for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "term")
    return found.select("doc_id", *counts[:4], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), counts[4])


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
