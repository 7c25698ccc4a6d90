"""Personal data: base patterns, secrets, and information-theoretic sanitisation of the terms around them.

Base spans (email, ip, card, phone) come from fixed patterns; secrets are long
runs of key characters, letters and digits mixed, with at least
``SECRET_BITS`` bits of Shannon entropy a character. Every distinct value is a
protected entity. How strongly a term t reveals an entity e is its pointwise
mutual information with it, as a share of the entity's information content:

    disclosure(e, t) = log2(P(e | t) / P(e)) / -log2 P(e)

P(e) is the share of the corpus's documents that hold e. P(e | t) is the share,
among the documents that hold t, of those in which t stands within ``REACH``
words of e, by the lower end of its Wilson interval at ``Z`` deviations: rare
terms are judged too, with the doubt that their few documents leave. All counts
are over the whole corpus. In every document that holds an entity, all
occurrences of the terms near it that disclose at least ``GENERALISE`` are
generalised, at least ``REMOVE`` removed.

Terms near entities are shuffled as they are; of all other words only counts
are, added up before the shuffle. A term is judged against the entity that it
stands by most often before its entities are joined, so common words are gone by
then.

Defined results: a null text counts as empty and has no spans; overlapping
spans of different kinds all stay, but no secret and no term overlaps another
span; repeated rows give repeated results; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles
from .decontaminate import TO_WORDS

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
REACH, Z, GENERALISE, REMOVE = 4, 1.645, 0.75, 0.85
SECRET_CHARS, SECRET_BITS = 24, 3.2
#: Telling pairs are broadcast up to so many; more are joined, each on so many salts.
BROADCAST_ROWS, SALTS = 200_000, 16

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits: what follows the run is the same from its first digit.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
KEY = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SECRET_CHARS)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From every @: the run of local characters before it (after the last match) and the domain after it. In
    time linear in the text, as no run is read twice.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text) if "." in text else ():
        if all(len(x := g.lstrip("0")) < 4 and int(x or 0) <= 255 for g in m.groups()):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points) of a text's words."""
    hashes, _ = shingles.word_hashes([text])
    raw = np.frombuffer(text.encode(), np.uint8)
    data = np.frombuffer(text.encode().translate(TO_WORDS), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return hashes, points[edges[::2]], points[edges[1::2]]


def secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of key characters of high entropy that overlap no other span."""
    out = []
    for m in KEY.finditer(text):
        run, (start, end) = m[0], m.span()
        digits = sum(c.isdigit() for c in run)
        if not 0.1 <= digits / len(run) <= 0.9:
            continue
        shares = np.array(list(Counter(run).values())) / len(run)
        if -(shares * np.log2(shares)).sum() >= SECRET_BITS and not any(a < end and start < b for _, a, b in taken):
            out.append((SECRET, start, end))
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secrets(text, base)


def entity(text: str, span: tuple[str, int, int]) -> int:
    """What names the protected value: the kind, and the value without what doesn't matter to it."""
    kind, start, end = span
    value = text[start:end]
    value = value.lower() if kind == "email" else NOT_DIGIT.sub("", value) if kind in ("card", "phone") else value
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def covered(spans: list[tuple[str, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word touches a span."""
    out = np.zeros(len(start) + 1, np.int64)
    for _, a, b in spans:
        out[int(np.searchsorted(end, a, "right"))] += 1
        out[int(np.searchsorted(start, b, "left"))] -= 1
    return np.cumsum(out)[:-1] > 0


def contexts(text: str, spans: list[tuple[str, int, int]]) -> dict[int, list[int]]:
    """Of every entity: the hashes of the words in its reach that are in no span, each once."""
    hashes, start, end = word_places(text)
    free = ~covered(spans, start, end)
    places: dict[int, set[int]] = {}
    for span in spans:
        low, high = int(np.searchsorted(end, span[1], "right")), int(np.searchsorted(start, span[2], "left"))
        near = [*range(max(0, low - REACH), low), *range(high, min(len(start), high + REACH))]
        places.setdefault(entity(text, span), set()).update(k for k in near if free[k])
    signed = hashes.view(np.int64)
    return {e: np.unique(signed[sorted(found)]).tolist() for e, found in places.items()}


BASE = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base string, base_sha256 string, more string, near array<struct<entity:long,words:array<long>>>, text string"
NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("words", pa.list_(pa.int64()))]))
NAMES = ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base", "base_sha256", "more", "near", "text"]


def based(texts: DataFrame) -> DataFrame:
    """Per row: spans of the base patterns and of secrets, and the words around them; the text only where there are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches):
            found = [all_spans(x) for x in own]
            names = [joined([x for x in spans if x[0] != SECRET]) for spans in found]
            more = [joined([x for x in spans if x[0] == SECRET]) for spans in found]
            near = [contexts(text, spans) if spans else {} for text, spans in zip(own, found, strict=True)]
            lists = pa.array([[{"entity": e, "words": w} for e, w in x.items()] for x in near], NEAR)
            counts = [pa.array([sum(k == kind for k, _, _ in x) for x in found], pa.int64()) for kind in (*KINDS, SECRET)]
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names])
            kept = pa.array([text if x else None for text, x in zip(own, near, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1).cast(pa.int64()), *counts, pa.array(names), digests, pa.array(more), lists, kept],
                NAMES,
            )

    return texts.mapInArrow(run, BASE)


def occurrences(texts: DataFrame) -> DataFrame:
    """In how many of all texts each word (hash) occurs. Slices count before the shuffle, and so does each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in common.slices(batches):
            hashes, bounds = shingles.word_hashes(own)
            text = np.repeat(np.arange(len(own)), np.diff(bounds))
            order = np.argsort(hashes, kind="stable")  # equal words stay in the order of their texts
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            found, counts = np.unique(hashes[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "n"])

    return texts.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def wilson(k: Column, n: Column) -> Column:
    """The lower end of the interval of a share that k of n show."""
    p, zz = k / n, F.lit(Z * Z)
    return (p + zz / (2 * n) - F.lit(Z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def disclosure(k: Column, n: Column, holding: Column, docs: int) -> Column:
    p = F.least(holding / F.lit(float(max(docs, 1))), F.lit(1 - 1e-9))
    return F.log2(F.greatest(wilson(k, n), F.lit(1e-300)) / p) / -F.log2(p)


def telling_terms(held: DataFrame, texts: DataFrame, docs: int) -> list[DataFrame]:
    """held: row, entity, words. The pairs (entity, hash) that disclose at least GENERALISE, and their
    disclosure; then what was settled for them.
    """
    by_entity = common.settled(held.groupBy("entity").agg(F.count(F.lit(1)).alias("holding")), "entities")
    joint = common.settled(
        held.select("entity", F.explode("words").alias("hash")).groupBy("entity", "hash").agg(F.count(F.lit(1)).alias("both")),
        "joint",
    )
    least = by_entity.agg(F.min("holding")).first()[0]
    if least is None:
        return [joint.select("entity", "hash", F.lit(0.0).alias("disclosure")).limit(0), by_entity, joint]
    by_term = common.settled(joint.groupBy("hash").agg(F.max("both").alias("most")), "terms")
    counted = occurrences(texts).join(by_term, "hash")
    able = counted.where(disclosure(F.col("most"), F.col("n"), F.lit(float(least)), docs) >= GENERALISE)
    judged = joint.join(able.select("hash", "n"), "hash").join(by_entity, "entity")
    pairs = judged.select(
        "entity",
        "hash",
        disclosure(F.col("both"), F.col("n"), F.col("holding"), docs).alias("disclosure"),
    ).where(F.col("disclosure") >= GENERALISE)
    return [pairs, by_entity, joint, by_term]


def find(docs: DataFrame) -> DataFrame:
    """Per row: row, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_terms, n_spans, terms."""
    return found(common.project(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))


FOUND = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_terms long, n_spans long, terms array<struct<start:long,end:long,remove:boolean>>"
COUNTS = [f"n_{k}" for k in KINDS]


def found(texts: DataFrame) -> DataFrame:
    """find() of rows (row, doc_id, text). ``row`` is read once; the texts must be those of any later scan."""
    rows = common.settled(based(texts), "base")
    held = rows.where(F.size("near") > 0).select("row", F.explode("near").alias("c")).select("row", "c.*")
    near = held.select("row", "entity", F.explode("words").alias("hash"))
    pairs, *used = telling_terms(held, texts, rows.count())
    telling = common.settled(pairs, "telling")
    common.dropped(*used)
    if telling.count() <= BROADCAST_ROWS:
        met = near.join(F.broadcast(telling), ["entity", "hash"])
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
        met = near.withColumn("salt", salt).join(
            telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
            ["entity", "hash", "salt"],
        )
    by_row = met.groupBy("row", "hash").agg(F.max("disclosure").alias("d")).groupBy("row").agg(
        F.collect_list(F.struct("hash", (F.col("d") >= REMOVE).alias("remove"))).alias("told")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in common.slices(batches):
            names = {c: rows.column(k).to_pylist() for k, c in enumerate(rows.schema.names) if c in ("base", "more", "told")}
            terms = [
                marked(text, base, more, told) if told else [] for text, base, more, told in zip(
                    own,
                    names["base"],
                    names["more"],
                    names["told"],
                    strict=True,
                )
            ]
            spans = [
                ",".join(
                    x for x in (base, more, ",".join(f"{TERM}:{t['start']}:{t['end']}" for t in own_terms)) if x
                ) for base, more, own_terms in zip(names["base"], names["more"], terms, strict=True)
            ]
            n_terms, n_spans = [len(x) for x in terms], [x.count(":") // 2 for x in spans]
            column = lambda c: rows.column(rows.schema.get_field_index(c))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("remove", pa.bool_())]))
            made = [
                column("base_sha256"),
                pa.array(spans),
                column("n_secret"),
                pa.array(n_terms, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(terms, kind),
            ]
            yield pa.RecordBatch.from_arrays(
                [column("row"), column("doc_id"), *map(column, COUNTS), *made],
                ["row", "doc_id", *COUNTS, "base_sha256", "spans", "n_secret", "n_terms", "n_spans", "terms"],
            )

    some = rows.where(F.size("near") > 0).drop("near").join(by_row, "row", "left")
    none = rows.where(F.size("near") == 0).drop("near").withColumn("told", F.lit(None).cast(by_row.schema["told"].dataType))
    return some.unionByName(none).mapInArrow(run, FOUND)


def parsed(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def marked(text: str, base: str, more: str, told: list[dict]) -> list[dict]:
    """All occurrences of the telling terms that are in no span."""
    hashes, start, end = word_places(text)
    free = ~covered(parsed(base) + parsed(more), start, end)
    remove = {t["hash"]: t["remove"] for t in told}
    signed = hashes.view(np.int64)
    at = np.flatnonzero(free & np.isin(signed, list(remove)))
    return [{"start": int(start[k]), "end": int(end[k]), "remove": remove[int(signed[k])]} for k in at.tolist()]


def replaced(text: str, spans: str, removed: list[int]) -> str:
    out, last, gone = [], 0, set(removed)
    for start, end, kind in sorted((a, b, k) for k, a, b in parsed(spans)):
        if start >= last:
            out += [text[last:start], "" if kind == TERM and start in gone else f"[{kind}]"]
            last = end
    return "".join([*out, text[last:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, generalised terms by [term], removed terms by
    nothing; overlapping spans are replaced once, by the first that begins. All other columns stay as they
    are.
    """
    schema, row = docs.schema, common.unused(docs, common.ROW)
    docs = common.numbered(docs, row)
    names = [common.unused(docs, x) for x in ("spans", "removed")]
    removed = F.transform(F.filter("terms", lambda t: t["remove"]), lambda t: t["start"])
    own = found(docs.select(F.col(row).alias("row"), "doc_id", "text")).where("spans <> ''").select(
        F.col("row").alias(row),
        F.col("spans").alias(names[0]),
        removed.alias(names[1]),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            spans, gone = (b.column(b.schema.get_field_index(n)).to_pylist() for n in names)
            texts = [
                t if not s or t is None else replaced(t, s, g or []) for t, s, g in zip(b.column(at).to_pylist(), spans, gone, strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    kept = [F.col(f"`{f.name}`") for f in schema]
    return docs.join(own, row, "left").select(*kept, *names).mapInArrow(run, schema)
