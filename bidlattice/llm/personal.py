"""Personal data by bootstrapped contextual extraction.

Seeds are mentions that a strict form and a checksum prove: e-mail addresses, IPv4 addresses, payment cards, international
telephone numbers. Looser forms (addresses spelled with "at" and "dot", numbers without a country code, cards with a wrong
check digit, IPv6) are candidates only. The words around mentions are lexical patterns: the word before, the two words
before, the word after, each with the kind. Patterns and instances (distinct values) form a bipartite graph.

A pattern's confidence is the share of its occurrences in the whole corpus that a trusted instance follows; occurrences
followed by an untrusted candidate of the kind count neither way. A pattern needs SUPPORT distinct trusted instances. An
instance's confidence joins its patterns: 1 - product(1 - confidence). Instances from ACCEPT on are trusted in the next
round, support new patterns, and are reported wherever they occur.

Two passes read the texts. The first finds mentions and their contexts; the second counts, in the whole corpus, the
contexts that a bitmap of fixed size lets through. All else works on mentions: the graph, aggregated before each shuffle,
with frequent patterns and instances broadcast (`common.met`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import met, stash

KINDS = ("email", "ip", "card", "phone")
#: Distinct trusted instances that a pattern needs; least confidence of a pattern that speaks for others; of an instance.
SUPPORT, SPEAKS, ACCEPT, ROUNDS = 3, 0.5, 0.8, 6
#: Characters that may stand between a mention and a word of its context.
GAP = 4
#: log2 of the bits of the bitmap of contexts: 2 MB, whatever the corpus holds.
BITMAP = 24
#: Counts that a task holds before it sums them up.
HELD = 1 << 19

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# digits can't be left half taken: a match that fails at the first digit of a run fails at the others
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED_AT = ("@", "(at)", "(AT)", "[at]", "[AT]", " at ", " AT ")
SPELLED_DOMAIN = re.compile(r" ?([A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\(DOT\)|\[DOT\]) ?|\.| dot | DOT )[A-Za-z0-9-]++)*+)")
SPELLED_IP = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?![0-9A-Za-z])")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd, even = (sum(map(int, digits[-1::-2])), sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2]))
    return (odd + even) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _run_before(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the strict form, found from the @ outwards so that no run of letters is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = _run_before(text, at, end)
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, (end := m.end())
        at = text.find("@", end if m else at + 1)


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the strict forms, leftmost and non-overlapping within a kind; a match that fails its test is dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if _octets(m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str) -> Iterator[Span]:
    """Spans of the looser forms; those that overlap a strict one are for the caller to drop."""
    found = []
    for sign in SPELLED_AT:
        at = text.find(sign)
        while at >= 0:
            left = at - (sign[0] in "([" and at > 0 and text[at - 1] == " ")
            start = _run_before(text, left, 0)
            m = SPELLED_DOMAIN.match(text, at + len(sign)) if start < left else None
            if m and (sign.strip().lower() != "at" or re.search(r"dot|\.", m[1], re.I)):
                found.append((start, m.end()))
            at = text.find(sign, at + len(sign))
    end = -1
    for a, b in sorted(found):
        if a >= end:
            yield 0, a, (end := b)
    for form in (SPELLED_IP, IP6):
        if form is IP6 and text.count(":") < 7:
            continue
        for m in form.finditer(text):
            if form is IP6 or _octets(re.findall("[0-9]+", m[0])):
                yield 1, *m.span()
    for m in CARD.finditer(text):
        if 12 <= sum("0" <= c <= "9" for c in m[0]) <= 19:
            yield 2, *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield 3, *m.span()


def value_of(kind: int, text: str) -> str:
    """The mention without what spelling adds: digits of numbers, lower-cased addresses with @ and dots."""
    if kind >= 2:
        return _digits(text)
    text = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*|[\[(]\.[\])]", ".", text.lower())
    return re.sub(r"\s*[\[(]\s*at\s*[\])]\s*|\sat\s|\s*@\s*", "@", text) if kind == 0 else text


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z" or c > "\x7f"


def _word(text: str, at: int, step: int) -> tuple[int, int] | None:
    """The word that ends (step -1) or begins (step 1) at most GAP characters from at, on the same line."""
    i, left = at, GAP
    ahead = lambda i: text[i - 1 : i] if step < 0 else text[i : i + 1]
    while (c := ahead(i)) and not _letter(c):
        if not left or c in "\r\n" or c.isdigit():
            return None
        i, left = i + step, left - 1
    j = i
    while (c := ahead(j)) and _letter(c):
        j += step
    return None if i == j else (min(i, j), max(i, j))


def contexts(text: str, start: int, end: int) -> list[str | None]:
    """The word before a span, the word before that, the word after it."""
    one = _word(text, start, -1)
    two = _word(text, one[0], -1) if one else None
    after = _word(text, end, 1)
    return [text[x[0] : x[1]] if x else None for x in (one, two, after)]


_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return common.mix(first * _ONE + common.mix(second * _TWO))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (letters, and all bytes from 128 on) and the row that it is in."""
    solid = ((data >= 97) & (data <= 122)) | (data >= 128)
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]])[: len(data)] | edges[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]])[: len(data)] | edges[1:])) + 1
    return common.hashes_of(data, starts, ends), np.searchsorted(offsets, starts, "right")


def _codes(words: list[str | None]) -> list[int | None]:
    """The hash of each given word."""
    data, offsets = common.utf8(pa.array(words, pa.string()))
    data = common.lower_ascii(data)
    full = np.flatnonzero(np.diff(offsets))
    codes = dict(zip(full.tolist(), common.hashes_of(data, offsets[full], offsets[full + 1]).tolist(), strict=True))
    return [codes.get(i) for i in range(len(words))]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


MENTION = "struct<kind:int,start:int,end:int,seed:boolean,value:binary,before:long,two:long,after:long>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.text_slices(whole):
            out, words = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = [(*s, True) for s in base]
                taken = sorted((a, b) for _, a, b in base)
                if text:
                    starts = [a for a, _ in taken]
                    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
                    for k, a, b in loose_spans(text):
                        i = int(np.searchsorted(starts, b))  # strict spans that begin before b
                        if not i or reach[i - 1] <= a:
                            spans.append((k, a, b, False))
                found = []
                for k, a, b, seed in spans:
                    around = contexts(text, a, b)
                    words += around
                    value = hashlib.blake2b(f"{KINDS[k]}:{value_of(k, text[a:b])}".encode(), digest_size=16).digest()
                    found.append({"kind": k, "start": a, "end": b, "seed": seed, "value": value})
                out.append(found)
            codes = _codes(words)
            at = 0
            for found in out:
                for m in found:
                    one, two, after = codes[at : at + 3]
                    at += 3
                    hashed = lambda *x: int(_signed(_pair(*(np.array([y], np.uint64) for y in x)))[0])
                    m["before"] = None if one is None else hashed(one, 0)
                    m["two"] = None if two is None else hashed(two, one)
                    m["after"] = None if after is None else hashed(after, 0)
            kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.binary()), ("before", pa.int64()), ("two", pa.int64()), ("after", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(kind))], names=["doc_id", "mentions"])


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, at.ravel(), np.concatenate(counts))
    return code, total


def _count(shared):
    """(code, n) of the words and word pairs of a task's texts whose bit is set, summed over HELD of them or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held = lambda x: x[(bits[(x >> np.uint64(67 - BITMAP)).astype(np.int64)] >> ((x >> np.uint64(64 - BITMAP)) & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        codes, counts, waiting = [], [], 0
        for whole in batches:
            for batch in common.text_slices(whole):
                data, offsets = common.utf8(batch.column("text"))
                words, row = _words(common.lower_ascii(data), offsets)
                if not len(words):
                    continue
                pairs = _pair(words[:-1], words[1:])[row[1:] == row[:-1]]
                code, n = np.unique(np.concatenate([held(_pair(words, np.zeros(1, np.uint64))), held(pairs)]), return_counts=True)
                codes.append(code)
                counts.append(n)
                waiting += len(code)
                if waiting > HELD:
                    code, n = _summed(codes, counts)
                    codes, counts, waiting = [code], [n], len(code)
                    if waiting > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(_signed(code)), pa.array(n)], names=["code", "n"])
                        codes, counts, waiting = [], [], 0
        if codes:
            code, n = _summed(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(code)), pa.array(n)], names=["code", "n"])

    return run


def _bitmap(codes: DataFrame) -> np.ndarray:
    """A bit for the first BITMAP bits of each code; Spark joins the bits of a word, so at most 2^(BITMAP - 6) rows arrive."""
    place = F.shiftrightunsigned("code", 64 - BITMAP)
    rows = codes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - BITMAP}) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


PATTERN = ["kind", "side", "code"]


def _trusted(edges: DataFrame, occurrences: DataFrame) -> DataFrame | None:
    """(value, n): the candidate values that the graph trusts, with the number of their patterns; None if there are none.

    edges (kind, side, code, value, seed, n) are distinct; occurrences (code, n) counts all of the corpus.
    """
    of_pattern = edges.groupBy(*PATTERN).agg(
        F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.col("seed").cast("long")).alias("support"), F.sum("n").alias("met"), F.count("*").alias("edges")
    )
    patterns = stash(of_pattern.where(F.col("edges") >= SUPPORT).join(occurrences.withColumnRenamed("n", "seen"), "code"))
    loose = edges.where(~F.col("seed"))
    known = patterns.where(F.col("edges") > F.col("support")).select(*PATTERN, F.col("edges").alias("m"))
    links = stash(met(loose.select(*PATTERN, "value", "n"), known, PATTERN, "m", max(1, loose.count())))
    total = links.count()
    trusted, before = None, 0
    for _ in range(ROUNDS if total else 0):
        now = patterns
        if trusted is not None:
            more = met(links, trusted, ["value"], "m", total).groupBy(*PATTERN).agg(F.sum("n").alias("hits_"), F.count("*").alias("support_"))
            now = patterns.join(more, PATTERN, "left").withColumn("hits", F.col("hits") + F.coalesce("hits_", F.lit(0))).withColumn("support", F.col("support") + F.coalesce("support_", F.lit(0)))
        # the share of occurrences, with one more that nothing follows; in millionths of a natural logarithm, so that sums are exact
        share = F.col("hits") / (F.col("hits") + F.greatest(F.col("seen") - F.col("met"), F.lit(0)) + 1)
        speaking = now.where((F.col("support") >= SUPPORT) & (share >= SPEAKS)).select(*PATTERN, F.round(-1e6 * F.log(1 - share)).cast("long").alias("says"), F.col("edges").alias("m"))
        heard = met(links, speaking, PATTERN, "m", total).groupBy("value").agg(F.sum("says").alias("says"), F.count("*").alias("m"))
        trusted = stash(heard.where(1 - F.exp(-F.col("says") / 1e6) >= ACCEPT).select("value", "m"))
        n = trusted.count()
        if n == before:
            break
        before = n
    return trusted if before else None


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every row of docs, which needs doc_id and text: arrays of (kind, start, end).

    Spans are in code points, end exclusive; kind counts in KINDS. `base` holds all strict spans, `added` what the patterns
    found, none of which overlaps a strict one. Null texts count as empty, other columns are ignored, repeated rows have
    rows of their own, an empty table gives an empty result. Contexts are told apart by a 64-bit hash: an equal hash of two
    words would join their counts.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = stash(
        docs.select("doc_id", "text").mapInArrow(common.releasing(_find), f"doc_id {kind}, mentions array<{MENTION}>").withColumn("row", F.monotonically_increasing_id())
    )
    mentions = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("code")) for i, c in enumerate(("before", "two", "after"))]))
    edges = stash(
        mentions.select("kind", "value", "seed", sides.alias("s")).where("s.code is not null")
        .groupBy("kind", "s.side", "s.code", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    )
    # of use are patterns that can find something: with SUPPORT instances, one of them a candidate
    often = edges.groupBy(*PATTERN).agg(F.count("*").alias("n"), F.min("seed").alias("seeds")).where((F.col("n") >= SUPPORT) & ~F.col("seeds")).select("code").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(often))
    counted = docs.select("text").where("text is not null").mapInArrow(common.releasing(_count(shared)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    trusted = _trusted(edges, counted)
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    told = found.select("row", "doc_id", F.transform(F.filter("mentions", lambda m: m["seed"]), span).alias("base"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    if trusted is None:
        return told.select("doc_id", "base", none.alias("added"))
    loose = mentions.where(~F.col("seed"))
    added = met(loose.select("row", "kind", "start", "end", "value"), loose.groupBy("value").agg(F.count("*").alias("n")).join(trusted.select("value"), "value"), ["value"], "n", max(1, loose.count()))
    of_row = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # of one document
    return told.join(of_row, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def span_digests(found: DataFrame) -> DataFrame:
    """The columns of op11 for the rows of personal_spans: counts of strict spans by kind, the SHA-256 of their list, and the
    list of all spans, each `kind:start:end` in order of start and kind."""
    name = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), F.size("added").alias("n_added"))
