"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers of three sorts vote on each for, against or not at all: format checks, gazetteers, and the words and characters
around it. Which vote patterns occur how often is one small table; expectation-maximisation on it estimates how reliable each labeler is for each kind and
how probable each pattern is personal data. A logistic span classifier is then trained on these probabilities, over votes and shape, and decides
on the spans that the fixed rules below don't settle. What the rules find stays in any case.

Work grows with a text's length and its spans, not with their product: places are running sums and maxima worked out in blocks, and characters around a span are
cut from pieces of the text of a fixed length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ["email", "ip", "card", "phone"]
#: What a base span of each kind looks like. Possessive forms and the look-behinds change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further forms, which only the classifier can accept.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(](?i:dot)[\])] ?)[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?[\[(](?:\.|(?i:dot))[\])] ?[0-9]{1,3}+){3}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z._/*-])[0-9]{4}([._/*]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z]|[._/*-][0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
}
TOP_LEVEL = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "co", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "ru", "pl", "se", "no", "dk", "fi", "pt"]
CALLING = ["1", "7", "20", "27", "3[0-469]", "4[013-9]", "5[1-8]", "6[0-6]", "8[1246]", "9[0-58]", "21[1368]", "2[2-69][0-9]", "35[0-9]", "37[0-9]", "38[0-9]", "42[0-9]", "50[0-9]", "59[0-9]", "67[0-9]", "68[0-9]", "85[0-9]", "88[06]", "96[0-9]", "97[0-9]", "99[0-9]"]
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62|30[0-5]|36|38)"
WORDS_FOR = {"email": "mail|contact|write|reach|address|from:|to:", "ip": r"\bip\b|address|host|server|login|client|addr", "card": r"card|visa|master|amex|credit|debit|pay|\bcc\b", "phone": "phone|call|tel|mobile|cell|fax|contact|dial|whatsapp|reach"}
WORDS_AGAINST = r"version|release|chapter|section|isbn|issn|order|invoice|token|hash|sha-?[0-9]*\b|commit|serial|build|page"
CONTEXT = 40
VOTES = ["format", "gazetteer", "context", "edges"]


#: Characters of a piece that single characters and contexts are cut from, and elements of a block of running values.
PIECE, BLOCK = 1_024, 128


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step) -> Column:
    """For each element of values (longs) what step has made of start and all elements before it; step must be associative with start as its neutral element. One pass over
    blocks and one over what they come to, since an array that grows by one element is copied each time."""
    none = F.array().cast("array<bigint>")

    def scan(block: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("to"), none.alias("out")), lambda a, v: F.struct(step(a["to"], v).alias("to"), F.concat(a["out"], F.array(a["to"])).alias("out")))

    def blockwise(v: Column) -> Column:
        begins = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(begins, lambda k: scan(part_of(v, k * BLOCK, F.least((k + 1) * BLOCK, F.size(v)) - 1))), joined)

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: p["to"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: step(b, x))))

    return let(values, blockwise)


def zero() -> Column:
    return F.lit(0).cast("long")


def spans_of(text: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches of pattern as (begin, end, found), in code points, from the pieces between them."""
    t = F.col(text)
    found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).cast("long").alias("g"), F.char_length(m).cast("long").alias("n")))
    empty = F.expr("CAST(array() AS array<struct<begin: bigint, end: bigint, found: string>>)")

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["g"] + x["n"]), zero(), lambda a, b: a + b)
        return F.zip_with(p, before, lambda x, b: F.struct((b + x["g"]).alias("begin"), (b + x["g"] + x["n"]).alias("end"), x["m"].alias("found")))

    return F.when(t.rlike(pattern), let(pairs, placed)).otherwise(empty)


def pieces_of(text: Column) -> Column:
    """text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(array: Column, first: Column, last: Column) -> Column:
    """The elements from first to last (from 0, both inclusive). slice() would go through the whole array each time."""
    return F.transform(F.sequence(first, last), lambda k: F.get(array, k))


def cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The characters from begin to end (exclusive; both longs), from the pieces they lie in."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor((F.greatest(end, begin + 1) - 1) / PIECE).cast("int")
    inside = F.array_join(part_of(pieces, first, last), "")
    return F.when(end > begin, F.substring(inside, (begin - first * PIECE + 1).cast("int"), (end - begin).cast("int"))).otherwise("")


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.char_length(number)

    def digit(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """What a base match must satisfy besides its pattern."""
    if kind == "ip":
        return found.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    n = F.char_length(digits(found))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(found))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0).cast("tinyint")


def gazetteer(kind: str, found: Column) -> Column:
    if kind == "email":
        ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        return vote(ending.isin(TOP_LEVEL), ending.rlike("^[0-9-]+$"))
    if kind == "ip":
        reserved = found.rlike(r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.")
        return vote(~reserved & passes("ip", found), ~passes("ip", found))
    if kind == "card":
        return vote(digits(found).rlike(ISSUERS) & F.char_length(digits(found)).between(13, 19), F.lit(True))
    known = digits(found).rlike("^(?:" + "|".join(CALLING) + ")")
    return F.when(found.startswith("+"), vote(known, ~known)).otherwise(vote(digits(found).rlike("^[2-9][0-9]{2}[2-9]"), F.lit(True)))


def judged(pieces: Column, kind: str, spans: Column, base: bool) -> Column:
    """Spans with their kind's number, whether they are base spans, votes, and shape (a small number)."""

    def one(s: Column) -> Column:
        before = F.lower(cut(pieces, F.greatest(s["begin"] - CONTEXT, zero()), s["begin"]))
        around = F.concat(cut(pieces, F.greatest(s["begin"] - 1, zero()), s["begin"]), F.lit(" "), cut(pieces, s["end"], s["end"] + 1))
        good = passes(kind, s["found"])
        if not base:
            plain = digits(s["found"])
            good = {"email": F.lit(True), "ip": passes("ip", F.regexp_replace(s["found"], "[^0-9]+", ".")), "card": passes("card", plain), "phone": plain.rlike("^[2-9][0-9]{9}$")}[kind]
        n = F.char_length(digits(s["found"]))
        known = gazetteer(kind, s["found"] if base or kind != "ip" else F.regexp_replace(s["found"], "[^0-9]+", "."))
        return F.struct(
            F.lit(KINDS.index(kind)).cast("tinyint").alias("kind"),
            s["begin"].alias("begin"),
            s["end"].alias("end"),
            (good if base else F.lit(False)).alias("base"),
            vote(good, ~good).alias("format"),
            known.alias("gazetteer"),
            vote(before.rlike(WORDS_FOR[kind]), before.rlike(WORDS_AGAINST)).alias("context"),
            vote(~around.rlike(r"[\p{L}\p{N}_]"), around.rlike(r"[A-Za-z0-9_]")).alias("edges"),
            (F.when(n < 9, 0).when(n < 13, 1).otherwise(2) * 2 + s["found"].rlike("[ ().-]").cast("int")).cast("tinyint").alias("shape"),
        )

    # a run of a few digits is no candidate for a card
    wanted = F.filter(spans, lambda s: F.char_length(digits(s["found"])) >= 12) if kind == "card" else spans
    return F.transform(wanted, one)


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and candidates: all proposed spans of each row with votes."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    forms = [(k, p, True) for k, p in BASE.items()] + [(k, p, False) for k, p in MORE.items()]
    found = src.select("*", *[spans_of("__t", p).alias(f"__{i}") for i, (_, p, _) in enumerate(forms)])
    some = F.greatest(*[F.size(f"__{i}") for i in range(len(forms))]) > 0
    found = found.withColumn("__pieces", F.when(some, pieces_of(F.col("__t"))).otherwise(F.array().cast("array<string>")))
    joined = F.concat(*[judged(F.col("__pieces"), k, F.col(f"__{i}"), base) for i, (k, _, base) in enumerate(forms)])
    return found.select(*[F.col(f"`{c}`") for c in keep], joined.alias("candidates"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Dawid and Skene's expectation-maximisation: from counted (kind, votes...) to the probability of each being personal data. Abstaining says nothing."""
    if not patterns:
        return {}
    n_votes = len(patterns[0][0]) - 1
    belief = {p: (1 + sum(v > 0 for v in p[1:])) / (2 + sum(v != 0 for v in p[1:])) for p, _ in patterns}
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        says: dict[tuple[int, int, int], list[float]] = {}
        for p, n in patterns:
            a = prior.setdefault(p[0], [1.0, 2.0])
            a[0] += n * belief[p]
            a[1] += n
            for j in range(n_votes):
                if p[j + 1]:
                    for truth, share in ((1, belief[p]), (0, 1 - belief[p])):
                        # a prior of agreement with the truth keeps the labels from changing places
                        b = says.setdefault((p[0], j, truth), [18.0 if truth else 2.0, 20.0])
                        b[0] += n * share * (p[j + 1] > 0)
                        b[1] += n * share
        new = {}
        for p, _ in patterns:
            odds = math.log(prior[p[0]][0] / prior[p[0]][1]) - math.log(1 - prior[p[0]][0] / prior[p[0]][1])
            for j in range(n_votes):
                if p[j + 1]:
                    yes, no = (says[p[0], j, truth][0] / says[p[0], j, truth][1] for truth in (1, 0))
                    odds += math.log(yes / no) if p[j + 1] > 0 else math.log((1 - yes) / (1 - no))
            new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        change = max(abs(new[p] - belief[p]) for p in new)
        belief = new
        if change < 1e-6:
            break
    return belief


def features(kind: int, votes: tuple[int, ...], shape: int) -> list[float]:
    return [*(float(kind == k) for k in range(len(KINDS))), *(float(v) for v in votes), *(float(shape // 2 == k) for k in range(3)), float(shape % 2)]


def train(rows: list[tuple[list[float], float, float]], rounds: int = 200, decay: float = 0.1) -> list[float]:
    """Logistic regression by gradient steps on (features, weight, probability); weights are tempered so that common patterns don't drown rare ones."""
    w = [0.0] * (len(rows[0][0]) if rows else len(features(0, (0,) * len(VOTES), 0)))
    total = sum(math.sqrt(n) for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        slope = [decay * x / total for x in w]
        for f, n, p in rows:
            off = math.sqrt(n) / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) - p)
            for k, x in enumerate(f):
                slope[k] += off * x
        w = [a - 2.0 * b for a, b in zip(w, slope, strict=True)]
    return w


def apart(spans: Column) -> Column:
    """Those of spans (k, begin, end, base) that aren't base and overlap no base span."""
    sides = F.sort_array(F.transform(spans, lambda c: F.struct(c["begin"].alias("begin"), c["end"].alias("end"), c["base"].alias("base"), c["k"].alias("k"))))
    most = F.lit((1 << 62)).cast("long")

    def inside(ordered: Column) -> Column:
        reached = running(F.transform(ordered, lambda c: F.when(c["base"], c["end"]).otherwise(zero())), zero(), F.greatest)
        # the next base span's begin: from the other end
        ahead = F.reverse(running(F.transform(F.reverse(ordered), lambda c: F.when(c["base"], c["begin"]).otherwise(most)), most, F.least))
        placed = F.zip_with(ordered, F.arrays_zip(reached.alias("reached"), ahead.alias("ahead")), lambda c, r: F.struct(c.alias("c"), r["reached"].alias("reached"), r["ahead"].alias("ahead")))
        return F.transform(F.filter(placed, lambda p: ~p["c"]["base"] & (p["reached"] <= p["c"]["begin"]) & (p["ahead"] >= p["c"]["end"])), lambda p: F.struct(p["c"]["k"].alias("k"), p["c"]["begin"].alias("begin"), p["c"]["end"].alias("end"), p["c"]["base"].alias("base")))

    free = let(sides, inside)
    return F.when(F.exists(spans, lambda c: ~c["base"]), free).otherwise(F.filter(spans, lambda c: F.lit(False)))


def find_personal(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """keep (all columns if not given) and spans: array of (kind, begin, end, base) by kind as in KINDS, then begin; begin and end in code points, end exclusive.
    Spans beyond the fixed rules need a probability over least and no overlap with one of these.

    A null or empty text has no spans; repeated rows are searched each and get the same spans; a column of keep named spans gives way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    found = stash(candidates(docs, text, keep), "candidates")
    one = found.select(F.explode("candidates").alias("c")).select("c.*")
    seen = one.groupBy("kind", *VOTES, "shape").count().collect()
    patterns: dict[tuple[int, ...], int] = {}
    for r in seen:
        p = (r["kind"], *(r[v] for v in VOTES))
        patterns[p] = patterns.get(p, 0) + r["count"]
    belief = reliabilities(sorted(patterns.items()))
    weights = train([(features(r["kind"], tuple(r[v] for v in VOTES), r["shape"]), float(r["count"]), belief[(r["kind"], *(r[v] for v in VOTES))]) for r in sorted(seen)])
    names = F.array(*[F.lit(k) for k in KINDS])

    def accepted(c: Column) -> Column:
        terms = [(c["kind"] == k).cast("double") for k in range(len(KINDS))] + [c[v].cast("double") for v in VOTES] + [(F.floor(c["shape"] / 2) == k).cast("double") for k in range(3)] + [(c["shape"] % 2).cast("double")]
        return sum((t * F.lit(w) for t, w in zip(terms, weights, strict=True)), F.lit(0.0)) > math.log(least / (1 - least))

    slim = lambda c: F.struct(c["kind"].alias("k"), c["begin"].alias("begin"), c["end"].alias("end"), c["base"].alias("base"))
    found = found.withColumn("__chosen", F.transform(F.filter("candidates", lambda c: c["base"] | accepted(c)), slim))
    ordered = F.sort_array(F.concat(F.filter("__chosen", lambda c: c["base"]), apart(F.col("__chosen"))))
    named = F.transform(ordered, lambda c: F.struct(F.element_at(names, c["k"].cast("int") + 1).alias("kind"), c["begin"].alias("begin"), c["end"].alias("end"), c["base"].alias("base")))
    return found.select(*[F.col(f"`{c}`") for c in keep], named.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:begin:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: Column) -> Column:
    """text with each span, or run of overlapping ones, replaced by the first one's kind in angle brackets. Null stays null."""
    t = F.col(f"`{text}`")
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["begin"].alias("b"), s["end"].alias("e"), s["kind"].alias("k"))))

    def built(x: Column) -> Column:
        reached = running(F.transform(x["spans"], lambda s: s["e"]), zero(), F.greatest)
        parts = F.zip_with(x["spans"], reached, lambda s, r: F.when(s["b"] < r, "").otherwise(F.concat(cut(x["pieces"], r, s["b"]), F.lit("<"), s["k"], F.lit(">"))))
        end = F.array_max(F.transform(x["spans"], lambda s: s["e"]))
        return F.concat(F.array_join(parts, ""), cut(x["pieces"], end, x["n"]))

    whole = F.struct(ordered.alias("spans"), pieces_of(t).alias("pieces"), F.char_length(t).cast("long").alias("n"))
    return F.when(F.size(spans) > 0, let(whole, built)).otherwise(t)
