"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation
estimates how far each can be relied on, and a span classifier learns from what that makes likely.

Base spans (strict forms that pass their check) always stay. Candidates are base matches, matches
that failed their check, and looser forms. Regular expressions, gazetteers and context each vote for,
against or not at all. Votes are counted over all documents; a classifier on shape and context is
fitted to the posteriors of a bounded sample of distinct feature rows and decides on the looser ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, stored, texts_of, worker_cache

KINDS = ("email", "ip", "card", "phone")
#: Distinct feature rows that the classifier is fitted on; its probability from which a looser span is
#: added; its hashed features.
SAMPLE_GROUPS, ADD, BUCKETS = 40_000, 0.8, 4096
CONTEXT = 48

# Top-level domains, calling codes, issuer prefixes, first parts of addresses that no host has.
DOMAINS = frozenset("app at au be biz br ca ch cn co com de dev dk edu es eu fi fr gov ie in info int io it jp kr me mil mx net nl no nz org pl pt ru se uk us".split())
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "98")
ISSUERS = ("2", "34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "64", "65")
NO_HOSTS = frozenset((0, 127, 255))
#: Words before a span that speak for its kind, and words that speak for something else.
SPEAKS_FOR = {
    "email": frozenset("contact correo courriel e email kontakt mail mailto write schreib".split()),
    "ip": frozenset("address adresse dirección host ip login server".split()),
    "card": frozenset("card carte credit karte kreditkarte payment tarjeta visa mastercard amex".split()),
    "phone": frozenset("call cell fax mobile phone ring tel telefon telephone teléfono téléphone".split()),
}
SPEAKS_AGAINST = frozenset("build chapter commit hash id invoice isbn key order release section secret sha token version".split())

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9][0-9 -]{10,}+")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[({<] ?(?:at|AT|At) ?[\])}>] ?| ?@ | @| (?:at|AT) ")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?: ?[\[({<] ?(?:dot|DOT|Dot|\.) ?[\])}>] ?|\.| (?:dot|DOT) )[A-Za-z0-9-]{1,63}+)++")
_SPELT_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SPELT_CARD = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:(?:\s{1,2}| - |[./_-])[0-9]{4}){3}|[0-9]{13,19})(?![0-9A-Za-z])")
_SPELT_PHONE = re.compile(
    r"\+[0-9]{1,3}[\s.-]{0,2}\(?[0-9]{2,5}\)?[\s.-]{0,2}[0-9]{3,4}[\s.-][0-9]{3,5}(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\) ?|00 ?[0-9]{1,3}[ ./-]|[0-9]{3,5}[ ./-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z]|[.-][0-9])"
)
_ALL_DIGITS, _WORDS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int, bool]  # start, kind, end, base


def digits_of(text: str) -> str:
    return "".join(_ALL_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    """Whether a number ends in its check digit: from the right, every second digit counts twice, cross-summed."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def strict_forms(text: str) -> Iterator[Span]:
    """Leftmost matches that do not overlap, for each kind, and whether they pass their check. Long
    runs are read once: an address is found from its @ to both sides, numbers by their whole run."""
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            back, step = at, 64
            while back > end:  # the run of local characters before the @, in growing steps
                low, stop = max(end, back - step), None
                for stop in _NOT_LOCAL.finditer(text, low, back):
                    pass
                if stop:
                    back = stop.end()
                    break
                back, step = low, step * 2
            if back < at:
                yield back, 0, m.end(), True
                end = m.end()
        at = text.find("@", max(at + 1, end))
    if _ALL_DIGITS.search(text):
        for m in _DOTTED.finditer(text):
            places = [m.start(), *(m.start() + k + 1 for k, c in enumerate(m[0]) if c == "."), m.end() + 1]
            for k in range(0, len(places) - 4, 4):
                parts = [text[a : b - 1] for a, b in pairwise(places[k : k + 5])]
                yield places[k], 1, places[k + 4] - 1, all(map(_octet, parts))
        for run in _DIGITS.finditer(text):
            for m in _CARD.finditer(text, run.start(), run.end()):
                if m.end() - m.start() >= 12:
                    digits = digits_of(m[0])
                    yield m.start(), 2, m.end(), 12 <= len(digits) <= 19 and luhn(digits)
        for m in _PHONE.finditer(text):
            yield m.start(), 3, m.end(), 9 <= len(digits_of(m[0])) <= 15


def looser_forms(text: str) -> Iterator[Span]:
    """Spelt-out and local forms, and such as strict forms run over: numbers beside other numbers, or
    broken by a line end."""
    if "at" in text or "AT" in text or "At" in text or "@" in text:
        for m in _AT.finditer(text):
            domain = _SPELT_DOMAIN.match(text, m.end())
            if domain:
                low = max(0, m.start() - 64)
                local = _LOCAL.search(text, max([low, *(x.end() for x in _NOT_LOCAL.finditer(text, low, m.start()))]), m.start())
                if local and local[0]:
                    yield local.start(), 0, domain.end(), False
    if _ALL_DIGITS.search(text):
        for kind, form in ((1, _SPELT_IP), (2, _SPELT_CARD), (3, _SPELT_PHONE)):
            for m in form.finditer(text):
                yield m.start(), kind, m.end(), False


def candidates(text: str) -> list[Span]:
    """Base spans, and other candidates that overlap neither a base span nor an earlier candidate."""
    strict = sorted(strict_forms(text))
    out = [s for s in strict if s[3]]
    taken = sorted((s[0], s[2]) for s in out)
    covered: list[tuple[int, int]] = []  # base spans of all kinds, joined
    for a, b in taken:
        if covered and a < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    order = lambda s: (s[0], s[1], -s[2])
    for more in (looser_forms(text), (s for s in strict if not s[3])):  # a match that failed hides no looser one in it
        found, k = [], 0
        for s in sorted(set(more), key=order):
            while k < len(covered) and covered[k][1] <= s[0]:
                k += 1
            if (not found or s[0] >= found[-1][2]) and (k == len(covered) or covered[k][0] >= s[2]):
                found.append(s)
        out += found
        covered = sorted([*covered, *((s[0], s[2]) for s in found)])
    return sorted(out)


LABELERS = ("strict form", "check", "gazetteer", "words for", "words against", "edges", "variety")
NO_VOTE, AGAINST, FOR = 0, 1, 2


def votes_of(text: str, span: Span) -> list[int]:
    """One vote for each of LABELERS."""
    start, kind, end, base = span
    body = text[start:end]
    digits = digits_of(body)
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT) : start])]
    if kind == 0:
        name = _WORDS.findall(body)[-1:] or [""]
        checked, known = "@" in body or bool(re.search(r"[\[({<]", body)), name[0].lower() in DOMAINS
    elif kind == 1:
        parts = _ALL_DIGITS.findall(body)
        wide = ":" in body
        checked, known = wide or all(map(_octet, parts)), wide or (_octet(parts[0]) and int(parts[0].lstrip("0") or "0") not in NO_HOSTS)
    elif kind == 2:
        checked, known = 12 <= len(digits) <= 19 and luhn(digits), digits.startswith(ISSUERS)
    else:
        checked, code = 9 <= len(digits) <= 15, digits.lstrip("0")
        known = code.startswith(CALLING_CODES) if body[0] == "+" or body[:2] == "00" else body[0] == "(" and code == digits
        if checked and body[0] not in "+(0":
            checked = None  # of bare groups of digits their number says little
    joined = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    plain = len(set(digits)) <= 2 if kind >= 2 else False
    return [
        FOR if base else NO_VOTE,
        NO_VOTE if checked is None else FOR if checked else AGAINST,
        NO_VOTE if known is None else FOR if known else AGAINST,
        FOR if SPEAKS_FOR[KINDS[kind]].intersection(before[-4:]) else NO_VOTE,
        AGAINST if SPEAKS_AGAINST.intersection(before[-3:]) else NO_VOTE,
        AGAINST if joined else NO_VOTE,
        AGAINST if plain else NO_VOTE,
    ]


def features_of(text: str, span: Span, votes: list[int]) -> list[int]:
    """Hashed features of a span's shape and context; those of the votes join them, but for the first:
    whether a span is a base one is no feature, so that what is learnt from base spans carries over."""
    start, kind, end, _ = span
    body = text[start:end]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", body))[:40]
    word = [w.lower() for w in _WORDS.findall(text[max(0, start - CONTEXT) : start])][-1:]
    marks = sorted(set(re.sub(r"[A-Za-z0-9]", "", body)))
    own = ["", f"n{len(digits_of(body))}", f"s{shape}", f"w{word}", f"b{text[start - 1 : start] if start else '^'}", f"e{text[end : end + 1]}", *(f"m{c}" for c in marks), *(f"v{k}{v}" for k, v in enumerate(votes) if k)]
    return sorted({zlib.crc32(f"{kind}{x}".encode()) % BUCKETS for x in own})


SCANNED = "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:array<int>>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row: its candidates by start, with packed votes and features."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_cache("")
        for part in gathered(batches, 4 << 20):
            rows = []
            for text in part.column(1):
                text, found = text.as_py() or "", []
                for span in candidates(text):
                    votes = votes_of(text, span)
                    found.append({"kind": span[1], "start": span[0], "end": span[2], "base": span[3], "votes": sum(v * 3**k for k, v in enumerate(votes)), "features": features_of(text, span, votes)})
                rows.append(found)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCANNED)


def unpacked(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation on vote patterns (n, labelers) with counts: (p[class, labeler, vote],
    the share of class 1, each pattern's probability of class 1). It starts from the majority;
    pseudo-counts hold a labeler to be better than chance where it says nothing of the kind. A
    labeler that does not vote says nothing."""
    prior = np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]])[:, None, :]
    chosen = (votes[:, :, None] == np.arange(3)).astype(np.float64)
    belief = 1 / (1 + np.exp(-2.0 * (chosen[:, :, FOR].sum(1) - 2 * chosen[:, :, AGAINST].sum(1))))
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * counts, belief * counts])
        p = np.einsum("cn,nlv->clv", weight, chosen) + prior
        p /= p.sum(2, keepdims=True)
        cast = np.log(p[:, :, AGAINST:] / p[:, :, AGAINST:].sum(2, keepdims=True))
        share = float(np.clip(weight[1].sum() / counts.sum(), 0.05, 0.95))
        odds = np.log(share / (1 - share)) + np.einsum("nlv,lv->n", chosen[:, :, AGAINST:], cast[1] - cast[0])
        belief = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return p, share, belief


def fitted(features: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier on sparse 0/1 features and soft targets, by full gradients
    with steps that adapt to each weight."""
    sizes = np.array([len(f) for f in features])
    column, row = np.concatenate([np.array(f, np.int64) for f in features]), np.repeat(np.arange(len(features)), sizes)
    w, seen, weight = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(sizes)), -40, 40)))
        g = np.bincount(column, ((p - target) * weight)[row], BUCKETS) + decay * w / len(sizes)
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def train(found: DataFrame, most_groups: int = SAMPLE_GROUPS) -> tuple[dict[str, dict[str, dict[str, float]]], np.ndarray | None]:
    """(reliabilities by kind and labeler, classifier weights) of `scanned` rows. Vote patterns, at
    most 3**7 for each kind, are counted over all of them; the classifier sees at most `most_groups`
    distinct rows of features, in the order of their hash, with their counts."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns: dict[int, list[tuple[int, int]]] = {}
    for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        patterns.setdefault(r["kind"], []).append((r["votes"], r["n"]))
    belief: dict[tuple[int, int], float] = {}
    report: dict[str, dict[str, dict[str, float]]] = {}
    for kind, rows in sorted(patterns.items()):
        rows.sort()
        votes, counts = np.array([v for v, _ in rows]), np.array([float(n) for _, n in rows])
        p, _, posterior = reliabilities(unpacked(votes), counts)
        belief |= {(kind, v): float(b) for v, b in zip(votes.tolist(), posterior)}
        report[KINDS[kind]] = {name: {"for_if_private": float(p[1, k, FOR]), "against_if_not": float(p[0, k, AGAINST])} for k, name in enumerate(LABELERS)}
    if not belief:
        return report, None
    groups = spans.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    sample = groups.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(most_groups).collect()
    target = np.array([belief[r["kind"], r["votes"]] for r in sample])
    return report, fitted([r["features"] for r in sample], target, np.sqrt([float(r["n"]) for r in sample]))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add: float = ADD) -> DataFrame:
    """(doc_id, spans) of every row: spans (kind, start, end, base, score) by start and kind, in code
    points with the end excluded. Base spans are all there; looser ones are where the classifier
    gives them `add` or more.

    A null text is an empty one, without spans. Repeated rows and null ids get a row each; further
    columns are left out; an empty table gives an empty result. Whole texts are read, in time linear
    in their length.
    """
    found = stored(scanned(docs, id_col, text_col), "private-candidates")
    _, w = train(found)
    shared = found.sparkSession.sparkContext.broadcast(w)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in batches:
            rows = []
            for spans in part.column(1).to_pylist():
                out = []
                for s in spans:
                    score = float(1 / (1 + np.exp(-w[s["features"]].sum())))
                    if s["base"] or score >= add:
                        out.append({"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["base"], "score": score})
                rows.append(out)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Text whose spans give way to their kinds in brackets; of overlapping spans the first names it."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): base spans counted by
    kind and digested, all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return private_spans(docs).select("doc_id", *map(number, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), added)
