"""Personal data in texts: pattern matches, and spans that a conditional random field adds."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .shared import text_batches

#: Kinds in the order in which spans of one start are listed, and the base patterns; fixed values.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match can only begin where its digits do, and takes whole parts
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")
#: What _valid accepts holds one of these.
_TRIGGER = re.compile(r"[0-9@]+|[\[(]at[\])]", re.I)
#: Tokens beside a stretch that are tried for one that is surely "none", context included, and characters read for them.
_MARGIN, _REACH = 12, 96
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    """Whether digits, however many, are at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What a left-to-right search finds, from the @ signs outwards: the local part is the run of its characters that ends there."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            s = at
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                done = m.end()
                yield s, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


def labelled_table(n: int = 360, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table that the field learns from: invented lines with marked data and look-alikes."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["ta", "er", "in", "on", "lé", "sch", "que", "ión", "the", "mi"]) for _ in range(rng.randint(1, 4)))
    host = lambda: f"{word()}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'org', 'net', 'com'])}"
    octet = lambda: str(rng.randint(0, 255))
    made = {
        "email": [lambda: f"{word()}.{digits(2)}@{host()}", lambda: f"{word()}@{host()}", lambda: f"{word()} [at] {host()}", lambda: f"{word()}(at){host()}", lambda: f"{word()} @ {host()}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: " . ".join(octet() for _ in range(4))],
        "card": [lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)), lambda: ".".join(digits(4) for _ in range(4))],
        "phone": [lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{digits(2)} {digits(2)} {digits(7)}", lambda: f"{rng.choice(['tel', 'phone', 'call', 'fax'])} 0{digits(2)} {digits(7)}"],
    }
    other = [lambda: f"Version {digits(1)}.{digits(1)}", lambda: f"version {digits(1)}.", lambda: f"CC BY-NC {digits(1)}.0", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)} %", lambda: digits(rng.randint(1, 5)), lambda: f"§ {digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()} @ {word()}", lambda: f"{digits(1)} - {digits(1)} ({digits(2)})", lambda: f"{digits(3)} {digits(4)}"]
    table = []
    for i in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.randint(1, 3)):
            kind = KINDS[i % 4] if rng.random() < 0.6 else None
            value = rng.choice(made[kind] if kind else other)()
            text += " " * bool(text)
            lead = re.match("(tel|phone|call|fax) ", value) if kind else None
            if kind:
                spans.append((len(text) + (lead.end() if lead else 0), len(text) + len(value), kind))
            text += value + rng.choice(["", "", ".", ",", "%%%"]) + " " + " ".join(word() for _ in range(rng.randint(0, 4)))
            text = text.rstrip() if rng.random() < 0.5 else text
        table.append((text, spans))
    return table


@lru_cache(1)
def default_model() -> crf.Model:
    return crf.train(labelled_table(), KINDS)


def _run_start(text: str, at: int) -> int:
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def _run_end(text: str, at: int) -> int:
    m = _SPACE.search(text, at)
    return m.start() if m else len(text)


def _before(text: str, at: int, model: crf.Model) -> int:
    """Where to begin for a run that starts at `at`: before a token that is surely "none" in the whole text."""
    while at > 0:
        lo = _run_start(text, max(0, at - _REACH))
        if lo == 0:
            return 0
        part = text[lo:at]
        if len(spans := crf.tokens(part)) >= _MARGIN and model.settles(tuple(crf.shapes(part, spans)[-_MARGIN:])):
            return _run_start(text, lo + spans[-_MARGIN][0])
        at = _run_start(text, (lo + at) // 2)
    return 0


def _after(text: str, at: int, model: crf.Model) -> int:
    """Where to end for a run that ends at `at`: behind a token that is surely "none" in the whole text."""
    while at < len(text):
        hi = _run_end(text, min(len(text), at + _REACH))
        if hi == len(text):
            return hi
        part = text[at:hi]
        if len(spans := crf.tokens(part)) >= _MARGIN and model.settles(tuple(crf.shapes(part, spans)[:_MARGIN])):
            return _run_end(text, at + spans[_MARGIN - 1][1])
        at = _run_end(text, (at + hi) // 2)
    return len(text)


def _segments(text: str, model: crf.Model) -> list[tuple[int, int]]:
    """Stretches of whole runs between white space around digits, @ signs and their spellings.

    At either end of a stretch, unless it is that of the text, the best path of the whole text passes a token whose
    label is surely "none"; what lies between the two is decoded as in the whole text.
    """
    out: list[tuple[int, int]] = []
    hi, lo = -1, 0
    upto = -1
    for m in _TRIGGER.finditer(text):
        if m.end() <= upto:
            continue
        if m.start() >= hi:
            if hi >= 0:
                out.append((lo, hi))
            lo = _before(text, _run_start(text, m.start()), model)
        upto = _run_end(text, m.end())
        hi = _after(text, upto, model)
    if hi >= 0:
        out.append((lo, hi))
    return out


def _valid(kind: str, value: str) -> bool:
    digits = _DIGIT.sub("", value)
    if kind == "email":
        return bool(re.search(r"@|[\[(]at[\])]", value, re.I)) and bool(re.search(r"[A-Za-z0-9]\.[A-Za-z]{2,}$", value))
    if kind == "ip":
        return len(p := re.findall("[0-9]+", value)) == 4 and all(len(x) < 4 and int(x) <= 255 for x in p)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and value.count("(") == value.count(")")


def added_spans(texts: list[str], model: crf.Model, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds outside the base spans and what the form of its kind bears out."""
    where, emissions, at = [], [], []
    for i, text in enumerate(texts):
        for lo, hi in _segments(text, model):
            part = text[lo:hi]
            spans = crf.tokens(part)
            emissions.append(model.emissions(crf.shapes(part, spans)))
            where.append((i, lo))
            at.append(spans)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, lo), spans, path in zip(where, at, model.decode(emissions), strict=True):
        j = 0
        while j < len(path):
            if not path[j]:
                j += 1
                continue
            kind, k = (int(path[j]) - 1) // 2, j + 1
            while k < len(path) and path[k] == 2 * kind + 2:
                k += 1
            s, e = lo + spans[j][0], lo + spans[k - 1][1]
            if _valid(KINDS[kind], texts[i][s:e]) and all(e <= b[0] or s >= b[2] for b in base[i]):
                out[i].append((s, kind, e))
            j = k
    return out


def spans_of(texts: list[str | None], model: crf.Model) -> tuple[list, list]:
    """Base spans and added spans of each text."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in whole]
    return base, added_spans(whole, model, base)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of whole texts: doc_id, n_<kind> and base_sha256 of the pattern matches, spans of all, and `keep`.

    The model has some thousand weights, learnt from labelled_table() in a second, and goes with the tasks. Texts
    are read whole, a few megabytes at a time. Viterbi runs on stretches around digits, @ signs and [at]: each goes on
    to tokens that are "none" whatever lies beyond, so that its spans are those of the whole text. Null and empty texts
    have no spans (the digest is that of the empty string); repeated rows count one by one; null ids are kept.
    """
    model = default_model()
    kept = [f"_keep_{i}" for i in range(len(keep))]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    extra = "".join(f", {k} {source.schema[k].dataType.simpleString()}" for k in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf):
                part = part.reset_index(drop=True)
                base, more = spans_of(part["text"].tolist(), model)
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64")})
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"] = [sum(x[1] == k for x in b) for b in base]
                out["base_sha256"] = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
                out["spans"] = [_listed(b + m) for b, m in zip(base, more, strict=True)]
                for k in kept:
                    out[k] = part[k]
                yield out

    return source.mapInPandas(run, schema + extra).withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones merged, replaced by the name of its (first) kind in angle brackets."""
    merged: list[list[int]] = []
    for s, kind, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in reversed(merged):
        text = f"{text[:s]}<{KINDS[kind]}>{text[e:]}"
    return text


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with the personal data in `text_col` replaced by tags. Null texts stay null."""
    model = default_model()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[str | None] = []
            for part in text_batches(texts.to_frame("text")):
                values = part["text"].tolist()
                base, more = spans_of(values, model)
                out += [redact_text(t, b + m) if t else t for t, b, m in zip(values, base, more, strict=True)]
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col).cast("string")))
