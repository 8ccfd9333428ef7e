"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns (email, ip, card, phone) give base spans. The field labels every token of every whole text by word-shape
features, is trained from a small labelled table, and is decoded by Viterbi in numpy batches; its spans (written-out email
addresses, phone numbers without a plus sign, social security numbers) are added where they overlap no base span. Tokens
are runs of letters, runs of digits, and single other characters; tokens and features of a batch of texts are computed
as arrays.

Nulls and empty texts have no spans. Offsets count code points, ends are exclusive. Repeated rows keep their rows, an
empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.common import bounded, worker_cache
from sparkmine.llm.encode import batches

KINDS = ("email", "ip", "card", "phone", "ssn")
#: Labels of the field: O, then beginning and inside of each kind.
LABELS = ["O", *[f"{x}-{k}" for k in ("email", "phone", "ssn") for x in "BI"]]
FEATURE_BITS, SENTENCES, SEED = 13, 500, 7

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed; failing matches are dropped and not retried."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the field -------------------------------------------------------------------------------------------------------

# Words that stand by themselves; of others only case and length count.
WORDS = ("at", "dot", "com", "org", "net", "edu", "mail", "email", "e", "phone", "tel", "call", "fax", "mobile", "ssn", "social", "security", "card", "visa", "ip", "host", "page", "no", "nr", "version", "date", "year", "isbn", "price", "order", "id", "v")
_SPECIAL, _FIRST, _LAST = 1 << 21, (1 << 22) + 1, (1 << 22) + 2


def _tables() -> dict[str, np.ndarray]:
    """By code point: class (0 blank, 1 letter, 2 digit, 3 other), lower case, whether upper; and hashes of WORDS."""
    cache = worker_cache("pii")
    if "kind" not in cache:
        kind = np.full(0x110000, 3, np.uint8)
        kind[[c for c in range(0x3100) if chr(c).isspace()]] = 0
        lower, upper = np.arange(0x250, dtype=np.uint64), np.zeros(0x110000, bool)
        for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)):
            kind[c], lower[c], upper[c] = 1, ord(chr(c).lower()[0]), chr(c).isupper()
        kind[48:58] = 2
        powers = np.cumprod(np.full(max(map(len, WORDS)) + 1, 0x100000001B3, np.uint64), dtype=np.uint64)
        hashes = np.array([(np.array([ord(c) for c in w], np.uint64) * powers[: len(w)]).sum(dtype=np.uint64) for w in WORDS], np.uint64)
        order = np.argsort(hashes)
        cache |= {"kind": kind, "lower": lower, "upper": upper, "powers": powers, "words": hashes[order], "number": order}
    return cache


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (code points within their text), shape and number of the text of every token."""
    t = _tables()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = t["kind"][codes]
    opens = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 3)])
    at = np.flatnonzero(opens)
    end = np.append(at[1:], len(codes))
    real = kind[at] > 0
    start, end = at[real], end[real]
    first, size, k = codes[start], end - start, kind[start]
    shape = 64 + first.astype(np.int64)
    shape[k == 2] = np.minimum(size[k == 2], 7)
    word = np.flatnonzero(k == 1)
    shape[word] = 16 + 4 * t["upper"][first[word]] + np.minimum(size[word], 3)
    short = word[size[word] < len(t["powers"])]
    if len(short):
        # a hash of each short word's lower-case letters, at most len(powers) of them
        n = size[short]
        at = np.repeat(start[short], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = np.add.reduceat(t["lower"][codes[at]] * t["powers"][at - np.repeat(start[short], n)], np.cumsum(n) - n)
        i = np.minimum(np.searchsorted(t["words"], value), len(t["words"]) - 1)
        known = t["words"][i] == value
        shape[short[known]] = _SPECIAL + t["number"][i[known]]
    begin = np.cumsum([0, *[len(x) + 1 for x in texts]])
    text = np.searchsorted(begin, start, side="right") - 1
    return start - begin[text], end - begin[text], shape, text


def _mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    h = np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(32))
    return (h % np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int32) + 1


def features(start: np.ndarray, end: np.ndarray, shape: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Feature ids of each token: shapes of it and its neighbours in its text, and whether they touch. Id 0 is none."""
    at = np.arange(len(shape)) + 6 * text + 3  # three places before and after each text
    size = int(at[-1]) + 4 if len(at) else 0
    s = np.full(size, _LAST, np.int64)
    for i in (1, 2, 3):
        s[at[np.flatnonzero(np.diff(text, prepend=-1))] - i] = _FIRST
    s[at] = shape
    tight = np.zeros(size + 1, np.int64)
    tight[at[1:]] = (end[:-1] == start[1:]) & (text[:-1] == text[1:])
    x = {i: s[at + i] for i in range(-3, 4)}
    g = 2 * tight[at] + tight[at + 1]
    sets = ((x[0],), (x[0], g), (x[-1], x[0]), (x[0], x[1]), (x[-2], x[-1], x[0]), (x[0], x[1], x[2]), (x[-1], x[0], x[1], g), (x[-3], x[-2], x[-1], x[0]), (x[0], x[1], x[2], x[3]))
    return np.stack([_mixed(i + 1, *parts) for i, parts in enumerate(sets)], 1) if len(shape) else np.zeros((0, 9), np.int32)


def labelled_table(sentences: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with labelled spans, made by rule: written-out variants the patterns miss, and look-alikes."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(("an", "er", "th", "ou", "en", "le", "de", "st", "in", "re", "la", "os", "ch", "um", "ti")) for _ in range(r.randrange(1, 5)))
    name = lambda: r.choice((w(), w() + "." + w(), w() + d(2), w() + "_" + w()))
    made = {
        "phone": (lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}"),
        "email": (lambda: f"{name()} at {w()} dot {r.choice(('com', 'org', 'net', 'edu'))}", lambda: f"{name()} [at] {w()} [dot] {r.choice(('com', 'org', 'net'))}", lambda: f"{name()} (at) {w()}.{r.choice(('com', 'org', 'net'))}", lambda: f"{name()}@{w()} dot com"),
        "ssn": (lambda: f"{d(3)}-{d(2)}-{d(4)}",),
    }
    clean = (
        lambda: f"{r.randrange(1900, 2100)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{r.randrange(1900, 2100)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"version {d(1)}.{d(1)}", lambda: f"{d(3)}.{d(2)}", lambda: f"$ {d(2)},{d(3)}",
        lambda: f"pages {d(2)}-{d(3)}", lambda: f"({r.randrange(1900, 2100)})", lambda: f"no. {d(5)}", lambda: d(r.randrange(1, 13)), lambda: f"isbn 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)} {w()} {d(3)}", lambda: f"at {w()} dot {w()}", lambda: f"{w()} at {w()}", lambda: f"@{w()}",
        lambda: f"({d(3)})", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(4)}-{d(4)}", lambda: f"a dot {w()}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{w()}{d(2)}{w()}", lambda: f"{d(1)}{w()}{d(2)}{w()}{d(1)}", lambda: f"+{d(2)}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)}-{d(2)}", lambda: f"{d(6)}-{d(4)}",
        lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", lambda: f"{d(2)}.{d(3)}.{d(2)}.{d(3)}", lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"{w()}=\"{d(3)}{w()}{d(4)}\"", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(16)}",
    )
    out = []
    for _ in range(sentences):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += "".join(w() + r.choice((" ", " ", " ", ", ", ". ", "\n", "*** ", "### ")) for _ in range(r.randrange(1, 5)))
            text += r.choice(("", "", "", "call ", "tel: ", "phone ", "email: ", "mail ", "ssn ", "fax ", "my number is ", "or "))
            kind = r.choice((*made, *[None] * 4))
            piece = r.choice(made[kind] if kind else clean)()
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + r.choice((" ", " ", ". ", ", ", "### "))
        out.append((text + w(), spans))
    return out


def _batch(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), n.max(), 9), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, n


_ALLOWED = np.array([[b == "O" or b[0] == "B" or (a != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])
_START = np.array([x[0] != "I" for x in LABELS])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def train(table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 70, rate: float = 0.2, ridge: float = 2e-5) -> dict:
    """Emission and transition weights by full-batch Adam on the conditional log-likelihood."""
    rows, gold = [], []
    for text, spans in table:
        start, end, shape, number = tokens([text])
        y = np.zeros(len(start), np.int64)
        for a, b, kind in spans:
            inside = np.flatnonzero((start >= a) & (end <= b))
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[0]] = LABELS.index(f"B-{kind}")
        rows.append(features(start, end, shape, number))
        gold.append(y)
    x, n = _batch(rows)
    size, length = x.shape[:2]
    y = np.zeros((size, length), np.int64)
    for i, g in enumerate(gold):
        y[i, : len(g)] = g
    real = np.arange(length)[None, :] < n[:, None]
    k = len(LABELS)
    seen, inverse = np.unique(x, return_inverse=True)
    inverse = inverse.reshape(x.shape)
    w, trans = np.zeros((len(seen), k)), np.zeros((k, k))
    hard = np.where(_ALLOWED, 0, -1e9)
    first = np.where(_START, 0, -1e9)
    flat = inverse[real].reshape(-1)

    def counted(p: np.ndarray) -> np.ndarray:  # per feature sums of label weights
        reps = np.repeat(p[real], 9, axis=0)
        return np.stack([np.bincount(flat, weights=reps[:, j], minlength=len(seen)) for j in range(k)], 1)

    onehot = np.eye(k)[y]
    gold_w = counted(onehot)
    both = real[:, 1:]
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[:, :-1][both], y[:, 1:][both]), 1)
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, trans)]
    for step in range(1, rounds + 1):
        emit = w[inverse].sum(2)
        t = trans + hard
        alpha, beta = np.zeros((size, length, k)), np.zeros((size, length, k))
        alpha[:, 0] = emit[:, 0] + first
        for i in range(1, length):
            new = _lse(alpha[:, i - 1, :, None] + t, 1) + emit[:, i]
            alpha[:, i] = np.where(real[:, i, None], new, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            beta[:, i] = np.where(real[:, i + 1, None], _lse(t + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + t + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads = (counted(p) - gold_w) / size + ridge * w, (pair[both].sum(0) - gold_t) / size + ridge * trans
        for a, g, m in zip((w, trans), grads, moments, strict=True):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            a -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((1 << FEATURE_BITS, k), np.float32)
    full[seen] = w
    full[0] = 0
    return {"emit": full, "trans": (trans + hard).astype(np.float32), "first": first.astype(np.float32)}


def viterbi(rows: list[np.ndarray], model: dict, batch: int = 512) -> list[np.ndarray]:
    """Best labels of each text; rows: their tokens' emissions. Texts of like length are decoded together."""
    out: list = [np.zeros(0, np.int8)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        some = [order[at]]
        at += 1
        # so many tokens at once at most, long texts alone
        while at < len(order) and len(some) < batch and (len(some) + 1) * len(rows[order[at]]) <= 1 << 17:
            some.append(order[at])
            at += 1
        n = np.array([len(rows[i]) for i in some])
        # best[i]: by label and text, of paths that end at token i; it stands still behind a text's end
        best = np.zeros((n.max(), len(LABELS), len(some)), np.float32)
        for j, i in enumerate(some):
            best[: n[j], :, j] = rows[i]
        best[0] += model["first"][:, None]
        trans = np.ascontiguousarray(model["trans"])
        dead = np.searchsorted(n, np.arange(len(best)), side="right").tolist()  # of texts by length, the first so many have ended
        for i in range(1, len(best)):
            d = dead[i]
            best[i, :, :d] = best[i - 1, :, :d]
            best[i, :, d:] += (best[i - 1][:, None, d:] + trans[:, :, None]).max(0)
        path = np.zeros((len(best), len(some)), np.int8)
        path[-1] = best[-1].argmax(0)
        for i in range(len(best) - 1, 0, -1):
            d = dead[i]
            path[i - 1, :d] = path[i, :d]
            path[i - 1, d:] = (best[i - 1][:, d:] + trans[:, path[i, d:]]).argmax(0)
        for j, i in enumerate(some):
            out[i] = path[: n[j], j]
    return out


def found_spans(texts: list[str], model: dict) -> list[list[tuple[int, int, str]]]:
    """The field's spans of each whole text."""
    start, end, shape, text = tokens(texts)
    f = features(start, end, shape, text)
    emit = np.zeros((len(f), len(LABELS)), np.float32)
    for k in range(f.shape[1]):
        emit += model["emit"][f[:, k]]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, path in enumerate(viterbi([emit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], model)):
        begins = np.flatnonzero(path % 2 == 1)  # B labels are odd, I labels even, O is zero
        for j in begins.tolist():
            last = j
            while last + 1 < len(path) and path[last + 1] == path[j] + 1:
                last += 1
            out[i].append((int(start[cuts[i] + j]), int(end[cuts[i] + last]), LABELS[path[j]][2:]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(base: list, more: list) -> list:
    """The base spans, and those of more that overlap none of them."""
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    kept = list(base)
    for a, b, k in more:
        before = bisect_left(starts, b)
        if not before or ends[before - 1] <= a:
            kept.append((a, b, k))
    return sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and checksum of the base spans, and all spans; one row per document."""
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a, b in batches(pdf["text"].tolist()):
                part = pdf.iloc[a:b]
                texts = [t or "" for t in part["text"]]
                base, rows = [base_spans(t) for t in texts], []
                for key, own, more in zip(part["doc_id"].tolist(), base, found_spans(texts, carried.value), strict=True):
                    kinds = [k for _, _, k in own]
                    spans = all_spans(own, more)
                    rows.append((key, *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans), len(spans) - len(own)))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"doc_id": "Int64"})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scan, OUT)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_table()))
