"""Secret scans with a random forest that removes false positives (operator 10).

Candidates are runs of letters, digits and . ~ ! @ $ % ^ & * # ? + / _ - of min_length bytes or more, without the
punctuation at their ends, and the runs of + / _ - letters and digits in them; no digit is needed. What follows a
key word and = or : is a candidate at any length, up to its closing quote or a space. So that a key isn't judged by
what surrounds it, the parts between slashes are candidates of their own, and so are the runs of letters and digits in
parts over 64 bytes and windows of 32 bytes, 8 apart, in runs over 128. A random forest scores each
from its length, its character transitions, how much of it a dictionary or common pairs of letters cover, whether
it looks like a path, and the words beside it. The mask covers the union of all candidates that score as secrets. The forest is trained here from labelled findings: by default from
labelled_findings(), made by rule from a seed; a caller can give findings of their own, of which at most
most_labels (those with the smallest hashes) are used. The model's size has a fixed bound, so it travels with
the function.

Null and empty texts have no candidates; a null id stays null. Texts are scanned whole, every row for itself. redact() passes all
other columns through unchanged.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.llm import _shared, _text

SCHEMA = "doc_id long, n_candidates long, n_secrets long, spans array<string>, top_score double, redacted_sha256 string"
MASK = "[SECRET]"
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_PART, _SOLID, _WIDE = _RUN.copy(), _RUN.copy(), _RUN.copy()
_PART[ord("/")] = False
_SOLID[[ord(c) for c in "+/_-"]] = False
_WIDE[[ord(c) for c in ".~!@$%^&*#?"]] = True
#: Words that stand beside secrets, and words that stand beside harmless strings of the same look.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "private_key", "client_secret")
PLAIN_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "guid", "hash", "version", "build", "example", "sample", "placeholder", "phone", "card", "isbn", "order", "invoice", "file", "path", "image", "ref", "revision")
#: Beginnings that issuers of keys give them.
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ", "npm_", "hf_")
#: Frequent English words and parts of names, for coverage.
DICTIONARY = frozenset(
    "the and for with that this from have not are was all one can has more when your which their about time only some could them other than then now into may such over new part first two get good make file path name user home test data main code page view list item text line word block table index value type class func function module import export return config setting option default example sample placeholder password changeme secret token key insert here section chapter version release build source image photo number order report final draft copy backup public private local server client request response header footer content style script static asset library package project service system model".split()
)
#: Pairs of letters that are frequent in words of European languages.
PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ie ei sc un ge ns el la qu ue us ss em di ai au eu ux tr pr pe ac ad ag am il im ol op os ot ow pl po pa sh so su ta ly ty ut ul um up vi wa we wh wi wo ca do ec ee ef et ev ex fi fo ho id if ig ir ke ki lo mi mo na no bl ab br cr cl ct da ds ft gh ht ld lt nc nk oo pp rd rs rt tt tu ub uc va vo ye lu ru nu ci ga gi go gr fr fa fe bo ba bi bu".split()
)
#: A value after = or :, in quotes or up to white space, and the key word that ends before it.
_VALUE = re.compile(rb"[=:]>?[ \t]*(?:(?:[Bb]earer|[Bb]asic)[ \t]+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"'`]?([^\s\"'`<>]+))")
_KEYED = re.compile(rb"(?i)(?:" + b"|".join(k.encode() for k in KEY_WORDS) + rb")[a-z0-9_-]*[\"'`]?\s*$")
_AROUND = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_FEATURES = 22
_WINDOW, _LONG = 32, 64


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, left and right child, probability."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean probability over the trees of each row of features."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at].mean(axis=1)
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 10) -> Forest:
    """A random forest by Gini impurity: bootstrap rows and a random square root of the features for each split."""
    rng, tries = np.random.default_rng(seed), max(2, int(math.sqrt(x.shape[1])) + 1)
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, d: int) -> int:
        me, p = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, -1, -1, p])
        if d == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return me
        best: tuple = (p * (1 - p) * len(rows) - 1e-9, None, None)
        for f in rng.permutation(x.shape[1])[:tries]:
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s, ones = v[order], np.cumsum(y[rows][order])
            cut = np.flatnonzero(s[1:] > s[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(rows) - least)]
            if not len(cut):
                continue
            a, total = ones[cut - 1], ones[-1]
            cost = a - a * a / cut + (total - a) - (total - a) ** 2 / (len(rows) - cut)
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), int(f), float((s[cut[k] - 1] + s[cut[k]]) / 2))
        if best[1] is None:
            return me
        below = x[rows, best[1]] <= best[2]
        left, right = grow(rows[below], d + 1), grow(rows[~below], d + 1)
        nodes[me] = [best[1], best[2], left, right, p]
        return me

    roots = [grow(rng.integers(0, len(x), len(x)), 0) for _ in range(trees)]
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f.astype(np.int64), t, a.astype(np.int64), b.astype(np.int64), v, np.array(roots, np.int64))


def _covered(s: str) -> float:
    """The share of the letters that dictionary words of four letters or more cover."""
    low, done = s.lower(), np.zeros(len(s), bool)
    for i in range(len(low) - 3):
        for n in range(min(12, len(low) - i), 3, -1):
            if low[i : i + n] in DICTIONARY:
                done[i : i + n] = True
                break
    return float(done.sum()) / max(1, sum(map(str.isalpha, s)))


@functools.lru_cache(1 << 15)
def _content(s: str) -> tuple[float, ...]:
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in s]
    pairs = list(zip(kinds, kinds[1:], strict=False))
    moves = sum(a != b for a, b in pairs) / max(1, len(pairs))
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))
    vowels = sum(c in "aeiouAEIOU" for c in s) / len(s)
    low = s.lower()
    hexed = all(c in "0123456789abcdef" for c in low)
    longest = max(map(len, re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", s)), default=0)
    letters = [low[i : i + 2] for i, (a, b) in enumerate(pairs) if a in (1, 2) and b in (1, 2)]
    return (
        len(s), kinds.count(0) / len(s), kinds.count(1) / len(s), kinds.count(2) / len(s), kinds.count(3) / len(s),
        moves, sum(a == 0 and b in (1, 2) or b == 0 and a in (1, 2) for a, b in pairs) / max(1, len(pairs)), sum({a, b} == {1, 2} for a, b in pairs) / max(1, len(pairs)),
        entropy, vowels, _covered(s), s.count("/"), s.count("-"), float(hexed), float(s.startswith(ISSUED)), longest / len(s), sum(p in PAIRS for p in letters) / max(1, len(letters)),
    )


def features(candidate: str, before: str, after: str) -> list[float]:
    """Of a whole candidate and the text just before and after it; linear in its length."""
    content = _content(candidate) if len(candidate) <= 64 else _content.__wrapped__(candidate)
    near = [w.lower() for w in _AROUND.findall(before[-48:])][-4:]
    behind = [w.lower() for w in _AROUND.findall(after[:32])][:2]
    keyed = max((4 - i for i, w in enumerate(reversed(near)) if any(k in w for k in KEY_WORDS)), default=0)
    plain = max((4 - i for i, w in enumerate(reversed(near)) if w in PLAIN_WORDS), default=0)
    sign = re.search(r"([=:]>?)(\s*)([\"']?)$", before)
    assigned = 0 if not sign else 3 if sign[3] else 1 if sign[1] == ":" and sign[2] else 2
    return [
        *content, float(bool(re.match(r"\.[A-Za-z]{1,5}\b", after)) or before.endswith((".", "/"))),
        keyed, plain, assigned, float(any(w in PLAIN_WORDS for w in behind)),
    ]


def labelled_findings(n: int = 6000, seed: int = 10) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, 1 for a secret): made by rule, half of each kind."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    run = lambda alphabet, a, b: "".join(alphabet[k] for k in r.integers(0, len(alphabet), int(r.integers(a, b + 1))))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, base = dig + "abcdef", low + up + dig
    names = sorted(DICTIONARY)
    parts = ("in", "re", "th", "er", "on", "an", "ti", "es", "or", "st", "ed", "ing", "la", "de", "que", "der", "sch", "ung")
    word = lambda: pick(names) if r.random() < 0.4 else "".join(pick(parts) for _ in range(int(r.integers(1, 5))))
    signs, leet = ".~!@$%^&*#?_-", str.maketrans("aeiost", "431057")
    path = lambda n: "/".join(pick((word(), word() + pick("-_") + word(), word() + run(dig, 1, 3))) for _ in range(n // 6 + 1))
    text = lambda: " ".join(word() for _ in range(int(r.integers(2, 6))))
    out = []
    for k in range(n):
        before, after = text() + pick((" ", " ", ". ", "\n", ", ")), pick((" ", " ", ". ", "\n", ", ")) + text()
        if k % 2:
            kind = int(r.integers(11))
            if kind == 0:
                s = pick(("AKIA", "ASIA")) + (run(up + dig, 16, 16) if r.random() < 0.8 else run(up, 16, 16))
            elif kind == 1:
                s = pick(("ghp_", "gho_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_", "hf_")) + run(base, 20, 40)
            else:
                s = run(hexa, 14, 64) if kind < 4 else run(base, 16, 48) if kind == 4 else run(base + "+/", 20, 64)
            if kind == 6:
                s = run(low + up, 16, 48)
            elif kind == 7:
                s = run(base + signs, 6, 24) + pick(dig + up)
            elif kind == 8:
                s = "".join(c.translate(leet) if r.random() < 0.6 else c for c in (word() + word()).capitalize()[:12]) + pick(("", "", *signs)) + run(dig, 1, 4) + pick(("", "!", "$"))
                s = s if r.random() < 0.6 else "".join(run(low + up, 1, 3) + run(dig, 1, 2) + pick(signs) for _ in range(int(r.integers(2, 5)))) + run(base, 1, 4)
            elif kind == 9:
                s = run(base, 18, 40) if r.random() < 0.7 else pick(("ghp_", "sk_live_", "AKIA")) + run(base, 16, 30)
                before += path(int(r.integers(10, 300))) + "/"
                after = pick(("", "/" + path(20))) + after
            elif kind == 10:
                s = run(base + pick(("", "+/")), 64, 1500) if r.random() < 0.5 else run(base + signs, 14, 32) + pick(dig)
            if kind in (2, 3, 7, 8) or kind in (4, 5, 6) and r.random() < 0.6 or kind in (0, 1, 10) and r.random() < 0.3:
                quote = pick(("", '"', "'"))
                before += pick(KEY_WORDS) + pick(("=", " = ", ": ", ":") if kind in (7, 8) else ("=", " = ", ": ", ":", " ")) + quote
                after = quote + after
        else:
            kind = int(r.integers(17))
            if kind == 0:
                s = run(hexa, 32, 32) if r.random() < 0.5 else run(hexa, 40, 64)
                before += pick(("commit ", "sha1:", "md5 ", "checksum: ", "digest=", "etag: ", "revision ", "hash "))
            elif kind == 1:
                s = "-".join(run(hexa, m, m) for m in (8, 4, 4, 4, 12))
                before += pick(("", "uuid ", "id ", "guid: "))
            elif kind == 2:
                s = run(dig, 12, 20) if r.random() < 0.6 else "-".join(run(dig, 2, 4) for _ in range(4))
                before += pick(("", "", "phone ", "card ", "order ", "invoice: "))
            elif kind == 3:
                s = "/".join(pick((word(), word() + run(dig, 1, 3))) for _ in range(int(r.integers(2, 6)))) + run(dig, 1, 2)
                after = pick((".py", ".html", ".png", ".txt", "")) + after
            elif kind == 4:
                s = pick(("_", "-", "")).join(word() for _ in range(int(r.integers(2, 6)))) + run(dig, 1, 4)
            elif kind == 5:
                s = pick(("xxxxxxxxxxxx", "changeme", "your_api_key_here", "example_token", "insert-secret-here", "placeholder", "00000000000", "1234567890")) + run(dig, 1, 6)
                before += pick(KEY_WORDS) + pick(("=", " = ", ": "))
            elif kind == 6:
                s = word().capitalize() + word().capitalize() + run(dig, 1, 3) + word().capitalize()
            elif kind == 7:
                s = run(hexa, 12, 40)
                before += pick(("build ", "version ", "ref ", "file ", "image "))
            elif kind in (8, 9, 10):
                s = "".join(pick(parts) for _ in range(int(r.integers(3, 9)))) + pick(("", "", word()))
                s = pick((s, s, s.capitalize(), s.upper()))
                before += pick(("", "", "", pick(KEY_WORDS) + pick((" ", ": "))))
                after = pick(("", ".", "###", "!!", ",")) + after
            elif kind == 11:
                s = pick((".", "_", "-", "/", "", "&", "@", "...", "?")).join(pick((word(), word().capitalize())) for _ in range(int(r.integers(2, 6))))
                s = s if r.random() < 0.6 else word() + pick((".", "_", "")) + run(dig, 0, 2) + "@" + word() + run(dig, 0, 1) + pick((".com", ".org", ".example.com", ".de"))
            elif kind == 12:
                s = pick("-_/+xay.*#") * int(r.integers(12, 300))
            elif kind == 13:
                s = pick((word(), word(), word().capitalize(), "the", "is", "a", "true", "false", "null", "None", "yes", "no", "required", "****", "xxxx", "...", "$PASSWORD", "${TOKEN}", "os.environ", "changeme", "your-token", run(dig, 1, 3)))
                before += pick(KEY_WORDS) + pick(("=", " = ", ": ", ": ", ":"))
            elif kind == 14:
                s = path(int(r.integers(60, 700))) + pick(("", "", "/" + run(base, 18, 40), "/" + pick(("ghp_", "AKIA")) + run(base, 16, 30)))
                s = s if r.random() < 0.7 else pick((run(base, 18, 40), pick(("ghp_", "AKIA")) + run(base, 16, 30))) + "/" + path(int(r.integers(60, 700)))
            elif kind == 15:
                s = pick((word() + word() + word(), word() + "-" + word() + "-" + word(), word() + "_" + word() + run(dig, 0, 3), path(int(r.integers(100, 300)))[-64:]))
                before += path(int(r.integers(10, 300))) + "/"
                after = pick(("", "/" + path(20), ".html", ".py")) + after
            else:
                s = f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}" + pick(("-", "_", "T")) + run(dig, 4, 8)
            s = s if len(s) >= 12 or kind > 7 else s + "_" + run(dig, 12, 12)
        out.append((s, before, after, k % 2))
    return out


@functools.cache
def default_forest() -> Forest:
    rows = labelled_findings()
    return fit(np.array([features(*r[:3]) for r in rows]), np.array([r[3] for r in rows], np.float64))


def forest_from(labels: DataFrame, most_labels: int = 20_000) -> Forest:
    """From (candidate, before, after, label 0/1); rows with a null candidate or label are left out. At most most_labels rows, those with the smallest hashes, reach the driver."""
    rows = labels.where("candidate IS NOT NULL AND candidate <> '' AND label IS NOT NULL").select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "label")
    got = rows.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after", "label").limit(most_labels).collect()
    if not got:
        raise ValueError("no labelled findings")
    return fit(np.array([features(*r[:3]) for r in got]), np.array([float(r[3]) for r in got]))


def runs(data: np.ndarray, off: np.ndarray, min_length: int, alphabet: np.ndarray = _RUN) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of an alphabet in bytes; none goes over the end of a document."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet[data]
    begin, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    long = ends - starts >= min_length
    return starts[long], ends[long]


def values(text: bytes) -> Iterator[tuple[int, int]]:
    """What is assigned to key words, at any length; without quotes also what comes before the next & , or ;."""
    for m in _VALUE.finditer(text):
        if _KEYED.search(text[max(0, m.start() - 64) : m.start()]):
            a, z = m.span(m.lastindex)
            if m.lastindex == 3:
                z = a + len(text[a:z].rstrip(b",;)}].")) or z
                first = re.search(rb"[&,;]", text[a:z])
                if first and first.start():
                    yield a, a + first.start()
            yield a, z


def candidates(data: np.ndarray, off: np.ndarray, raw: bytes, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes, ascending; they can lie in each other."""
    spots: set[tuple[int, int]] = set()
    starts, ends = runs(data, off, min_length, _WIDE)
    solid = np.flatnonzero(_RUN[data])
    if len(solid) and len(starts):
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
        some = lo <= hi
        spots.update(zip(solid[lo[some]].tolist(), (solid[hi[some]] + 1).tolist(), strict=True))
    starts, ends = runs(data, off, min_length)
    spots.update(zip(starts.tolist(), ends.tolist(), strict=True))
    long = ends - starts > 2 * _LONG
    for a, z in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        spots.update((k, k + _WINDOW) for k in [*range(a, z - _WINDOW, _WINDOW // 4), z - _WINDOW])
    starts, ends = runs(data, off, min_length, _PART)
    spots.update(zip(starts.tolist(), ends.tolist(), strict=True))
    long = ends - starts > _LONG
    for a, z in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        inner, till = runs(data[a:z], np.array([0, z - a]), min_length, _SOLID)
        spots.update(zip((inner + a).tolist(), (till + a).tolist(), strict=True))
    for d in range(len(off) - 1):
        begin = int(off[d])
        spots.update((begin + a, begin + z) for a, z in values(raw[begin : int(off[d + 1])]))
    out = sorted(spots)
    return np.array([a for a, _ in out], np.int64), np.array([z for _, z in out], np.int64)


def findings(column: pa.Array, forest: Forest, threshold: float, min_length: int) -> Iterator[tuple[int, int, list[tuple[int, int]], float, str | None]]:
    """For each document: its row, how many candidates, the secrets' spans in characters, the highest score, the redacted text."""
    data, off = _text.utf8(column)
    for i, j in _text.parts(off, 4 << 20):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        raw = part.tobytes()
        starts, ends = candidates(part, o, raw, min_length)
        own, scores = np.searchsorted(o, starts, "right") - 1, np.zeros(len(starts))
        for p in range(0, len(starts), 1 << 14):
            rows = []
            for a, z, d in zip(*(c[p : p + (1 << 14)].tolist() for c in (starts, ends, own)), strict=True):
                lo, hi = max(int(o[d]), a - 96), min(int(o[d + 1]), z + 64)
                rows.append(features(raw[a:z].decode(), raw[lo:a].decode("utf-8", "ignore"), raw[z:hi].decode("utf-8", "ignore")))
            scores[p : p + len(rows)] = forest.predict(np.array(rows).reshape(-1, _FEATURES))
        first = np.searchsorted(own, np.arange(j - i + 1))
        for d in range(j - i):
            begin, text, merged, spans, at, chars, out = int(o[d]), raw[int(o[d]) : int(o[d + 1])], [], [], 0, 0, []
            mine = slice(int(first[d]), int(first[d + 1]))
            for a, z, score in zip((starts[mine] - begin).tolist(), (ends[mine] - begin).tolist(), scores[mine].tolist(), strict=True):
                if score >= threshold:
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                    else:
                        merged.append([a, z])
            for a, z in merged:
                kept = text[at:a].decode()
                left = chars + len(kept)
                chars = left + len(text[a:z].decode())
                spans.append((left, chars))
                out += [kept, MASK]
                at = z
            top = float(scores[mine].max()) if first[d] < first[d + 1] else 0.0
            yield i + d, int(first[d + 1] - first[d]), spans, top, "".join(out) + text[at:].decode() if spans else None


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None, threshold: float = 0.5, min_length: int = 12) -> DataFrame:
    """One row of SCHEMA for each document; spans as "start-end" in characters. One pass, no shuffle."""
    _shared.small_batches(docs)
    model = forest or default_forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, out = b.column(1), []
            for row, n, spans, top, redacted in findings(body, model, threshold, min_length):
                final = redacted if redacted is not None else body[row].as_py() or ""
                out.append((n, len(spans), [f"{a}-{z}" for a, z in spans], top, hashlib.sha256(final.encode()).hexdigest()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])
        _shared.release()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text: str = "text", forest: Forest | None = None, threshold: float = 0.5, min_length: int = 12) -> DataFrame:
    """docs with each secret in the text column replaced by MASK; all rows and columns stay."""
    _shared.small_batches(docs)
    model, at = forest or default_forest(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(at)
            new = {row: redacted for row, _, spans, _, redacted in findings(body, model, threshold, min_length) if spans}
            if new:
                mask = np.zeros(len(body), bool)
                mask[list(new)] = True
                import pyarrow.compute as pc

                body = pc.replace_with_mask(body, pa.array(mask), pa.array([new[k] for k in sorted(new)], body.type))
            yield pa.RecordBatch.from_arrays([body if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)
        _shared.release()

    return docs.mapInArrow(run, docs.schema)
