"""Secret scans: candidate strings by pattern, false positives removed by a random forest trained on labelled findings.

The forest asks for length, character kinds, transitions between characters, dictionary coverage, the file's path and
neighbouring words. Transitions, words and parts of paths count by the log odds that the labelled findings give them.
"""

from __future__ import annotations

import base64
import functools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradus.llm._text import lean

if TYPE_CHECKING:
    import pandas as pd  # the driver alone uses it; it would take its share of each Python worker

MAX_FINDINGS = 20_000  # labelled findings that the forest is fitted on, at most
SIDE = 40  # characters on either side that count as neighbours
WIDTH = 256  # characters beyond which a value's alphabet is taken not to grow
ASSIGNED = re.compile(r"""[=:]{1,2}[ \t]{0,3}["'`]?([^\s"'`<>=:]{6,})""")
LONG = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
# How issued keys begin.
ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{12,}|gh[opsu]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{30,}|glpat-[A-Za-z0-9_\-]{16,})")
BUCKETS = 2048  # of hashed neighbouring words and parts of paths
#: Words that invented findings are made of.
WORDS = frozenset("""
about access account admin after again allow also amount another answer apple application available back base because been before
being best better between black blue book both build business button call case change changeme check city class client close code
color come command common company computer config connect content control copy could country create credit current custom data
database date default delete demo design detail development different digital document does down each edit email empty enable end
engine enter error event every example fake family field file find first folder follow form found free from full function general
give good great green group have hello help here high home house html http https image index info input insert install item
john just key keep kind know language large last letter level library life light like line link list little local login long look
love made mail main make manager master member message method might mobile model money more most move much music must mydomain
name need network never news next none note number object office only open option order other output over page paper param part
pass password path people person phone photo place plain play please point port post power price print private problem process
product profile program project public query question random read real really record red release report request required reset
result return right river root sample save school search second secret section secure security select send server service session
set setting several share shop should show side sign simple site size small some something sound source special staging standard
start state static still stop store story string study style support system table take team tell template temp test text than that
their them theme then there these they thing think this those three time title today token tool tree true turn type under unit
until update upload user username value version very video view want water website week well were what when where which while
white will window with without word work world would write year your
""".split())
FEATURES = (
    "length", "digits", "upper", "lower", "other", "switches", "distinct", "entropy", "dictionary", "hexadecimal", "number", "dots", "slashes", "assigned", "quoted", "issued",
    "pairs", "nearest", "left", "left_most", "right", "path",
)
_SYMBOL = np.full(128, 38, np.int64)  # letters, digits and some marks; all else is one symbol
_SYMBOL[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(26)
_SYMBOL[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(26)
_SYMBOL[[ord(c) for c in "0123456789"]] = 26 + np.arange(10)
_SYMBOL[[ord(c) for c in "-_./"]] = 36
_SYMBOL[[ord(c) for c in "+="]] = 37
SYMBOLS = 39
_TOKEN = re.compile(r"[^\W_]+")


class Evidence(NamedTuple):
    """What labelled findings teach beside the forest: log odds that a secret rather than something else has it."""

    pairs: np.ndarray  # (symbols, symbols): one character after another
    left: np.ndarray  # by bucket: a word before it
    right: np.ndarray  # a word behind it
    path: np.ndarray  # a part of the file's path


def symbols(value: str) -> np.ndarray:
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _SYMBOL[np.minimum(code, 127)], 38)


def buckets(text: str | None) -> list[int]:
    """Of the words of a text."""
    return [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in _TOKEN.findall((text or "").lower())]


def evidence(findings: Iterable[tuple], smoothing: float = 1.0) -> Evidence:
    """From findings (before, value, after, path, secret); a word counts once a finding."""
    pairs, words = np.full((2, SYMBOLS, SYMBOLS), smoothing), np.full((2, 3, BUCKETS), smoothing)
    seen = np.full(2, 2 * smoothing)
    for before, value, after, path, secret in findings:
        kind, s = int(secret), symbols(value)
        seen[kind] += 1
        np.add.at(pairs[kind], (s[:-1], s[1:]), 1)
        for side, text in enumerate((before[-SIDE:], after[:SIDE], path)):
            words[kind, side, list(set(buckets(text)))] += 1
    pairs /= pairs.sum(axis=2, keepdims=True)
    odds = np.log(words / seen[:, None, None])
    left, right, path = odds[1] - odds[0]
    return Evidence(np.log(pairs[1] / pairs[0]), left, right, path)


class Dictionary(frozenset):
    """Words, with the letters of the longest of them."""

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self), default=0)


def dictionary(vocabulary: str) -> Dictionary:
    """Words of four letters or more that a public byte vocabulary (lines of base64 and rank) holds behind a space."""
    with open(vocabulary, "rb") as lines:
        pieces = (base64.b64decode(line.split()[0]) for line in lines)
        words = (p[1:].decode().lower() for p in pieces if p[:1] == b" " and p[1:].isalpha())
        return Dictionary(w for w in words if len(w) >= 4)


def grouped(text: str) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Spans of assigned values, issued keys and long runs with a digit, whole; each union of overlapping ones with those inside it."""
    found = [m.span(1) for m in ASSIGNED.finditer(text)] + [m.span() for m in ISSUED.finditer(text)]
    found += [m.span() for m in LONG.finditer(text) if not m.group().isalpha() and any(c.isdigit() for c in m.group())]
    out: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        while b > a and text[b - 1] in ".,;)]}":
            b -= 1
        if b - a < 6:
            continue
        if out and a < out[-1][0][1]:
            (first, last), inner = out[-1]
            if b > last:
                inner.append((first, last))
                out[-1] = ((first, b), inner)
            if (a, b) != out[-1][0]:
                inner.append((a, b))
        else:
            out.append(((a, b), []))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans of ``grouped``: none overlaps another."""
    return [whole for whole, _ in grouped(text)]


def coverage(value: str, words: Dictionary) -> float:
    """Share of the characters that dictionary words cover, longest first from the left."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(words.longest, len(low) - i), 3, -1):
            if low[i : i + n] in words:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(value))


def features(before: str, value: str, after: str, path: str | None, known: Evidence, words: Dictionary) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    counts = Counter(value)
    left, s = before[-SIDE:], symbols(value)
    odds = [float(known.left[b]) for b in buckets(left)]
    return [
        n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(counts) / min(n, WIDTH), -sum(c / n * math.log2(c / n) for c in counts.values()), coverage(value, words),
        all(c in "0123456789abcdefABCDEF" for c in value), all(c.isdigit() or c in "-. +" for c in value), value.count(".") / n, (value.count("/") + value.count("\\")) / n,
        bool(re.search(r"""[=:][ \t]{0,3}["'`]?$""", left)), left[-1:] in ("'", '"', "`") and bool(left), bool(ISSUED.match(value)),
        float(known.pairs[s[:-1], s[1:]].mean()) if n > 1 else 0.0, odds[-1] if odds else 0.0, sum(odds), max(odds, default=0.0), sum(float(known.right[b]) for b in buckets(after[:SIDE])), sum(float(known.path[b]) for b in buckets(path)),
    ]


class Forest(NamedTuple):
    """Trees in arrays: node i asks if feature[i] <= limit[i], left to i's child, else to the one after it; -1 ends.

    With them what their features are measured by.
    """

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    share: np.ndarray
    known: Evidence | None = None
    words: Dictionary = Dictionary()

    def rate(self, found: Iterable[tuple[str, str, str, str | None]]) -> np.ndarray:
        """``score`` of findings (before, value, after, path)."""
        return self.score(np.array([features(*f, self.known, self.words) for f in found], float).reshape(-1, len(FEATURES)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches."""
        if not len(x):
            return np.zeros(0)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (self.feature[at] >= 0).any():
            f = self.feature[at]
            at = np.where(f >= 0, self.child[at] + (x[rows, np.maximum(f, 0)] > self.limit[at]), at)
        return self.share[at].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 9, least: int = 3, seed: int = 1) -> Forest:
    """A random forest: each tree on a bootstrap sample, each split the best by Gini among some features."""
    rng = np.random.default_rng(seed)
    tried = max(1, round(math.sqrt(x.shape[1])))
    feature, limit, child, share, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (limit, 0.0), (child, 0), (share, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(node())
        todo = [(roots[-1], rng.integers(0, len(x), len(x)), 0)]
        while todo:
            at, own, level = todo.pop()
            share[at] = float(y[own].mean())
            if level == depth or len(own) < 2 * least or share[at] in (0.0, 1.0):
                continue
            best = (1e-9, None)
            for f in rng.permutation(x.shape[1])[:tried]:
                order = own[np.argsort(x[own, f], kind="stable")]
                v, hits = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(own))
                left = hits[:-1]
                right = hits[-1] - left
                rest = len(own) - n
                gain = left**2 / n + (n - left) ** 2 / n + right**2 / rest + (rest - right) ** 2 / rest
                gain = gain / len(own) - (share[at] ** 2 + (1 - share[at]) ** 2)
                gain[(v[1:] == v[:-1]) | (n < least) | (rest < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (int(f), float((v[i] + v[i + 1]) / 2)))
            if best[1] is None:
                continue
            feature[at], limit[at] = best[1]
            child[at] = node()
            node()
            low = x[own, feature[at]] <= limit[at]
            todo += [(child[at], own[low], level + 1), (child[at] + 1, own[~low], level + 1)]
    return Forest(np.array(roots), np.array(feature), np.array(limit), np.array(child), np.array(share))


def invented_findings(n: int, seed: int) -> pd.DataFrame:
    """Labelled findings (before, value, after, path, secret) drawn from a seeded rule: no secret in it is real."""
    import pandas as pd

    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = sorted(WORDS)
    syllables = ["th", "er", "an", "ti", "on", "re", "de", "schu", "ung", "que", "lo", "ment", "ci", "ve", "ra"]
    draw = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    prose = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    keys = ["password", "passwd", "pwd", "token", "secret", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "db_password", "SECRET_KEY", "apikey"]
    joins = ["=", " = ", ": ", ":", '="', " = \"", "='", ": '", " := "]
    plain = ["color", "title", "id", "name", "version", "file", "path", "class", "size", "date", "url", "type", "note", "page", "width", "format"]
    rows = []
    for _ in range(n):
        before, after = prose(r.randint(1, 6)) + r.choice([" ", ".\n", ", ", "\n", "### "]), r.choice([" ", "\n", '"', '" ', "'", ". ", "### "]) + prose(r.randint(0, 4))
        path = r.choice([None, "src0", "web", "src/app/settings.py", "config/prod.env", "lib/client.js"])
        secret = r.random() < 0.5
        if secret:
            kind = r.randrange(6)
            if kind == 0:
                value, before = draw("0123456789abcdef", r.choice([16, 18, 20, 24, 32, 40, 64])), before + r.choice(keys) + r.choice(joins)
            elif kind == 1:
                value, before = draw(low + up + dig, r.randint(12, 48)), before + r.choice(keys) + r.choice(joins)
            elif kind == 2:
                value = r.choice(["AKIA", "ASIA"]) + draw(r.choice([up, up + "234567" + dig]), 16)
            elif kind == 3:
                value = r.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + draw(low + up + dig, r.randint(20, 40))
            elif kind == 4:
                value, before = draw(low + up + dig + "!@#$%^&*", r.randint(9, 24)), before + r.choice(keys) + r.choice(joins)
            else:
                value, before = draw(low + up + dig + "+/", r.choice([40, 44, 64, 88])), before + r.choice(keys + ["Authorization: Bearer", "bearer"]) + r.choice([*joins, " "])
        else:
            kind = r.randrange(13)
            if kind == 0:
                value, before = r.choice(["changeme", "your_password", "yourpassword", "password123", "example", "xxxxxxxx", "********", "placeholder", "<password>", "your-api-key-here", "insert_token_here", "test_secret", "None", "undefined", "process.env.TOKEN", "os.environ", "getpass()", "${PASSWORD}", "{{secret}}", "dummy_value"]), before + r.choice(keys) + r.choice(joins)
            elif kind == 1:
                value, before = draw("0123456789abcdef", r.choice([40, 64, 32])), before + r.choice(["commit ", "sha256: ", "md5: ", "checksum=", "revision ", "sha1=", "hash: ", "digest: ", "build "])
            elif kind == 2:
                value, before = "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), before + r.choice(["uuid: ", "id=", "guid ", "id: ", ""])
            elif kind == 3:
                value = draw(dig, r.choice([13, 16, 16, 16, 18, 20]))
            elif kind == 4:
                value = ".".join(str(r.randint(1, 255)) for _ in range(4))
                before += r.choice(["", "ip: ", "host=", "server: "])
            elif kind == 5:
                value = "/".join(r.choice(words) for _ in range(r.randint(3, 6))) + r.choice(["", ".html", ".png", "/v2", "/2021"])
                before += r.choice(["path=", "src=\"", "https:", "see: ", ""])
            elif kind == 6:
                value = "".join(r.choice(words).capitalize() for _ in range(r.randint(2, 5))) + draw(dig, r.randint(0, 3))
                before += r.choice([*[k + r.choice(joins) for k in plain], "", *[k + r.choice(joins) for k in keys[:3]]])
            elif kind == 7:
                value = r.choice(["_", "-"]).join(r.choice(words) for _ in range(r.randint(3, 6))) + r.choice(["", "_2", "-v1"])
                before += r.choice([k + r.choice(joins) for k in plain + keys])
            elif kind == 8:
                value, before = "".join(r.choice(syllables) for _ in range(r.randint(3, 8))), before + prose(1) + r.choice([": ", ":", "="])
                value = r.choice([value, value.upper()])
            elif kind == 9:
                value, before = draw(dig, r.randint(6, 12)), before + r.choice(plain + ["order", "phone", "isbn"]) + r.choice(joins)
            elif kind == 10:
                value, before = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}", before + r.choice(["date", "time", "created"]) + r.choice(joins)
            elif kind == 11:
                value, before = draw(low + up + dig, r.randint(12, 40)), before + r.choice(keys) + r.choice(joins)
                path = r.choice(["tests/test_auth.py", "examples/demo.py", "docs/guide.md", "spec/fixtures/sample.json", "test/mock.env"])
            else:
                value, before = r.choice([low, up])[:1] * r.randint(8, 20), before + r.choice(keys) + r.choice(joins)
        rows.append((before, value, after, path, secret))
    return pd.DataFrame(rows, columns=["before", "value", "after", "path", "secret"])


def train(findings: pd.DataFrame, words: Dictionary, *, seed: int = 1) -> Forest:
    """The forest of labelled findings (before, value, after, path, secret); of more than ``MAX_FINDINGS`` a seeded sample.

    While it grows, each half of the findings is measured by what the other half taught, so that no finding vouches for itself.
    """
    if len(findings) > MAX_FINDINGS:
        findings = findings.sample(MAX_FINDINGS, random_state=seed)
    rows = list(findings[["before", "value", "after", "path", "secret"]].itertuples(index=False, name=None))
    halves = [evidence(rows[i::2]) for i in (0, 1)]
    x = np.array([features(*r[:4], halves[(i + 1) % 2], words) for i, r in enumerate(rows)], float)
    return grow(x, findings["secret"].to_numpy(float), seed=seed)._replace(known=evidence(rows), words=words)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
MASK = "[secret]"


def united(spans: Iterable[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans in order, overlapping ones made one with the best of their scores."""
    out: list[tuple[int, int, float]] = []
    for a, b, s in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(s, out[-1][2]))
        else:
            out.append((a, b, s))
    return out


def scan(docs: DataFrame, forest: Forest, *, text: str = "text", path: str | None = None, limit: float = 0.5) -> DataFrame:
    """``docs`` with _candidates (bigint), _secrets (spans in characters, with scores) and _redacted (the text without them); columns of those names are replaced.

    A candidate whose score is ``limit`` or more is a secret. Where one that is none was made of overlapping matches, or has
    others inside it, those count by their own scores, and the union of the accepted ones is masked. A null text has none and stays null; equal rows are judged
    alike; texts are scanned whole. ``path`` names a column with the file's path or source, if there is one. An empty table
    stays empty. The forest, some thousand nodes with a dictionary, is broadcast; nothing is shuffled.
    """
    docs = docs.drop("_candidates", "_secrets", "_redacted")
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            paths = batch.column(batch.schema.get_field_index(path)).to_pylist() if path else [None] * len(texts)
            found = [grouped(t) if t else [] for t in texts]
            parts = ((t[max(0, a - SIDE) : a], t[a:b], t[b : b + SIDE], p) for t, p, spans in zip(texts, paths, found, strict=True) for whole, inner in spans for a, b in (whole, *inner))
            scores = iter(sent.value.rate(parts).tolist())
            secrets, redacted = [], []
            for t, spans in zip(texts, found, strict=True):
                own = []
                for whole, inner in spans:
                    score, parts = next(scores), sorted((*part, next(scores)) for part in inner)
                    own += [(*whole, score)] if score >= limit else united(p for p in parts if p[2] >= limit)
                secrets.append([{"start": a, "end": b, "score": s} for a, b, s in own])
                if own:
                    edges = [0, *[e for a, b, _ in own for e in (a, b)], len(t)]
                    t = MASK.join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                redacted.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(f) for f in found], pa.int64()), pa.array(secrets, kind), pa.array(redacted, pa.string())], [*batch.schema.names, "_candidates", "_secrets", "_redacted"])

    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, T.StructField("_candidates", T.LongType()), T.StructField("_secrets", SPANS), T.StructField("_redacted", T.StringType())]))
