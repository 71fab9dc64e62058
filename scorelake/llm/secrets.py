"""Secret scanning: candidates by pattern, false positives removed by a random forest.

The forest sees each candidate's length, character transitions, dictionary coverage, path and
neighbouring words. It is trained on labelled findings: a table the caller passes, or the seeded
set of ``labelled_findings`` where there is none.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm._common import mapped, require, share

#: Bound of the labelled findings that the forest is fitted on.
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAST, THRESHOLD = 40, 12, 2, 0.5
WINDOW = 48
_RANK = {"assigned": 1, "bare": 2}

_KEYS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|key)"
PROVIDERS = re.compile(
    r"(?P<cloud>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)"
    r"|(?P<forge>\bgh[oprsu]_[A-Za-z0-9]{36,}\b)"
    r"|(?P<chat>\bxox[abprs]-[A-Za-z0-9-]{10,})"
    r"|(?P<maps>\bAIza[0-9A-Za-z_-]{35}\b)"
    r"|(?P<pay>\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}\b)"
    r"|(?P<web>\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    r"|(?P<pem>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:\s|\\n)++[A-Za-z-]{1,20}+: [^\s\\]*+){0,3}+(?:(?:\s|\\n)++[A-Za-z0-9+/=]{16,}+)*+"
    r"(?:(?:(?:\s|\\n)++[A-Za-z0-9+/=]++)?(?:\s|\\n)*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?)"
)
#: Every match of PROVIDERS holds one of these, and looking for them is much cheaper.
_LITERALS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "xox", "AIza", "k_live_", "k_test_", "eyJ", "-----BEGIN")
_NAME = re.compile("(?i:" + _KEYS + ")")
#: The beginning of an assigned value; the value is the whole run of _RUN from there.
_VALUE = re.compile(r"(?::=|=>|[:=])\s{0,3}[\"']?(?=([^\s\"'<>,;]{6}))")
_RUN = re.compile(r"[^\s\"'<>,;]+")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_DIGIT = re.compile("[0-9]")
_SIGN = re.compile("[:=]")
_PROVIDER = ("cloud", "forge", "chat", "maps", "pay", "web", "pem")
DICTIONARY = frozenset(
    "about access account action address admin after again agent alias allow alpha amount answer apple array async author auto back base basic batch before begin below beta between binary block board body book boolean border bottom branch break bridge browser buffer build button bytes cache call case catch chain change channel char check child chrome class clean clear client clock close cloud code color column command comment commit common compile config connect const content context control copy core count create cursor custom daily dash data date debug default define delete demo design detail device dialog digest direct disk display document domain double down draft drive dummy dynamic each edit element email empty enable encode engine enter entry enum environment error event every example except export extend extra factory failed false family fetch field file filter final find first fixed flag float folder font footer force form format forward frame free from front full function game general generic global good grant graph green grid group guest hand handle hash have header heap hello help here hidden high home host hour http icon image import index info init inner input insert inside install int interface internal invalid item iterator java join json keep kernel label lambda language large last layer layout length letter level library light limit line link list load local lock login long loop lower machine mail main make manager mask master match math matrix maximum member memory menu merge message meta method middle minimum mobile mode model module month more mouse move multi music name native network never next node none normal note null number object offset online only open operator option order other outer output owner package page pair panel param parent parse part pass password patch path pattern pause payload people phone photo pixel place plain player plugin point policy pool port position post power prefix print private process product profile program project property protocol proxy public push query queue quick random range rate read ready real record red region register release remote remove render repeat replace report request require reset resource response result return right role root round route rule sample save scale scan schema scope score screen script scroll search second section secret secure select self send sequence series server service session setting shadow shape share sheet shell short show side sign simple single site size sleep slice small snapshot socket some sort source space speed split stack stage standard start state static status step stop storage store stream string strong struct style submit success super support switch symbol system table target task team temp template test text their then there theme thread time title token tool total track traffic tree trigger true type under union unique unit update upload upper user using util valid value variable vector version video view virtual visible void wait warning water week weight when where while width window with within word work world write year your zero changeme placeholder letmein qwerty monkey dragon welcome hunter".split()
)
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "login", "bearer")
FAKES = ("example", "sample", "dummy", "fake", "test", "placeholder", "changeme", "your", "todo", "xxxx", "demo", "template", "redacted")
HASHES = ("sha", "commit", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision", "integrity", "version", "build", "id")
PATHS = ("test", "example", "sample", "doc", "spec", "mock", "fixture", ".md", ".lock", "vendor")
FEATURES = 24


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _transitions() -> dict[str, float]:
    """Log probabilities of letter pairs of ordinary words."""
    pairs, firsts = Counter(), Counter()
    for w in sorted(DICTIONARY):
        for a, b in zip(w, w[1:]):
            pairs[a + b] += 1
            firsts[a] += 1
    return {a + b: math.log((pairs[a + b] + 0.1) / (firsts[a] + 2.6)) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}


_PAIRS = _transitions()


def coverage(value: str) -> float:
    """Share of the value's characters that dictionary words of four letters and more cover, longest first."""
    low, i, found = value.lower(), 0, 0
    while i < len(low):
        for size in range(min(11, len(low) - i), 3, -1):
            if low[i : i + size] in DICTIONARY:
                found += size
                i += size
                break
        else:
            i += 1
    return found / max(1, len(low))


def features(value: str, before: str, after: str, path: str | None, kind: str) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    count = Counter(value)
    low = value.lower()
    pairs = [_PAIRS[a + b] for a, b in zip(low, low[1:]) if a + b in _PAIRS]
    near = before.lower()[-WINDOW:]
    words = set(re.findall(r"[a-z]+", near)) | set(re.findall(r"[a-z]+", after.lower()[:WINDOW]))
    joined = near + " " + after.lower()[:WINDOW]
    where = (path or "").lower()
    return [
        n,
        math.log(n + 1),
        -sum(v / n * math.log2(v / n) for v in count.values()) if n else 0.0,
        sum(pairs) / len(pairs) if pairs else -4.0,
        len(pairs) / max(1, n - 1),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        coverage(value),
        kinds.count(2) / max(1, n),
        kinds.count(1) / max(1, n),
        kinds.count(0) / max(1, n),
        kinds.count(3) / max(1, n),
        float(all(c in "0123456789abcdef" for c in low) and n > 0),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", low))),
        max(count.values(), default=0) / max(1, n),
        float(sum(a == b for a, b in zip(value, value[1:])) / max(1, n - 1)),
        float(any(x in joined for x in CUES)),
        float(any(x in joined or x in low for x in FAKES)),
        float(bool(words & set(HASHES))),
        float(kind in _PROVIDER),
        float(kind == "assigned"),
        float(sum(x in where for x in PATHS)),
        float("/" in value or "." in value),
        float(any(c in "${}()[]%" for c in value)),
        float(sum(c in "aeiou" for c in low) / max(1, n)),
    ]


def _named(text: str, at: int) -> bool:
    """Whether the name before the sign at ``at`` holds a keyword anywhere (DB_PASSWORD, userPassword, refresh-token)."""
    hi = at
    while hi and at - hi < 3 and text[hi - 1].isspace():
        hi -= 1
    if hi and text[hi - 1] in "\"'":
        hi -= 1
    lo = hi
    while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.-"):
        lo -= 1
    return bool(_NAME.search(text, lo, hi))


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every candidate, in text order; a null or empty text has none.

    Of candidates that overlap a provider's format wins over an assigned value, and that over a
    bare run of 24 characters and more with a digit. A candidate is always the whole run.
    """
    if not text:
        return []
    found = []
    if any(x in text for x in _LITERALS):
        found += [(m.lastgroup, *m.span()) for m in PROVIDERS.finditer(text)]
    if "=" in text or ":" in text:
        stop = 0  # end of the run that was measured last; signs inside it share it
        for m in _SIGN.finditer(text):
            at = m.start()
            value = _VALUE.match(text, at)
            if value and _named(text, at):
                if value.start(1) >= stop:
                    stop = _RUN.match(text, value.start(1)).end()
                found.append(("assigned", value.start(1), stop))
    if max(map(len, text.split()), default=0) >= 24:
        found += [("bare", *m.span()) for m in _BARE.finditer(text) if _DIGIT.search(text, *m.span())]
    out: list[tuple[str, int, int]] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], _RANK.get(x[0], 0), x[1] - x[2])):
        if out and s < out[-1][2]:
            if _RANK.get(kind, 0) < _RANK.get(out[-1][0], 0):
                out[-1] = (kind, s, e)
            continue
        out.append((kind, s, e))
    return out


def labelled_findings(rows: int = 6000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label): seeded findings as reviewers label them, half of them secrets."""
    rng = random.Random(seed)
    hexes, caps, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = sorted(DICTIONARY)
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    prose = lambda: " ".join(run("aeiouthnrsdl", rng.randrange(2, 9)) for _ in range(rng.randrange(0, 5)))
    real_path = lambda: rng.choice(["", "src0", "src9", "app/config.py", "deploy/prod.env", "server/settings.yaml", "src/main.go", "notes.txt"])
    fake_path = lambda: rng.choice(["", "src0", "src9", "docs/readme.md", "tests/test_auth.py", "example/config.py", "package.lock", "src/main.go", "vendor/lib.js"])
    out = []
    for i in range(rows):
        quote = rng.choice(["", '"', "'"])
        if i % 2:
            form = rng.randrange(6)
            cue = rng.choice(["password", "passwd", "token", "secret", "api_key", "auth_token", "DB_PASSWORD", "client_secret", "access_key"])
            before = f"{prose()} {cue}{rng.choice(['=', ' = ', ': '])}{quote}"
            if form == 0:
                value, before = "AKIA" + run(caps, 16), rng.choice([prose() + " ", prose() + " key ", f"aws_access_key_id = {quote}"])
            elif form == 1:
                value = run(hexes, rng.choice([16, 18, 20, 24, 32, 40, 40, 48, 64]))
            elif form == 2:
                value = run(mixed, rng.randrange(12, 44))
            elif form == 3:
                value, before = rng.choice(["ghp_", "gho_", "ghs_"]) + run(mixed, 36), rng.choice([before, prose() + " "])
            elif form == 4:
                value, before = rng.choice(["sk_live_", "rk_live_", "xoxb-", "AIza"]) + run(mixed, 35), rng.choice([before, prose() + " "])
            else:
                value = run(mixed + "!#%&*+-_", rng.randrange(9, 20))
            out.append((value, before, quote + " " + prose(), real_path(), 1))
        else:
            form = rng.randrange(8)
            cue = rng.choice(["password", "token", "secret", "api_key", "key"])
            before = f"{prose()} {cue}{rng.choice(['=', ' = ', ': '])}{quote}"
            if form == 0:
                value, before = run(hexes, rng.choice([32, 40, 64])), f"{prose()} {rng.choice(['commit', 'sha256', 'md5', 'checksum', 'digest', 'revision'])} "
            elif form == 1:
                value = rng.choice(["changeme", "your_password_here", "placeholder", "xxxxxxxxxxxx", "<redacted>", "example_token", "dummy_secret", "password123", "letmein"]) + rng.choice(["", "1", "_value"])
            elif form == 2:
                value = "_".join(rng.choice(words) for _ in range(rng.randrange(2, 5)))
            elif form == 3:
                value = rng.choice(["os.environ", "process.env", "config.get", "self", "request"]) + "." + "_".join(rng.choice(words) for _ in range(2))
            elif form == 4:
                h = run(hexes, 32)
                value, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{prose()} {rng.choice(['id', 'uuid', 'guid'])} "
            elif form == 5:
                value, before = "/".join(rng.choice(words) for _ in range(rng.randrange(4, 8))) + str(rng.randrange(10)), prose() + " "
            elif form == 6:
                value = "${" + rng.choice(words).upper() + "_" + cue.upper() + "}"
            else:
                value, before = "".join(w.capitalize() for w in rng.choices(words, k=rng.randrange(4, 7))) + str(rng.randrange(100)), prose() + " "
            out.append((value, before, quote + " " + prose(), fake_path(), 0))
    return out


class Forest:
    """Random forest of binary splits by Gini impurity."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[pick], y[pick].astype(float), depth, rng, nodes)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, x, y, depth, rng, nodes) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean() if len(y) else 0.0])
        if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
            return at
        best = (1e-12, -1, 0.0)
        base = y.mean() * (1 - y.mean()) * len(y)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= LEAST) & (len(y) - k >= LEAST)
            if not ok.any():
                continue
            left, total = ones[:-1], ones[-1]
            gain = base - left * (1 - left / k) - (total - left) * (1 - (total - left) / (len(y) - k))
            gain[~ok] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return at
        side = x[:, best[1]] <= best[2]
        left = self._grow(x[side], y[side], depth - 1, rng, nodes)
        right = self._grow(x[~side], y[~side], depth - 1, rng, nodes)
        nodes[at] = [best[1], best[2], left, right, nodes[at][4]]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return total / max(1, len(self.trees))


def kind_of(value: str, before: str) -> str:
    """The kind under which the scan would report a labelled value."""
    m = PROVIDERS.match(value)
    if m:
        return m.lastgroup
    return "assigned" if re.search(r"(?::=|=>|[:=])\s{0,3}[\"']?$", before) else "bare"


def train(labelled: DataFrame | None = None, rows: int = TRAIN_ROWS) -> Forest:
    """A forest from labelled findings (value, before, after, path, label); at most about ``rows`` of them, chosen by hash.

    Rows with a null value or label are ignored; other nulls read as empty.
    """
    if labelled is None:
        found = labelled_findings()
    else:
        require(labelled, "value", "before", "after", "path", "label")
        labelled = labelled.filter("value is not null and label is not null")
        total = labelled.count()
        if total > rows:
            labelled = labelled.filter(share("value", rows / total))
        found = [(r["value"], r["before"] or "", r["after"] or "", r["path"], int(r["label"])) for r in labelled.select("value", "before", "after", "path", "label").toLocalIterator()]
    if not found:
        raise ValueError("there are no labelled findings")
    x = np.array([features(v, b, a, p, kind_of(v, b)) for v, b, a, p, _ in found])
    return Forest().fit(x, np.array([f[4] for f in found]))


def scan(docs: DataFrame, forest: Forest | None = None, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start, end, preview, fingerprint, score): findings that the forest takes for secrets.

    ``preview`` is the value's first four characters, ``fingerprint`` its SHA-256: results hold no
    secret. Offsets are code points. A null or missing path counts as empty; null ids and repeated
    rows are scanned like any other.
    """
    require(docs, key, text)
    forest = train() if forest is None else forest
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = [], []
            for i, t, p in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for kind, s, e in candidates(t):
                    rows.append((i, kind, s, e, t[s : s + 4], hashlib.sha256(t[s:e].encode()).hexdigest()))
                    x.append(features(t[s:e], t[max(0, s - WINDOW) : s], t[e : e + WINDOW], p, kind))
            if rows:
                score = forest.predict(np.array(x))
                kept = [(*r, float(z)) for r, z in zip(rows, score) if z >= threshold]
                if kept:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], ["doc_id", "kind", "start", "end", "preview", "fingerprint", "score"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), where.alias("path"))
    return mapped(narrow, run, "doc_id long, kind string, start long, end long, preview string, fingerprint string, score double")
