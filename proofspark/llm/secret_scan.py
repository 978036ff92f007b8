"""Secret scans: fixed patterns, and a character convolutional network that scores every candidate in its context."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proofspark.session import written

# Fixed patterns of the base findings, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}

#: What the network looks at besides: runs of these characters, from 6 on with a digit, from 12 on without.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
DIGIT = re.compile(r"[0-9]")
PLAIN = 12
_HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))

# Fixed shapes of runs that are checked to be clean: dates, short numbers, and words in any case, joined by signs or capitals;
# card numbers by their check digit.
DATE = re.compile(r"(?:19|20)[0-9]{2}([-/]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])")
CARD, NUMBER = re.compile(r"[0-9]{13,19}"), re.compile(r"[0-9]{6,12}")
WORDS = re.compile(r"(?:(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})[+/_=-]*)+")
HARSH = re.compile(r"[b-df-hj-np-tv-xz]{6}")
VOWELS = re.compile(r"[aeiouy]")

#: Characters before a candidate, of a window, behind a candidate; characters from one window of a long candidate to the next.
BEFORE, WIDTH, AFTER, STRIDE = 16, 72, 8, 27
#: Share of the findings that sets the threshold; recall it must keep.
CALIBRATED, RECALL = 0.3, 0.99
#: Findings of a lot on average, real secrets a lot at least if there are as many, passes over all lots, steps of a pass at least if there is one lot.
LOT, KNOWN, PASSES, STEPS = 4096, 256, 3, 400
#: Findings and generated samples in a step: clean, then secrets.
PORTIONS = ((48, 16), (12, 4))
#: Responses of the network that set the threshold are counted in cells of one part in so many.
GRID = 1024
#: Clean runs whose surroundings generated samples get.
CONTEXTS = 3000
#: Findings of texts that set the threshold by themselves; with fewer, generated ones that were held back join them.
ENOUGH = 200
#: Generated samples a label that are added to the findings.
GENERATED = 1500
EMBED, FILTERS, SPAN, EPOCHS, RATE = 8, 24, 5, 12, 0.01


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings of a whole text; each kind leftmost and without overlaps."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    if b"x" * SHORTEST["hex"] in text.encode().translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= SHORTEST["hex"]]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that may be secrets besides the base findings: all but those that lie inside of one."""
    spans = [m.span() for m in CANDIDATE.finditer(text) if len(m[0]) >= PLAIN or DIGIT.search(m[0])]
    if not base:
        return spans
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, b, _ in base), max))  # base findings are in the order of their starts
    return [s for s in spans if not ((k := bisect.bisect_right(starts, s[0])) and s[1] <= reach[k - 1])]


def window(text: str, start: int, end: int) -> str:
    """A candidate between marks, with its surroundings, at a fixed place; of long ones the first characters."""
    shown = text[start:end][: WIDTH - BEFORE - 1] + "\x02" + text[end : end + AFTER]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE) + "\x01" + shown[: WIDTH - BEFORE - 1]


def windows_of(text: str, start: int, end: int) -> list[str]:
    """Overlapping windows over all of a candidate and what stands behind it; one if it is short."""
    seen, last = WIDTH - BEFORE - 2, min(len(text), end + AFTER)
    steps = max(0, -(-(last - start - seen) // STRIDE))
    return [window(text, start + k * STRIDE, end) for k in range(steps + 1)]


def codes(windows: list[str]) -> np.ndarray:
    """Windows as numbers: ASCII as it is, all else one class, 0 behind the end."""
    out = np.zeros((len(windows), WIDTH), np.uint8)
    for k, w in enumerate(windows):
        c = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)[:WIDTH]
        out[k, : len(c)] = np.where(c < 127, c, 127)
    return out


@dataclass
class Network:
    """Embedding, one convolution, largest and mean response, one linear layer; scores are calibrated by scale and shift."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    #: Reached at the threshold on the calibration part.
    recall: float = float("nan")
    precision: float = float("nan")
    #: Findings of texts that it learned from, and that calibrated it.
    learned: int = 0
    held: int = 0

    def forward(self, x: np.ndarray):
        w = self.weights
        e = w["embed"][x]
        cols = np.concatenate([e[:, k : WIDTH - SPAN + 1 + k] for k in range(SPAN)], 2)
        h = np.maximum(cols @ w["conv"] + w["bias"], 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return cols, h, top, pooled, pooled @ w["out"] + w["last"][0]

    def score(self, windows: list[str]) -> np.ndarray:
        parts = [self.forward(codes(windows[k : k + 512]))[4] for k in range(0, len(windows), 512)]
        z = np.concatenate(parts) if parts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def train_network(windows: list[str], labels: np.ndarray, seed: int = 7, held_out: list[tuple[list[str], int]] | None = None) -> Network:
    """Adam on cross entropy; then findings that were held out set scale, shift and the highest threshold that keeps the recall.

    ``held_out``: the windows and the label of each such finding, which counts once, with its highest score. Without them
    a part of ``windows`` is held out.
    """
    rng = np.random.default_rng(seed)
    net = Network(_start(rng))
    if not len(windows) or labels.all() or not labels.any():
        return net  # nothing to tell apart: the threshold of 2 adds no span
    x, y = codes(windows), labels.astype(float)
    order = rng.permutation(len(y))
    cut = max(1, int(len(y) * CALIBRATED))
    if held_out is None:
        held_out = [([windows[k]], int(labels[k])) for k in order[:cut]]
        order = order[cut:]
    adam = Adam(net)
    for _ in range(EPOCHS):
        order = rng.permutation(order)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            adam.step(x[rows], y[rows], np.full(len(rows), 1 / len(rows)))
    if held_out:
        z = _responses(net, [vs for vs, _ in held_out])
        calibrate(net, z, np.array([label for _, label in held_out], float), np.ones(len(z)))
    return net


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {"embed": rng.normal(0, 0.3, (128, EMBED)), "conv": rng.normal(0, 0.2, (SPAN * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 2 * FILTERS), "last": np.zeros(1)}


class Adam:
    """Steps on the weighted cross entropy of a network, whose weights change in place."""

    def __init__(self, net: Network, rate: float = RATE) -> None:
        self.net, self.rate, self.steps = net, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        w = self.net.weights
        cols, h, top, pooled, z = self.net.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(h.dtype)
        grad = {"out": pooled.T @ d, "last": np.array([d.sum()])}
        dp = d[:, None] * w["out"]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh[h <= 0] = 0
        grad["bias"] = dh.sum((0, 1))
        grad["conv"] = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, FILTERS)
        dc = (dh.reshape(-1, FILTERS) @ w["conv"].T).reshape(len(x), -1, SPAN * EMBED)
        de = np.zeros((len(x), WIDTH, EMBED), h.dtype)
        for k in range(SPAN):
            de[:, k : WIDTH - SPAN + 1 + k] += dc[:, :, k * EMBED : (k + 1) * EMBED]
        cells = (x.ravel().astype(np.int64)[:, None] * EMBED + np.arange(EMBED)).ravel()
        grad["embed"] = np.bincount(cells, de.ravel(), 128 * EMBED).reshape(128, EMBED)
        self.steps += 1
        for k, g in grad.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            w[k] -= self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


def _responses(net: Network, findings: list[list[str]]) -> np.ndarray:
    """Highest response of each finding's windows."""
    if not findings:
        return np.empty(0)
    views = [v for vs in findings for v in vs]
    starts = np.cumsum([0] + [len(vs) for vs in findings])[:-1]
    return np.maximum.reduceat(np.concatenate([net.forward(codes(views[k : k + 512]))[4] for k in range(0, len(views), 512)]), starts)


def calibrate(net: Network, z: np.ndarray, t: np.ndarray, n: np.ndarray) -> None:
    """Scale, shift and threshold from responses ``z`` with labels ``t`` that were found ``n`` times each."""
    a, b, total = 1.0, 0.0, n.sum()
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = max(0.05, a - 0.1 * (((q - t) * z * n).sum() / total + 0.01 * a)), b - 0.1 * ((q - t) * n).sum() / total
    net.scale, net.shift = float(a), float(b)
    scores = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
    order = np.argsort(scores[t == 1])
    good, many = scores[t == 1][order], np.cumsum(n[t == 1][order])
    if len(good):
        net.threshold = float(good[np.searchsorted(many, int((1 - RECALL) * many[-1]), "right")])
        taken = scores >= net.threshold
        net.recall, net.precision = float(n[taken & (t == 1)].sum() / many[-1]), float(n[taken & (t == 1)].sum() / n[taken].sum())


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in weights.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray], kind=float) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: x.reshape(v.shape).astype(kind) for (k, v), x in zip(like.items(), np.split(flat, ends[:-1]))}


def _lot(weights: dict[str, np.ndarray], made: list[tuple[list[str], int]], turn: int, least: int):
    """A lot's pass from common weights: (at, value) of the weights it ends with; behind them its findings, copies not counted.

    Every clean run takes part once, secrets and generated samples in turn; both labels weigh the same.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["views"].to_pylist(), table["label"].to_pylist(), table["copy"].to_pylist(), table["lot"].to_pylist()))
        rng = np.random.default_rng([turn, rows[0][3]])
        net = Network(_shaped(_flat(weights), weights, np.float32))
        adam = Adam(net, RATE / (1 + turn))
        real = [codes([v for vs, label, _, _ in rows if label == k for v in vs]) for k in (0, 1)]
        extra = [codes([v for vs, label in made if label == k for v in vs]) for k in (0, 1)]
        steps, order = max(least, -(-len(real[0]) // PORTIONS[0][0])), {}

        def some(k: int, of: np.ndarray, at: int, n: int) -> np.ndarray:
            key = (k, of is extra[k])
            while len(order.setdefault(key, np.empty(0, np.int64))) < (at + 1) * n:
                order[key] = np.concatenate([order[key], rng.permutation(len(of))])
            return of[order[key][at * n : (at + 1) * n]]

        for at in range(steps):
            parts = []
            for k, (n, m) in enumerate(PORTIONS):
                n, m = (n if len(real[k]) else 0, m if len(real[k]) else n + m) if len(extra[k]) else (n + m, 0)
                parts.append(np.concatenate([some(k, of, at, c) for of, c in ((real[k], n), (extra[k], m)) if c]))
            y = np.repeat([0.0, 1.0], [len(x) for x in parts])
            adam.step(np.concatenate(parts), y, np.concatenate([np.full(len(x), 0.5 / len(x)) for x in parts]))
        values = np.append(_flat(net.weights).astype(float), sum(copy == 0 for _, _, copy, _ in rows))
        return pa.table({"at": pa.array(np.arange(len(values)), pa.int32()), "value": values})

    return run


def _cells(net: Network):
    """Held findings to (label, cell of their response)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _responses(net, b.column("views").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(_cell(z), pa.int32())], ["label", "cell"])

    return run


def _cell(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -30, 30) * GRID).astype(np.int32)


def _luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def clean(run: str) -> bool:
    """Whether a candidate is checked to be no secret: a valid card number, a short number, a date, or words that can be spoken."""
    if CARD.fullmatch(run):
        return _luhn(run)
    if NUMBER.fullmatch(run) or DATE.fullmatch(run):
        return True
    low = run.lower()
    return bool(WORDS.fullmatch(run)) and not HARSH.search(low) and 4 * len(VOWELS.findall(low)) >= len(run)


def generated(kinds: list[str], contexts: list[str], n: int = GENERATED, seed: int = 11) -> list[tuple[list[str], int]]:
    """Windows and label of ``n`` secrets in the language of these base patterns, with and without the words before them, and of ``n`` clean runs."""
    draw = random.Random(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + digits, lower + digits, upper + lower]
    some = lambda alphabet, low, high: "".join(draw.choices(alphabet, k=draw.randint(low, high)))

    def secret(kind: str) -> str:
        return {"assign": lambda: some(draw.choice(alphabets), 12, 64), "access": lambda: "AKIA" + some(upper + digits, 16, 16), "hex": lambda: some("0123456789abcdef", 24, 64)}[kind]()

    def harmless() -> str:
        form = draw.randrange(4)
        if form == 0:
            body = some(digits, 5, 18)
            return next(body + c for c in digits if len(body) < 12 or _luhn(body + c))
        if form == 1:
            return draw.choice(["", "-", "/"]).join((str(draw.randint(1900, 2099)), f"{draw.randint(1, 12):02}", f"{draw.randint(1, 28):02}"))
        heads, tails = [*"bcdfghlmnprstvwz", "sch", "ch", "bl", "pf", "st", "th"], ["", "", "n", "r", "l", "st", "nd", "cht", "ng"]
        word = lambda: "".join(draw.choice(heads) + draw.choice("aeiou") + draw.choice(tails) for _ in range(draw.randint(2, 6)))
        run = draw.choice("-_/").join(word() for _ in range(draw.randint(1, 4))).ljust(PLAIN, "o")
        return run.upper() if form == 2 else draw.choice([run, run.title(), run.capitalize()])

    out = []
    for label in (1, 0):
        for _ in range(n if label == 0 or kinds else 0):
            run = secret(draw.choice(kinds)) if label else harmless()
            named = label and draw.random() < 0.3
            before = draw.choice(contexts) + (draw.choice(KEYWORDS) + draw.choice([" = \"", ": ", "="]) if named else draw.choice(["", "", "\"", "(", ": "]))
            text = before + run + draw.choice(["", " ", "\" ", ". ", ", ", ") "]) + draw.choice(contexts)
            out.append((windows_of(text, len(before), len(before) + len(run)), label))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their findings and clean runs: (views, kind, held); ``held`` texts, told by their checksum, are for calibration."""
    for b in batches:
        views, kinds, held = [], [], []
        for text in b.column(0).to_pylist():
            text = text or ""
            base, apart = base_spans(text), zlib.crc32(text.encode("utf-8", "surrogatepass")) % 10 < 10 * CALIBRATED
            for start, end, kind in base:
                m = ASSIGN.match(text, start) if kind == "assign" else None
                views.append(windows_of(text, m.start(2) if m else start, end))
                kinds.append(kind)
                held.append(apart)
            spans = [(a, b, clean(text[a:b])) for a, b in candidates(text, base)]
            open_spans = sorted([s[:2] for s in base] + [(a, b) for a, b, good in spans if not good])
            starts, reach = [a for a, _ in open_spans], list(itertools.accumulate((b for _, b in open_spans), max))
            for start, end, good in spans:
                k = bisect.bisect_left(starts, end + AFTER)
                if good and not (k and reach[k - 1] > start - BEFORE):  # nothing unchecked in its surroundings either
                    views.append(windows_of(text, start, end))
                    kinds.append("clean")
                    held.append(apart)
        yield pa.RecordBatch.from_arrays([pa.array(views, pa.list_(pa.string())), pa.array(kinds, pa.string()), pa.array(held, pa.bool_())], ["views", "kind", "held"])


def train(docs: DataFrame, left_out: str | None = None) -> Network:
    """Base findings of all texts against all runs that are checked to be clean, and generated samples of both; what no pattern knows is on neither side.

    The network learns from every finding of the texts that are not held: these are dealt by their digests into lots of
    bounded size, each lot continues from the common weights, and the mean of all lots' weights begins the next pass. As
    secrets are fewer than clean runs, each takes part in several lots. All findings of the held texts, each once,
    calibrate it: their responses are counted in cells, so scale, shift and threshold come from all of them. A base
    kind ``left_out`` takes no part in training and calibration, so its findings tell how the network does on kinds
    that it never saw.
    """
    taught = [k for k in KINDS[:-1] if k != left_out]
    found = docs.select("text").mapInArrow(_labelled, "views array<string>, kind string, held boolean")
    found = found.groupBy("views").agg(F.collect_set("kind").alias("kinds"), F.min("held").alias("held"))
    found = found.where(~F.array_contains("kinds", left_out)) if left_out else found
    labels = F.array_compact(F.array(F.when(F.array_contains("kinds", "clean"), 0), F.when(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in taught])), 1)))
    samples = written(found.select("views", "held", F.xxhash64("views").alias("digest"), F.explode(labels).alias("label")), "secret-samples")
    count = {(r["held"], r["label"]): r["count"] for r in samples.groupBy("held", "label").count().collect()}
    near = samples.where("label = 0").orderBy("digest", "views").limit(CONTEXTS).select(F.col("views")[0].alias("v")).collect()
    contexts = [r["v"][: BEFORE - 1].strip("\x01") + " " for r in near] or ["", "see ", "and the ", "with a "]
    made, held_made = generated(taught, contexts), []
    if count.get((True, 1), 0) < ENOUGH:
        apart = int(1 / CALIBRATED)
        held_made, made = made[::apart], [x for k, x in enumerate(made) if k % apart]

    clean_runs, secret_runs = count.get((False, 0), 0), count.get((False, 1), 0)
    lots = max(1, (clean_runs + secret_runs) // LOT)
    copies = F.when(F.col("label") == 1, min(lots, -(-KNOWN * lots // max(1, secret_runs)))).otherwise(1)
    dealt = samples.where("not held").select("views", "label", "digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    dealt = dealt.select("views", "label", "copy", F.pmod(F.col("digest") + F.col("copy"), F.lit(lots)).cast("int").alias("lot"))
    weights = _start(np.random.default_rng(7))
    net = Network(weights)
    for turn in range(PASSES):
        work = _lot(weights, made, turn, STEPS // lots)
        if clean_runs + secret_runs:
            ended = dealt.groupBy("lot").applyInArrow(work, "at int, value double").groupBy("at").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum")).orderBy("at").collect()
            values, net.learned = np.array([r["mean"] for r in ended[:-1]]), int(ended[-1]["sum"])
        else:
            values = work(pa.table({"views": pa.array([[]], pa.list_(pa.string())), "label": [0], "copy": [1], "lot": [0]}))["value"].to_numpy()[:-1]
        net.weights = weights = _shaped(np.round(values, 6), weights)  # the order of summing plays no part
    cells = samples.where("held").select("views", "label").mapInArrow(_cells(net), "label int, cell int").groupBy("label", "cell").count().collect()
    rows = sorted((r["cell"], r["label"], r["count"]) for r in cells) + sorted((int(c), label, 1) for c, (_, label) in zip(_cell(_responses(net, [v for v, _ in held_made])), held_made))
    net.held = sum(r["count"] for r in cells)
    if rows:
        z, t, n = np.array(rows, float).T
        calibrate(net, z / GRID, t, n)
    return net


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scan(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, windows, owners = [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text or "")
                for s in candidates(text or "", base):
                    views = windows_of(text, *s)
                    owners.append((len(found), s, len(windows)))
                    windows += views
                found.append((base, list(base)))
            scores = net.score(windows)
            best = np.zeros(len(found))
            highest = np.maximum.reduceat(scores, [at for _, _, at in owners]) if owners else []
            for (k, (start, end), _), score in zip(owners, highest):
                best[k] = max(best[k], score)
                if score >= net.threshold:
                    found[k][1].append((start, end, "model"))
            count = lambda kind: pa.array([sum(s[2] == kind for s in base) for base, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x, _ in found]),
                 pa.array([_joined(y) for _, y in found]), pa.array([len(y) - len(x) for x, y in found], pa.int64()), pa.array(best)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "best"])

    return run


def secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model, best) of every row, from whole texts.

    Base findings always stay; the network scores every other candidate, a long one by the
    highest score of its windows, and adds those that reach its threshold. A null text
    is empty. Repeated rows are repeated, other columns ignored.
    """
    net = train(docs) if net is None else net
    return docs.select("doc_id", "text").mapInArrow(
        _scan(net), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint, best double")
