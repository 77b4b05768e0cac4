"""Toxicity by maximum-scoring segments of token log-odds.

A token is scored by the longest of its units (the word, then its prefixes) that enough labelled texts hold:
the unit's log-odds between toxic and clean texts, with a Dirichlet prior whose mean is its share in
both. Units of little evidence score nothing of their own; such tokens share the log-odds of all
unscored tokens, a small negative number.
A linear-time scan (Ruzzo and Tompa) finds every maximal segment of positive total. Under the
clean texts the best segment of a text of n tokens follows an extreme-value law of location
a + b ln n; a text is judged by its segments' probabilities under that law.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches
from tidewatch.sources.runtime import Scratch

SAMPLE = 10_000  # labelled rows of each label that the model is fitted on, at most
FIT_TASKS = 16  # what is fitted on is bounded, so a few tasks and files do
PRIOR, PRIOR_TEXTS = 10_000.0, 50.0  # Dirichlet weights, in tokens and in texts
LEAST_TEXTS, LEAST_Z = 8, 4.0  # a unit counts from so many texts on, and scores from so many deviations on
PREFIXES = range(3, 8)
FLOOR, CEILING = -3.0, 6.0
MAX_P = 1e-3  # segments less likely than that under the clean law are significant

_STRIP = b".,;:!?\"'()[]{}<>*%&#$|-_=+~^/\\`"


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation at their ends."""
    if not text:
        return []
    return [w.strip(_STRIP) for w in text.encode("utf-8", "surrogatepass").lower().split()]


def units_of(word: bytes) -> list[bytes]:
    """The word, then its prefixes from the longest on, which end with a star."""
    s = word.decode("utf-8", "replace")
    return [word, *(s[:k].encode("utf-8") + b"*" for k in reversed(PREFIXES) if len(s) > k)]


def segments(scores: list[float], at: list[int], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (Ruzzo and Tompa) as (first, last, score).

    scores and at: the scored tokens and their places; every token between them scores gap (< 0).
    """
    left: list[float] = []
    right: list[float] = []
    spans: list[list[int]] = []
    total, place = 0.0, -1
    for s, i in zip(scores, at, strict=True):
        total += gap * (i - place - 1)
        place = i
        if s <= 0:
            total += s
            continue
        low, high, span = total, total + s, [i, i]
        total = high
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j -= 1
            if j < 0 or right[j] >= high:
                break
            low, span = left[j], [spans[j][0], span[1]]
            del left[j:], right[j:], spans[j:]
        left.append(low)
        right.append(high)
        spans.append(span)
    return [(a, b, r - l) for (a, b), l, r in zip(spans, left, right, strict=True)]


class Model:
    """Token scores, the law of the best clean segment, and the logistic curve on top."""

    def __init__(self, scores: dict[bytes, float | None], gap: float):
        """scores: by unit; None where a unit is known to say nothing, so that its prefixes don't count."""
        self.scores, self.gap = scores, gap
        self.words: dict[bytes, float | None] = {}
        self.location, self.slope, self.scale = 0.0, 0.0, 1.0
        self.curve = (-3.0, 1.0)

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def _word(self, word: bytes) -> float | None:
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[word] = s = next((self.scores[u] for u in units_of(word) if u in self.scores), None)
        return s

    def marks(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """Number of tokens, and the places and scores of the scored ones."""
        words, at, scores, memo = tokens_of(text), [], [], self.words
        for i, w in enumerate(words):
            if (s := memo[w] if w in memo else self._word(w)) is not None:
                at.append(i)
                scores.append(s)
        return len(words), at, scores

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        n, at, scores = self.marks(text)
        return n, segments(scores, at, self.gap)

    def p_value(self, score: float, n: int) -> float:
        """Probability that the best segment of a clean text of n tokens scores that much."""
        z = (score - self.location - self.slope * math.log(n + 1)) / self.scale
        return -math.expm1(-math.exp(min(-z, 700.0)))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """-log10 of the probabilities of the significant segments, summed; else that of the best one."""
        if not found:
            return 0.0
        logs = [-math.log10(max(self.p_value(s, n), 1e-30)) for _, _, s in found]
        return max(max(logs), sum(x for x in logs if x >= -math.log10(MAX_P)))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * evidence))))


def fit_law(model: Model, clean: list[tuple[int, float]]) -> Model:
    """Fit the extreme-value law by moments, its location linear in ln n. clean: tokens and best segment of the clean texts."""
    if clean:
        x, s = np.log(np.array([n for n, _ in clean]) + 1.0), np.array([v for _, v in clean])
        slope = max(0.0, float(np.cov(x, s, bias=True)[0, 1] / x.var())) if x.var() > 1e-9 else 0.0
        rest = s - slope * x
        scale = max(0.5, float(rest.std()) * math.sqrt(6) / math.pi)
        model.slope, model.scale, model.location = slope, scale, float(rest.mean()) - 0.5772 * scale
    return model


def fit_curve(model: Model, found: list[tuple[float, int]]) -> Model:
    """Fit the logistic curve by Newton steps. found: evidence and label of each text."""
    y = np.array([v for _, v in found], float)
    if len(set(y.tolist())) == 2:
        e = np.minimum([v for v, _ in found], 30.0)
        f, w = np.stack([np.ones_like(e), e], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2), f.T @ (y - p) - 1e-2 * w)
            w += step
            if abs(step).max() < 1e-9:
                break
        model.curve = (float(w[0]), max(1e-6, float(w[1])))
    return model


def _labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """text, y of a bounded sample of labelled rows of each label: those whose ids hash lowest."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y)
        if counts.get(y, 0) > sample:  # first a share of ids by hash that is some deviations short of the bound, then the bound itself
            share = (sample - 4 * math.sqrt(sample)) / counts[y]
            part = part.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.join(F.broadcast(picked), "id").select("text", "y")  # at most 2 * sample rows of two numbers are sent
    return Scratch(docs.sparkSession, "toxic").table(chosen.dropDuplicates(["text", "y"]).coalesce(FIT_TASKS))  # copies would count as evidence


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled rows. docs: id, text. Without rows of both labels no token scores."""
    chosen = _labelled(docs, labels, label, sample)

    def start():
        def work(batch):
            tokens, texts = (Counter(), Counter()), (Counter(), Counter())
            for t, y in zip(batch["text"], batch["y"], strict=True):
                own: Counter = Counter()
                for w, c in Counter(tokens_of(t)).items():
                    for u in units_of(w):
                        own[u] += c
                tokens[y].update(own)
                texts[y].update(own.keys())
            units = list(tokens[0].keys() | tokens[1].keys())
            return {"unit": units} | {name: [c[u] for u in units] for name, c in (("a", tokens[1]), ("b", tokens[0]), ("da", texts[1]), ("db", texts[0]))}

        return work

    counted = map_batches(chosen, start, "unit binary, a bigint, b bigint, da bigint, db bigint", rows=2048)
    counted = counted.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("a", "b", "da", "db"))).filter(F.col("da") + F.col("db") >= LEAST_TEXTS)
    counted = Scratch(docs.sparkSession, "toxic").table(counted.coalesce(FIT_TASKS))
    n = chosen.groupBy("y").agg(F.count(F.lit(1)).alias("d"), F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))).alias("n")).collect()
    n = {r["y"]: (r["d"], r["n"] or 0) for r in n}
    if len(n) < 2 or not n[0][1] or not n[1][1]:
        return Model({}, FLOOR)
    (d0, n0), (d1, n1) = n[0], n[1]

    def odds(a, b, prior, total1, total0):
        mean = prior * (F.col(a) + F.col(b)) / float(total1 + total0)
        x, y = F.col(a) + mean, F.col(b) + mean
        return F.log(x / F.greatest(total1 + prior - x, F.lit(0.5))) - F.log(y / F.greatest(total0 + prior - y, F.lit(0.5))), x, y

    d, _, _ = odds("a", "b", PRIOR, n1, n0)
    dt, x, y = odds("da", "db", PRIOR_TEXTS, d1, d0)
    judged = counted.select("unit", d.alias("d"), (dt / F.sqrt(1 / x + 1 / y)).alias("z"), (F.col("da") + F.col("db")).alias("texts"))
    # How many units there are is bounded by the sample alone: each was met in LEAST_TEXTS of its texts.
    top = judged.filter(F.abs("z") >= LEAST_Z).collect()
    scores: dict[bytes, float | None] = {bytes(r["unit"]): max(FLOOR, min(CEILING, r["d"])) for r in top}

    def start_silent():
        def work(batch):
            kept = [u for u in map(bytes, batch["unit"]) if any(p in scores for p in (units_of(u[:-1])[1:] if u.endswith(b"*") else units_of(u)[1:]))]
            return {"unit": kept}

        return work

    silent = judged.filter(F.abs("z") < LEAST_Z)
    scores |= {bytes(r["unit"]): None for r in map_batches(silent.select("unit"), start_silent, "unit binary", rows=4096).collect() if bytes(r["unit"]) not in scores}

    def start_shares():
        model = Model(scores, FLOOR)

        def work(batch):
            rows = [model.marks(t) for t in batch["text"]]
            return {"n": [r[0] for r in rows], "bare": [r[0] - len(r[1]) for r in rows], "y": batch["y"]}

        return work

    shares = {r["y"]: (r["bare"], r["n"]) for r in map_batches(chosen, start_shares, "n bigint, bare bigint, y int").groupBy("y").agg(F.sum("bare").alias("bare"), F.sum("n").alias("n")).collect()}
    share = lambda y: math.log((0.5 + shares[y][0]) / (1.0 + shares[y][1]))
    model = Model(scores, min(-0.005, share(1) - share(0)))

    def start_best():
        def work(batch):
            rows = [model.segments(t) for t in batch["text"]]
            return {"n": [n for n, _ in rows], "best": [max((s for *_, s in found), default=0.0) for _, found in rows]}

        return work

    # At most `sample` rows of two numbers each time.
    fit_law(model, [(r["n"], r["best"]) for r in map_batches(chosen.filter("y = 0").select("text"), start_best, "n bigint, best double").collect()])

    def start_evidence():
        return lambda batch: {"e": [model.evidence(*model.segments(t)) for t in batch["text"]], "y": batch["y"]}

    return fit_curve(model, [(r["e"], r["y"]) for r in map_batches(chosen, start_evidence, "e double, y int").collect()])


DDL = "id bigint, score double, segments array<struct<first:int,last:int,score:double,p:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: id, text. id, score in 0 to 1, and the significant segments by their tokens."""

    def start():
        def work(batch):
            rows = [model.segments(t) for t in batch["text"]]
            marked = [[{"first": a, "last": b, "score": v, "p": p} for a, b, v in seg if (p := model.p_value(v, n)) < MAX_P] for n, seg in rows]
            return {"id": batch["id"], "score": [model.probability(model.evidence(n, seg)) for n, seg in rows], "segments": marked}

        return work

    return map_batches(docs, start, DDL)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: id, score, segments, predicted (1 from the threshold on).

    The model is fitted on at most `sample` rows of each value of the label (null labels and ids are
    left out) and applied to every row, very long texts included: the scan is linear. Null and empty texts have no segments and get the
    score of no evidence. Of segments with equal totals the one that starts first counts; equal texts score alike, and copies among the
    labelled ones count once for each label. Without rows of both labels nothing is toxic. An empty table gives an empty result; other
    columns are ignored, and ids may be null or repeated.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    model = train(source, labels, label, sample)
    return score(source, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
