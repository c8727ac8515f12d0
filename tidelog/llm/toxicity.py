"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text becomes a row of symbols: insult, threat, target, negation, report, other, and
an end after each clause. Small transducers rewrite that row one after the other: a
negation denies the insults and threats that follow it closely, a verb of report
makes those of its clause reported, a target aims them, and a threat that meets a
target is aimed. They are composed into one table of states, which a matched clause
runs through once. What comes out are weighted clause matches; their sums by kind are
the inputs of a logistic score.

Which word stems are insults is learned: byte prefixes of 4 to 8 bytes, and whole
words of any length (by a 64-bit hash), that stand in labelled toxic texts in more different settings than
chance explains, and hardly in any other. Words of the closed
classes (targets, negations, reports, threats) are fixed values. Training reads a
bounded sample: about ``SAMPLE_DOCS`` labelled documents of each label, by a hash of
doc_id, none over ``SAMPLE_TEXT_BYTES``. Scoring is a narrow stage over whole texts:
words are matched on the bytes with NumPy, and only clauses that hold an insult or a
threat walk the table.

Defined cases: null and empty texts, and texts without a match, get the score of no
match; of several labels of a document the highest counts; without usable labels the
lexicon is empty and the fixed weights hold; rows without a doc_id are scored, not held
out, and not trained on; repeated rows are scored alike; an empty table gives no rows; other columns pass through, those that ``score`` sets are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.runtime import map_in_arrow, share, table
from tidelog.llm.textkit import ALNUM, Words, slices, word_hash

SAMPLE_DOCS = 3000
SAMPLE_TEXT_BYTES = 32768
CUT_OFF = 0.7

# Words of the closed classes, lower-case.
TARGETS = "you your yours u they them he him she her those these du dich dir ihr euch sie tu te toi vous ti usted ustedes ellos".split()
NEGATIONS = "not no never nor dont isnt cannot nicht kein keine nie ne pas jamais ni nunca".split()
REPORTS = "said says say wrote writes called calls quoted quote claimed told asked sagte schrieb dit disait dijo dice".split()
THREATS = "kill hurt destroy murder shoot stab beat burn töten tuer matar".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
INSULT_DENIED, INSULT_REPORTED, INSULT_AIMED, THREAT_DENIED, THREAT_REPORTED, THREAT_AIMED = range(7, 13)
N_SYMBOLS = 13
#: Kinds of matches that are scored, and the weights that hold without labels.
KINDS = {INSULT: 3.0, INSULT_AIMED: 4.0, INSULT_DENIED: 1.0, INSULT_REPORTED: 1.5, THREAT: 0.5, THREAT_AIMED: 3.0, THREAT_DENIED: 0.2, THREAT_REPORTED: 0.5}
PRIOR_BIAS = -1.5

BOUNDARY = np.zeros(256, dtype=bool)
BOUNDARY[[0x0A, 0x21, 0x2E, 0x3A, 0x3B, 0x3F]] = True
WIDTHS = (4, 5, 6, 7, 8)


class Transducer:
    """States by number, 0 first; ``step[state][symbol]`` is (next state, symbol put out)."""

    def __init__(self, step: list[list[tuple[int, int]]]) -> None:
        self.step = step

    @classmethod
    def window(cls, trigger: int, rewrite: dict[int, int], reach: int) -> Transducer:
        """Rewrites what follows ``trigger`` within ``reach`` symbols of its clause."""
        step = []
        for s in range(reach + 1):
            row = []
            for symbol in range(N_SYMBOLS):
                after = 0 if symbol == END else reach if symbol == trigger else max(0, s - 1)
                row.append((after, rewrite.get(symbol, symbol) if s else symbol))
            step.append(row)
        return cls(step)

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this puts out goes into ``other``; only reachable pairs become states."""
        number, todo, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for symbol in range(N_SYMBOLS):
                a2, middle = self.step[a][symbol]
                b2, out = other.step[b][middle]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row.append((number[a2, b2], out))
            step.append(row)
        return Transducer(step)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, put = self.step[state][s]
            out.append(put)
        return out


def grammar() -> Transducer:
    deny = Transducer.window(NEGATION, {INSULT: INSULT_DENIED, THREAT: THREAT_DENIED}, 3)
    report = Transducer.window(REPORT, {INSULT: INSULT_REPORTED, THREAT: THREAT_REPORTED}, 10)
    aim = Transducer.window(TARGET, {INSULT: INSULT_AIMED}, 4)
    meet = Transducer.window(THREAT, {TARGET: THREAT_AIMED}, 3)
    return deny.then(report).then(aim).then(meet)


def _mask(width: int) -> np.uint64:
    """Keeps the first ``width`` bytes of a head."""
    return np.uint64((1 << (8 * width)) - 1)


def heads(words: Words) -> np.ndarray:
    """The first eight bytes of each word as a number, zeros behind a shorter one."""
    return words.eight(words.start, words.end - words.start)


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


class Grammar:
    """The stems, the composed transducer and the weights: what a worker needs.

    stems: {(width, head): weight}, and {(0, hash): weight} for whole words.
    """

    def __init__(self, stems: dict[tuple[int, int], float], weights: np.ndarray | None = None, bias: float = PRIOR_BIAS) -> None:
        self.stems = {w: np.sort(np.array([h for k, h in stems if k == w], dtype=np.uint64)) for w in (0, *WIDTHS)}
        self.strength = stems
        self.closed = [(c, np.sort(np.array([word_hash(w.encode()) for w in ws], dtype=np.uint64))) for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))]
        self.table = grammar()
        self.weights = np.array(list(KINDS.values())) if weights is None else weights
        self.bias = bias

    def insults(self, head: np.ndarray, whole: np.ndarray, size: np.ndarray) -> np.ndarray:
        found = _in(whole, self.stems[0])
        for w in WIDTHS:
            if len(self.stems[w]):
                found |= _in(head & _mask(w), self.stems[w]) & (size >= w)
        return found

    def _strength(self, head: int, whole: int, size: int) -> float:
        own = [self.strength[k] for k in [(0, whole), *[(w, head & int(_mask(w))) for w in WIDTHS if size >= w]] if k in self.strength]
        return max(own, default=1.0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """By text, the weighted numbers of matched clauses of each kind, as log(1 + x)."""
        words = Words(texts, ALNUM)
        out = np.zeros((len(texts), len(KINDS)))
        if not len(words):
            return out
        head, whole, size = heads(words), words.hashes(), words.end - words.start
        symbol = np.zeros(len(words), dtype=np.int8)
        for c, known in self.closed:
            symbol[_in(whole, known)] = c
        symbol[self.insults(head, whole, size)] = INSULT
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hits):
            return out
        ends = np.concatenate([[0], np.cumsum(BOUNDARY[words.raw])])
        gap = np.ones(len(words), dtype=bool)  # a clause begins here
        gap[1:] = (ends[words.start[1:]] != ends[words.end[:-1]]) | (words.row[1:] != words.row[:-1])
        clause = np.cumsum(gap) - 1
        starts = np.append(np.flatnonzero(gap), len(words))
        kinds = {k: i for i, k in enumerate(KINDS)}
        for c in np.unique(clause[hits]).tolist():
            a, b = int(starts[c]), int(starts[c + 1])
            best: dict[int, float] = {}
            for i, put in enumerate(self.table.run([*symbol[a:b].tolist(), END])):
                if put in kinds:
                    power = self._strength(int(head[a + i]), int(whole[a + i]), int(size[a + i])) if symbol[a + i] == INSULT else 1.0
                    best[put] = max(best.get(put, 0.0), power)
            for put, power in best.items():
                out[words.row[a], kinds[put]] += power
        return np.log1p(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights + self.bias, -30, 30)))


def _occurrences(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, hash of the word before, head) of the words that have a stem of this width (0: whole words)."""
    for a in range(0, len(texts), 256):
        words = Words(pa.array(texts[a : a + 256], pa.string()), ALNUM)
        head, whole, size = heads(words), words.hashes(), words.end - words.start
        before = np.concatenate([np.zeros(1, dtype=np.uint64), whole])[: len(head)]
        fits = size > 2 if width == 0 else size >= width
        yield words.row[fits] + a, (whole if width == 0 else head & _mask(width))[fits], before[fits], head[fits]


def _texts_by_key(texts: list[str], width: int, keys: np.ndarray) -> np.ndarray:
    """By key (sorted), the number of texts with it."""
    out = np.zeros(len(keys), dtype=np.int64)
    for row, key, _, _ in _occurrences(texts, width):
        known = _in(key, keys)
        both = np.unique(np.stack([row[known], np.searchsorted(keys, key[known])]), axis=1)
        out += np.bincount(both[1], minlength=len(keys))
    return out


def learn_stems(toxic: list[str], clean: list[str]) -> dict[tuple[int, int], float]:
    """Stems that stand in toxic texts, behind more different words than chance explains, and hardly in clean ones.

    Were a stem without meaning, each of its settings would be in a toxic text with the
    share of toxic texts in the sample as a chance; that all are must be less likely
    than 1 in 10 million. Copies of one passage are one setting. Of stems of which
    one begins with another, the shorter one is taken if it is as pure.
    """
    if not toxic or not clean:
        return {}
    n_pos, n_neg = len(toxic), len(clean)
    settings = max(3, int(np.ceil(np.log(1e7) / np.log((n_pos + n_neg) / n_pos))))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    head_of: dict[int, int] = {}
    for width in (*WIDTHS, 0):
        pairs = []
        for _, key, before, head in _occurrences(toxic, width):
            pairs.append(np.unique(np.stack([key, before]), axis=1))
            if width == 0:
                head_of.update(zip(key.tolist(), head.tolist(), strict=True))
        keys, n = np.unique(np.unique(np.concatenate(pairs, axis=1), axis=1)[0], return_counts=True)
        keys = keys[n >= settings]
        positives, negatives = _texts_by_key(toxic, width, keys), _texts_by_key(clean, width, keys)
        pure = (positives >= settings) & (negatives * n_pos <= 0.02 * positives * n_neg)
        found |= {(width, k): (p, q) for k, p, q in zip(keys[pure].tolist(), positives[pure].tolist(), negatives[pure].tolist(), strict=True)}
    head = lambda width, key, w: (key if width else head_of[key]) & int(_mask(w))
    spotless: dict[tuple[int, int], int] = {}  # texts with longer stems that no clean text has
    for (width, key), (p, q) in found.items():
        for w in WIDTHS:
            if q == 0 and w < (width or 9):
                spotless[w, head(width, key, w)] = max(p, spotless.get((w, head(width, key, w)), 0))
    chosen: dict[tuple[int, int], float] = {}
    for (width, key), (p, q) in found.items():
        longer_is_better = q > 0 and spotless.get((width, key), 0) >= 0.6 * p
        if not longer_is_better and not any((w, head(width, key, w)) in chosen for w in WIDTHS if w < (width or 9)):
            chosen[width, key] = float(np.log((p + 0.5) / (q + 0.5) * n_neg / n_pos))
    top = max(chosen.values(), default=1.0)
    return {k: max(0.3, v / top) for k, v in chosen.items()}


def fit(features: np.ndarray, toxic: np.ndarray, pull: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic weights and bias, pulled towards the fixed ones."""
    prior = np.array([*KINDS.values(), PRIOR_BIAS])
    x, w = np.hstack([features, np.ones((len(features), 1))]), prior.copy()
    strength = np.array([pull] * len(KINDS) + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Grammar:
    """From docs (doc_id, text) and labels (doc_id, toxic), on the bounded sample that the module names.

    The sample is drawn from the labels, so that only its documents' texts move.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Grammar({})
    steps = 1 << 24
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(steps, int(steps * sample_docs / n) + 1))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share[F.col("toxic")])
    usable = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_TEXT_BYTES))
    rows = usable.join(F.broadcast(sample), "doc_id").select("text", "toxic").collect()
    rows = sorted({(r["text"], r["toxic"]) for r in rows})
    texts, toxic = [t for t, _ in rows], np.array([y == 1 for _, y in rows])
    found = Grammar(learn_stems([t for t, y in rows if y == 1], [t for t, y in rows if y == 0]))
    if not rows:
        return found
    features = np.concatenate([found.features(pa.array(texts[a : a + 256], pa.string())) for a in range(0, len(texts), 256)])
    found.weights, found.bias = fit(features, toxic.astype(float))
    return found


def score(docs: DataFrame, grammar: Grammar, to: str = "score") -> DataFrame:
    """The columns of docs (with text), and the score."""
    out = docs.withColumn(to, F.lit(0.0))
    shared = share(docs.sparkSession, grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(to)
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                yield part.set_column(k, part.schema.field(k), pa.array(shared.value.score(part.column("text"))))

    return map_in_arrow(out, run, out.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = score(docs, found)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT_OFF).cast("int").alias("predicted"))
