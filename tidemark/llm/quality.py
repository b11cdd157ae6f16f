"""Quality of documents from a linear-chain conditional random field over their lines.

Every line of a text is good or bad. What speaks for either are measures of the line and of the lines before and
after it; two transition weights say how readily a good or a bad line follows one of its kind. The chain is
fitted on a bounded sample of labelled documents, whose lines begin with the label of the document. Forward and backward
messages give each line's probability of being good, and the mean of these, weighted by the length of the lines, is
the quality of the text; a logistic curve fitted on the same sample turns it into a score.

Lines end at line feeds; blank lines are no lines. All measures are sums over bytes and words, so that a line of any length
is read whole, a piece at a time.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import held_out, text_batches, worker_state
from .toxicity import fit_linear

SAMPLE = 4_000             # labelled documents, about, that the chain is fitted on
LINES = 256                # lines of a sampled document, in a row, that it is fitted on
PIECE = 1 << 20            # bytes measured at once
RIDGE = 1.0                # penalty on weights of standardised measures
ROUNDS = 80                # steps of the optimiser at most
FAR = 5.0                  # standardised measures are cut here

# Byte classes.
LOWER, UPPER, DIGIT, BLANK, STOP, CRY, BAR, SYMBOL, HIGH = range(9)
_CLASS = np.full(256, SYMBOL, dtype=np.uint8)
_CLASS[0x80:] = HIGH
_CLASS[:33] = BLANK
for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b".,;:'\"-()", STOP), (b"!?", CRY), (b"|<>{}[]\\/=_", BAR)):
    _CLASS[list(chars)] = kind
_VOWEL = np.zeros(256, dtype=bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_LETTER = np.isin(_CLASS, (LOWER, UPPER, HIGH))
_DOUBLED = np.isin(_CLASS, (STOP, CRY, BAR, SYMBOL))

COUNTS = 9 + 11            # sums that are kept of a line
MEASURES = 22              # measures of a line
WIDTH = 3 + 3 * MEASURES   # constant, first, last; own, before, after


def _powers():
    """M^j and M^-j modulo 2^64 for every offset in a piece; M is odd, so it has an inverse."""
    m = 0x9E3779B97F4A7C15
    step = np.full(PIECE + 8, m, dtype=np.uint64)
    back = np.full(PIECE + 8, pow(m, -1, 1 << 64), dtype=np.uint64)
    step[0] = back[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(step), np.cumprod(back)


def _measured(parts, powers):
    """Sums for each of the given byte strings, together at most one piece long."""
    buf = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    lens = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    n, line = len(parts), np.repeat(np.arange(len(parts)), lens + 1)[:len(buf)]
    kind = _CLASS[buf]
    out = np.zeros((n, COUNTS))
    out[:, :9] = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9)
    out[:-1, BLANK] -= 1                                     # the line feed between two parts
    def count(rows):
        return np.bincount(rows, minlength=n)
    out[:, 9] = count(line[_VOWEL[buf]])
    same = np.zeros(len(buf), dtype=bool)
    same[1:] = (buf[1:] == buf[:-1]) & _DOUBLED[buf[1:]]
    out[:, 10] = count(line[same])
    solid = kind != BLANK
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    owner = line[begin]
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(buf * powers[0][:len(buf)], dtype=np.uint64)])
        h = (run[end] - run[begin]) * powers[1][begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    out[:, 11] = count(owner)                                # words
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out[:, 12] = count(owner[again])                         # words equal to the one before
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    out[:, 13] = count((keys[fresh] >> np.uint64(44)).astype(np.int64))
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    out[:, 14] = count(owner[letters[end] == letters[begin]])
    out[:, 15] = count(owner[kind[begin] == UPPER])
    out[:, 16] = count(owner[end - begin == 1])
    first, last = kind[np.minimum(starts, len(buf) - 1)], buf[np.maximum(starts + lens - 1, 0)]
    out[:, 17] = (first == UPPER) | (first == HIGH)
    out[:, 18] = first == LOWER
    out[:, 19] = np.isin(last, list(b".!?:\"'"))
    return out


def line_sums(texts):
    """(sums of every line, text of every line, whether an equal line came before in its text)."""
    powers = worker_state(("quality powers",), _powers)
    sums, doc, seen_before = [], [], []
    parts, place, held = [], [], 0

    def flush():
        nonlocal held
        if parts:
            got = _measured(parts, powers)
            at = np.array([p[0] for p in place])
            got[[not p[1] for p in place], 17:19] = 0        # only the first piece has the line's first byte
            got[[not p[2] for p in place], 19] = 0
            head = np.flatnonzero(np.diff(np.concatenate([[-1], at])))
            added = np.add.reduceat(got, head)
            if sums and sums[-1][0] == at[0]:
                sums[-1][1][-1] += added[0]
                added = added[1:]
            if len(added):
                sums.append([at[-1], added])
            elif sums:
                sums[-1][0] = at[-1]
        parts.clear(), place.clear()
        held = 0

    for i, text in enumerate(texts):
        seen = set()
        for s in (text or "").split("\n"):
            if not s or s.isspace():
                continue
            number = len(doc)
            doc.append(i)
            seen_before.append(s in seen)
            seen.add(s)
            raw = s.encode("utf-8", "surrogatepass")
            for a in range(0, len(raw), PIECE):
                part = raw[a:a + PIECE]
                if held + len(part) + 1 > PIECE:
                    flush()
                parts.append(part)
                place.append((number, a == 0, a + PIECE >= len(raw)))
                held += len(part) + 1
    flush()
    all_sums = np.concatenate([s[1] for s in sums]) if sums else np.zeros((0, COUNTS))
    return all_sums, np.array(doc, dtype=np.int64), np.array(seen_before, dtype=bool)


def measures(sums, doc, seen_before):
    """(measures of every line, length of every line in bytes)."""
    if not len(sums):
        return np.zeros((0, MEASURES)), np.zeros(0)
    size = sums[:, :9].sum(axis=1)
    letters = sums[:, LOWER] + sums[:, UPPER] + sums[:, HIGH]
    words = np.maximum(sums[:, 11], 1)
    near = np.zeros(len(sums), dtype=bool)
    near[1:] = seen_before[1:] & (doc[1:] == doc[:-1]) & (sums[1:] == sums[:-1]).all(axis=1)
    solid = np.maximum(size - sums[:, BLANK], 1)
    out = np.column_stack([
        np.log1p(size), np.log1p(sums[:, 11]), np.log1p(solid / words), sums[:, UPPER] / np.maximum(letters, 1), sums[:, DIGIT] / solid, sums[:, BLANK] / size,
        sums[:, STOP] / solid, np.sqrt(sums[:, CRY] / solid), np.sqrt(sums[:, SYMBOL] / solid), np.sqrt(sums[:, BAR] / solid), sums[:, HIGH] / solid,
        sums[:, 9] / np.maximum(letters, 1), np.sqrt(sums[:, 10] / solid), np.sqrt(sums[:, 12] / words), np.log(words / np.maximum(sums[:, 13], 1)),
        np.sqrt(sums[:, 14] / words), sums[:, 15] / words, sums[:, 16] / words, sums[:, 17], sums[:, 19], seen_before, near])
    return out, size


def evidence(own, doc, centre, spread):
    """The rows that the chain weighs: constant, ends of the text, the line's standardised measures and its neighbours'."""
    z = np.clip((own - centre) / spread, -FAR, FAR)
    same = doc[1:] == doc[:-1]
    x = np.zeros((len(z), WIDTH))
    x[:, 0] = 1
    if len(z):
        x[0, 1] = x[-1, 2] = 1
        x[1:, 1] = ~same
        x[:-1, 2] = ~same
        x[:, 3:3 + MEASURES] = z
        x[1:, 3 + MEASURES:3 + 2 * MEASURES] = z[:-1] * same[:, None]
        x[:-1, 3 + 2 * MEASURES:] = z[1:] * same[:, None]
    return x


class Chains:
    """Lines of many texts, in order, as chains that are walked side by side."""

    def __init__(self, doc):
        self.starts = np.flatnonzero(np.diff(np.concatenate([[-1], doc]))) if len(doc) else np.zeros(0, dtype=np.int64)
        self.lens = np.diff(np.concatenate([self.starts, [len(doc)]]))
        order = np.argsort(-self.lens, kind="stable")
        self.by_length, self.sorted_lens = self.starts[order], self.lens[order]
        self.alive = np.searchsorted(-self.sorted_lens, -np.arange(self.sorted_lens[0] if len(order) else 0), side="left")
        self.last = self.starts + self.lens - 1

    def messages(self, e, good, bad):
        """Log odds of good against bad that reach every line from before (its own included) and from after."""
        fore, back = e.copy(), np.zeros(len(e))
        for t in range(1, len(self.alive)):
            at = self.by_length[:self.alive[t]] + t
            x = fore[at - 1]
            fore[at] += np.logaddexp(x + good, 0) - np.logaddexp(x, bad)
        for t in range(len(self.alive) - 1, 0, -1):
            at = self.by_length[:self.alive[t]] + t
            x = e[at] + back[at]
            back[at - 1] = np.logaddexp(x + good, 0) - np.logaddexp(x, bad)
        return fore, back

    def loss(self, x, y, w):
        """Penalised negative log likelihood of the labels y and its gradient; the last two weights are the transitions."""
        e, good, bad = x @ w[:-2], w[-2], w[-1]
        fore, back = self.messages(e, good, bad)
        link = np.ones(len(e), dtype=bool)                   # lines that another line of the text follows
        link[self.last] = False
        a, b = np.flatnonzero(link), np.flatnonzero(link) + 1
        log_z = np.logaddexp(fore[a], bad).sum() + np.logaddexp(fore[self.last], 0).sum()
        both, none = (y[a] * y[b]).sum(), ((1 - y[a]) * (1 - y[b])).sum()
        ridge = np.full(len(w), RIDGE)
        ridge[0] = 1e-3
        value = log_z - y @ e - both * good - none * bad + 0.5 * (ridge * w * w).sum()
        p = 1 / (1 + np.exp(-np.clip(fore + back, -50, 50)))
        after = e[b] + back[b]
        parts = np.stack([fore[a] + good + after, np.full(len(a), bad), fore[a], after])
        total = np.logaddexp.reduce(parts, axis=0) if len(a) else np.zeros(0)
        slope = np.append(x.T @ (p - y), [np.exp(parts[0] - total).sum() - both, np.exp(parts[1] - total).sum() - none])
        return value, slope + ridge * w

    def quality(self, p, size):
        """Mean probability of being good over the bytes of each text."""
        return np.add.reduceat(p * size, self.starts) / np.add.reduceat(size, self.starts) if len(self.starts) else np.zeros(0)


def minimise(fn, w, rounds=ROUNDS, memory=8):
    """Limited-memory quasi-Newton steps with backtracking."""
    value, slope = fn(w)
    steps = []
    for _ in range(rounds):
        q, kept = slope.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            q -= a * d
            kept.append(a)
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        else:
            q /= max(1.0, np.abs(slope).max())
        for (s, d), a in zip(steps, reversed(kept)):
            q += s * (a - (d @ q) / (s @ d))
        pace = 1.0
        while True:
            new = w - pace * q
            new_value, new_slope = fn(new)
            if new_value <= value - 1e-4 * pace * (slope @ q) or pace < 1e-8:
                break
            pace /= 2
        if pace < 1e-8:
            break
        s, d = new - w, new_slope - slope
        if s @ d > 1e-12:
            steps = [*steps[-memory + 1:], (s, d)]
        gain, w, value, slope = value - new_value, new, new_value, new_slope
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return w


def fit(own, size, doc, label):
    """Model from lines: measures, lengths, the text of each (rising) and the label of its document.

    A bad document need not be bad in every line: lines of it that a first fit without transitions takes for good
    are relabelled, as long as most of the text stays bad.
    """
    centre, spread = own.mean(axis=0), np.maximum(own.std(axis=0), 1e-3)
    x, y, chains = evidence(own, doc, centre, spread), label.astype(float), Chains(doc)
    single = Chains(np.arange(len(doc)))
    w = minimise(lambda v: single.loss(x, y, v), np.zeros(WIDTH + 2))
    fine = (x @ w[:-2] > 1.5) & (y == 0)
    chain = np.repeat(np.arange(len(chains.starts)), chains.lens)
    share = np.bincount(chain, fine * size, len(chains.starts)) / np.bincount(chain, size, len(chains.starts))
    y[fine & (share[chain] < 0.5)] = 1.0
    w[-2:] = 1.0
    w = minimise(lambda v: chains.loss(x, y, v), w)
    fore, back = chains.messages(x @ w[:-2], w[-2], w[-1])
    q = chains.quality(1 / (1 + np.exp(-np.clip(fore + back, -50, 50))), size)
    curve = fit_linear(np.column_stack([np.ones(len(q)), q - 0.5]), label[chains.starts].astype(float), penalty=0.1)
    return centre, spread, w, curve


def line_marginals(texts, model):
    """(probability of being good, length, text) of every line of the texts."""
    centre, spread, w, _ = model
    sums, doc, seen = line_sums(texts)
    own, size = measures(sums, doc, seen)
    chains = Chains(doc)
    fore, back = chains.messages(evidence(own, doc, centre, spread) @ w[:-2], w[-2], w[-1])
    return 1 / (1 + np.exp(-np.clip(fore + back, -50, 50))), size, doc


def qualities(texts, model):
    """Score of every text; one without a line has quality 0."""
    if model[2] is None:                                     # labels of one class at most: their share, for all
        return np.full(len(texts), model[3])
    q = np.zeros(len(texts))
    p, size, doc = line_marginals(texts, model)
    chains = Chains(doc)
    q[doc[chains.starts]] = chains.quality(p, size)
    a, b = model[3]
    return 1 / (1 + np.exp(-np.clip(a + b * (q - 0.5), -50, 50)))


def _sampled_lines(frames):
    for df in frames:
        texts = df["text"].tolist()
        sums, doc, seen = line_sums(texts)
        own, size = measures(sums, doc, seen)
        chains = Chains(doc)
        # A run of LINES lines, at a place that the text's length decides.
        from_line = (np.maximum(chains.lens - LINES, 0) * (chains.lens * 2654435761 % 1000) / 1000).astype(np.int64)
        take = np.concatenate([np.arange(s + f, s + min(n, f + LINES)) for s, f, n in zip(chains.starts, from_line, chains.lens)] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        ids, label = df["id"].to_numpy(), df["label"].to_numpy()
        yield pd.DataFrame({"id": ids[doc[take]], "line": take, "label": label[doc[take]], "size": size[take],
                            "own": [r.astype("float32").tobytes() for r in own[take]]})


def train(docs, labels, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE, folds=3, left_out=1):
    """Model fitted on about `sample` labelled documents outside the held-out fold, chosen by hash of the id.

    Null ids, labels and texts teach nothing. Of an id's several labels the mean decides, one half being good. A document is
    represented by at most LINES lines in a row. Labels of one class only, or none, give their smoothed share to every text.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL AND NOT isnan(label)")
    known = known.where(~held_out(F.col("id"), folds, left_out)).groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")     # about `sample` rows are broadcast
    got = text_batches(rows).mapInPandas(_sampled_lines, "id long, line long, label int, size double, own binary").toPandas()
    if got["label"].nunique() < 2:
        good = float(got.drop_duplicates("id")["label"].sum())
        return None, None, None, (good + 1) / (got["id"].nunique() + 2)
    own = np.frombuffer(b"".join(got["own"]), dtype="float32").reshape(-1, MEASURES).astype(float)
    # Rows of a document come in order of its lines; a repeated id or a new batch begins a chain of its own.
    follows = (got["id"].to_numpy()[1:] == got["id"].to_numpy()[:-1]) & (got["line"].to_numpy()[1:] == got["line"].to_numpy()[:-1] + 1)
    chain = np.concatenate([[0], np.cumsum(~follows)])
    return fit(own, got["size"].to_numpy(), chain, got["label"].to_numpy())


def score(docs, model, text_col="text", score_out="score"):
    """docs with a quality score from 0 to 1 of the whole text, higher for likelier good.

    Null, empty and blank texts have no line and get the score of quality 0. Repeated rows score alike, an empty table gives
    no row. A column of docs named like the output is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(qualities(texts.tolist(), shared.value))

    return text_batches(docs).withColumn(score_out, quality(docs[text_col].cast("string")))
