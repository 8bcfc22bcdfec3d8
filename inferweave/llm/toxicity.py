"""Toxicity scoring of deobfuscated text.

Obfuscation is taken as a noisy channel: a writer meant letters and sent look-alike signs, repeated letters, separated
letters or masked ones, or all of these at once. What was meant is the best path through one lattice of the letters that
each run of a sign may stand for, under a character language model (trigrams of letters, counted over the whole corpus)
and the channel's costs: Viterbi decoding. Words without such signs have a single path and are left as they are, so only
the others are decoded; a worker remembers up to MEMO words.

Restored words are scored by a lexicon of words and word beginnings that are much more frequent in lines of documents
labelled toxic (log-likelihood ratio of at least EVIDENCE), and a logistic model turns a document's evidence into a
probability. The lexicon counts all labelled documents that aren't held out, and the language model all documents; the
logistic weights are fitted on about MAX_LABELLED labelled documents at most, taken by a hash of their ids.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from inferweave.llm.common import materialize, release_memory, rows_of, ship_package, table, worker_memo

#: Documents that the logistic weights are fitted on.
MAX_LABELLED = 200_000
#: Up to so many labelled ids are broadcast; above, they are joined with the texts by shuffle.
BROADCAST_IDS = 500_000
EVIDENCE = 24.0
PREFIXES = (4, 5, 6)
#: Hits of at least so much weight are also counted apart.
STRONG = 5.0
#: Numbers that a text's evidence has.
SIGNS = 5
MEMO = 150_000
#: Letters that a sign may stand for (fixed values). A star masks any letter.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of characters: boundary, a to z, each letter from ß to ÿ, any other letter.
LATIN, A = 0xDF, 61
#: Code points from here on all count as other letters.
TABLE = 0x3000
#: What a decoded letter earns, about what the language model charges for one: else the shortest reading would win.
BONUS = 2.0
TRAILING = re.compile(r"""(?:([%$#&*!?~=+])\1\1+|[.,;:!?"')\]}>»”’*%#&…-])+$""")
LEADING = re.compile(r"""^["'(\[{<«“‘*#%&¿¡-]+""")
SIGN = re.compile(r"[^\W\d_].*[^a-zA-ZÀ-ɏ]|[^a-zA-ZÀ-ɏ].*[^\W\d_]")
REPEATED = re.compile(r"(.)\1+", re.DOTALL)
DOUBLE, RUN = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")
#: Three or more letters, or signs that may stand for letters, each repeated or not, with separators between them.
ONE = r"[^\W_]|[@$!|+(€]"
SPACED = re.compile(rf"""(?<!\S)(?:(?:({ONE}|\*)\1*[ .\-_]{{1,2}}){{2,}}({ONE}|\*)\2*|(?:({ONE})\3*\*){{2,}}({ONE})\4*)(?![^\s.,;:?!"')\]}}])""")

#: What stands in every match of SPACED, found faster: its last two units.
SPACED_END = re.compile(rf"[ .\-_*]({ONE}|\*)\1*[ .\-_*]{{1,2}}({ONE}|\*)\2*(?![^\W_])")


def char_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if ord(c) >= TABLE:
        return A - 1
    return 0 if not c.isalpha() else 27 + ord(c) - LATIN if LATIN <= ord(c) <= 0xFF else A - 1


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point under TABLE, upper case as lower case, and then that of all others."""
    return np.array([char_class(chr(i).lower()[0]) for i in range(TABLE + 1)], np.int64)


def class_trigrams(texts: list[str]) -> np.ndarray:
    """Counts of the A^3 trigrams of character classes, with two boundaries around each text."""
    data = np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes()[np.minimum(data, TABLE)]
    return np.bincount((c[:-2] * A + c[1:-1]) * A + c[2:], minlength=A**3)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the A^3 trigrams of character classes over all texts; each task sends at most one row per trigram."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(A**3, np.int64)
        for (texts,) in rows_of(batches, "text"):
            for k in range(0, len(texts), 64):
                total += class_trigrams([t or "" for t in texts[k : k + 64]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    found = docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(A**3, np.int64)
    for gram, n in found.collect():  # at most A^3 rows
        out[gram] = n
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(class | two before), interpolated with the shorter contexts; Witten-Bell weights."""
    c3 = counts.reshape(A, A, A).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p = np.full(A, 1.0 / A)
    p1 = (c1 + A * p) / (c1.sum() + A)
    kinds = (c2 > 0).sum(axis=1, keepdims=True) + 1
    p2 = (c2 + kinds * p1) / (c2.sum(axis=1, keepdims=True) + kinds)
    kinds = (c3 > 0).sum(axis=2, keepdims=True) + 1
    p3 = (c3 + kinds * p2[None]) / (c3.sum(axis=2, keepdims=True) + kinds)
    return np.log(p3).astype(np.float32)


def channel_costs(meant: int, sent: int) -> float | None:
    """The log cost of sending a letter sent times that was meant once or twice; None: not possible."""
    return {(1, 1): 0.0, (2, 1): None, (1, 2): -4.0, (2, 2): 0.0}.get((meant, sent), -0.7)


def run_arcs(c: str, n: int, inside: bool) -> list[list[tuple[str, float]]]:
    """What n times the sign c may have meant, with the channel's log cost. inside: letters or signs stand on both sides."""
    one, two = channel_costs(1, n), channel_costs(2, n)
    if c.isalpha():
        meant, cost, drop = c, 0.0, None
    elif c == "*":
        drop = -4.0 if inside else -2.0
        return [[(x, BONUS - math.log(26.0)) for x in LETTERS] + [("", drop)]] * min(n, 2)
    elif c in LOOKALIKES:
        meant = LOOKALIKES[c]
        cost, drop = -0.2 - math.log(len(meant)), None if c.isdigit() else -6.0 if inside else -1.0 if n > 1 else -2.5
    else:
        return [[("", -0.2)]]
    arcs = [(x, one + cost + BONUS) for x in meant]
    if two is not None:
        arcs += [(x + x, two + cost + 2 * BONUS) for x in meant]
    return [arcs if drop is None else [*arcs, ("", drop)]]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of a sign: what may have been meant, with the channel's log cost."""
    out, i, word = [], 0, word.lower()
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        out += run_arcs(word[i], j - i, 0 < i and j < len(word))
        i = j
    return out


def spaced_lattice(units: list[str]) -> list[list[tuple[str, float]]]:
    """Runs of signs that were sent one by one: each like a run within a word, and a word may end after it."""
    out = []
    for u in units:
        *most, last = lattice(f"x{u}x")[1:-1]
        out += [*most, [*last, *((t + " ", cost - 1.5) for t, cost in last)]]
    return out


def units_of(spaced: re.Match) -> list[str]:
    return [u for u in re.split(r"[ .\-_]+" if spaced[3] is None else r"\*", spaced[0]) if u]


def decode(arcs: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The best path: Viterbi over states of two character classes. Ties go to the first in the order of arcs."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for step in arcs:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, said) in states.items():
            for text, cost in step:
                x, y, total = a, b, score + cost
                for c in text:
                    z = char_class(c)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, said + text)
        states = after
    return max(states.items(), key=lambda s: (s[1][0] + float(model[s[0][0], s[0][1], 0]), s[1][1]))[1][1].strip()


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return TRAILING.sub("", LEADING.sub("", token))


class Restorer:
    """The words that tokens and spaced letters mean."""

    def __init__(self, model: np.ndarray):
        self.model, self.flat, self.classes = model, model.reshape(-1).tolist(), classes().tolist()

    def undoubled(self, word: str) -> str:
        """decode(lattice(word)) for lower-case letters of which none stands three times in a row.

        Such a word's doubled letters are decided one by one: under a trigram model only the second letter of the two and
        the one after them depend on whether one or two were meant.
        """
        p, c = self.flat, [0, 0, *[self.classes[min(ord(x), TABLE)] for x in word], 0]
        single, double = channel_costs(1, 2), channel_costs(2, 2) + BONUS
        out, at = [], 0
        for m in DOUBLE.finditer(word):
            i = m.start() + 2  # the letter's place in c
            y, x, z = c[i - 1], c[i], c[i + 2]
            both = double + p[(y * A + x) * A + x] + p[(x * A + x) * A + z]
            if both <= single + p[(y * A + x) * A + z]:
                out.append(word[at : m.start() + 1])
                at = m.end()
        return "".join(out) + word[at:] if out else word

    def words(self, token: str) -> list[str]:
        """Lower-case words of a token: as it stands and, where its signs allow another reading, as decoded."""
        word = token.rstrip(".,;:!?")
        if not word.isalpha():  # most tokens are letters only, which core would leave as they are
            word = core(token)
        low = word.lower()
        if not low:
            return []
        if low.isalpha():
            if not DOUBLE.search(low):
                return [low]
            if not RUN.search(low):
                other = self.undoubled(low)
                return [low] if other == low else [low, *other.split()]
        inner = LEADING.sub("", token).rstrip(".,;:?\"')]}>")
        out = [low]
        for w in {word, inner}:
            if DOUBLE.search(w.lower()) or SIGN.search(w):
                out += decode(lattice(w), self.model).split()
        return list(dict.fromkeys(out))

    def join(self, spaced: re.Match) -> str:
        """What a match of SPACED means; runs of signs without a letter stay as they are."""
        return decode(spaced_lattice(units_of(spaced)), self.model) if any(c.isalpha() for c in spaced[0]) else spaced[0]

    def spaced(self, text: str) -> Iterator[str]:
        for m in SPACED.finditer(text):
            yield from self.join(m).split()

    def restore(self, text: str) -> str:
        """A text with every obfuscated span replaced by what was meant."""
        text = SPACED.sub(self.join, text)
        return re.sub(r"\S+", lambda m: self.words(m[0])[-1] if self.words(m[0])[1:] else m[0], text)


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Features(dict):
    """The features of tokens, remembered."""

    def __init__(self, model: np.ndarray):
        self.restorer = Restorer(model)

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= MEMO // 3:  # an entry has several strings
            self.clear()
        out = self[token] = tuple(f for w in self.restorer.words(token) for f in features(w))
        return out


def learn_lexicon(labelled: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Weights of features by labelled lines: labelled has text and toxic. Equal lines count once, so that copies weigh nothing more."""
    lines = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").select((F.col("toxic") > 0).alias("toxic"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.groupBy(F.xxhash64("line").alias("h")).agg(F.min("line").alias("line"), F.max("toxic").alias("toxic")).where("line != ''")
    lines = materialize(lines.select("line", "toxic"), "labelled-lines")

    def run(batches):
        import pyarrow as pa

        memo, seen = worker_memo(("features", model.tobytes()[:4096]), lambda: Features(model)), [Counter(), Counter()]

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["feature", "clean", "toxic"])

        for texts, toxic in rows_of(batches, "line", "toxic"):
            for t, y in zip(texts, toxic, strict=True):
                found = set().union(*map(memo.__getitem__, t.split()))
                if SPACED_END.search(t):
                    found.update(f for w in memo.restorer.spaced(t) for f in features(w))
                seen[bool(y)].update(found)
                if len(seen[0]) + len(seen[1]) > 100_000:
                    yield flush()
        yield flush()

    # lines, not features, are the units: totals of either class
    total = {bool(k): n for k, n in lines.groupBy("toxic").count().collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return {}
    counts = lines.mapInArrow(run, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    rate = (F.col("t") + F.col("c")) / F.lit(float(n0 + n1))
    part = lambda k, n: F.when(k > 0, k * F.log(k / (rate * F.lit(float(n))))).otherwise(F.lit(0.0))
    llr = 2 * (part(F.col("t"), n1) + part(F.col("c"), n0))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    strong = counts.where("t >= 3").select("feature", llr.alias("llr"), odds.alias("w")).where((F.col("llr") >= EVIDENCE) & (F.col("w") >= 1.5))
    return {r["feature"]: float(r["w"]) for r in strong.collect()}  # at most as many as there are words that tell the classes apart


class Scorer(dict):
    """Weights of tokens (0: none), remembered; evidence of texts.

    Most tokens are letters that begin as no feature of the lexicon does, and are known to weigh nothing without their
    readings: all readings of letters are these letters, some of them once more or less, so that without repetition
    they begin alike.
    """

    def __init__(self, model: np.ndarray, lexicon: dict[str, float]):
        self.restorer, self.lexicon = Restorer(model), lexicon
        roots = {REPEATED.sub(r"\1", f[1:])[:3] for f in lexicon}
        self.roots, self.short = {r for r in roots if len(r) == 3}, tuple(r for r in roots if len(r) < 3)
        self.before: dict[str, float] = {}

    def weightless(self, token: str) -> bool:
        """True only if no reading of the token has a weight; False if that isn't plain from its first three letters."""
        word = token.rstrip(".,;:!?")
        if not word.isalpha():
            return False
        low = word.lower()
        head = low[:3]
        return len(head) == 3 and head[0] != head[1] != head[2] and head not in self.roots and not head.startswith(self.short) and low.isalpha()

    def weight(self, word: str) -> float:
        get = self.lexicon.get
        return max([get("=" + word, 0.0), *(get("^" + word[:n], 0.0) for n in PREFIXES if len(word) >= n)])

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO // 2:  # what comes up again moves on to the new half
            self.before = dict(self)
            self.clear()
        out = self.before.get(token)
        if out is None:
            out = 0.0 if self.weightless(token) else max([0.0, *map(self.weight, self.restorer.words(token))])
        self[token] = out
        return out

    def evidence(self, text: str | None) -> tuple[float, ...]:
        """Number of hits, their mean and greatest weight, their share of the words, number of strong hits; scaled."""
        tokens = (text or "").split()
        hits = [w for w in map(self.__getitem__, tokens) if w]
        if text and SPACED_END.search(text):
            hits += [w for w in map(self.weight, self.restorer.spaced(text)) if w]
        n = len(hits)
        return math.log1p(n), (sum(hits) / n if n else 0.0), max(hits, default=0.0), math.log1p(100.0 * n / max(1, len(tokens))), math.log1p(sum(w >= STRONG for w in hits))


def worker_scorer(model: np.ndarray, lexicon: dict[str, float]) -> Scorer:
    """The scorer of this Python worker; what it remembers serves all tasks that the worker runs with this model."""
    key = ("scorer", model.tobytes()[:4096], hash(frozenset(lexicon.items())))
    return worker_memo(key, lambda: Scorer(model, lexicon))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the first of a constant) by Newton steps on the penalized likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * w * (np.arange(len(w)) > 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge * len(y) * (np.arange(len(w)) > 0) + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def evidence_of(docs: DataFrame, keep: list[str], model: np.ndarray, lexicon: dict[str, float], name: str) -> DataFrame:
    """The columns keep of docs (with text) and under name the SIGNS numbers of each text's evidence."""
    ship_package(docs.sparkSession)
    parts = docs.sparkSession.sparkContext.broadcast((model, lexicon))  # A^3 numbers, a bounded lexicon

    def run(batches):
        import pyarrow as pa

        scorer = worker_scorer(*parts.value)
        for batch in batches:
            (texts,) = next(rows_of([batch], "text"))
            found = pa.array([scorer.evidence(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, found], names=[*keep, name])
        release_memory()

    schema = StructType([*docs.select(*keep).schema.fields, StructField(name, ArrayType(DoubleType()))])
    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def free_name(taken: list[str]) -> str:
    """A column name that isn't taken, whatever the case."""
    name = "_evidence"
    while name in {c.lower() for c in taken}:
        name += "_"
    return name


def chance(evidence: Column, weights: np.ndarray) -> Column:
    """The logistic model's probability."""
    total = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        total = total + evidence[i] * F.lit(float(w))
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


class Toxicity:
    """A fitted scorer: language model, lexicon, logistic weights."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float], weights: np.ndarray):
        self.model, self.lexicon, self.weights = model, lexicon, weights

    def score(self, docs: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The columns keep of docs (with text) and the score (0 to 1) under name; of a clash, the score stays."""
        keep = [c for c in keep if c != name]
        found = free_name(keep)
        return evidence_of(docs, keep, self.model, self.lexicon, found).select(*keep, chance(F.col(found), self.weights).alias(name))


def held_out_rows(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of what may be learned from: one row per document that isn't held out, toxic if one label says so."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").where(~held_out_rows(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, dict[str, float], int, int]:
    """Language model, lexicon, and the numbers of labels and of toxic ones."""
    ship_package(docs.sparkSession)
    model = log_model(trigram_counts(docs))
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    labelled = docs.select("doc_id", "text").join(F.broadcast(known) if n <= BROADCAST_IDS else known, "doc_id")
    return model, learn_lexicon(labelled, model), n, n_toxic


def prior(n: int, n_toxic: int) -> np.ndarray:
    """Weights that give every text the share of toxic labels."""
    share = (n_toxic + 0.1) / (n + 1)
    return np.array([math.log(share / (1 - share))] + [0.0] * SIGNS)


def sample(known: DataFrame, n: int) -> DataFrame:
    """About MAX_LABELLED of n labels at most."""
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_LABELLED / n)) if n > MAX_LABELLED else known


def learn_weights(rows: DataFrame, name: str) -> np.ndarray:
    """The logistic weights by rows of evidence (under name) and toxic. Evidence is counted in hundredths."""
    names = [f"x{i}" for i in range(SIGNS)]
    rows = rows.select(*(F.round(F.col(name)[i], 2).alias(x) for i, x in enumerate(names)), (F.col("toxic") > 0).cast("bigint").alias("y"))
    seen = rows.groupBy(*names, "y").agg(F.count("*").alias("n"))
    data = np.array([tuple(r) for r in seen.orderBy(*names, "y").collect()], float).reshape(-1, SIGNS + 2)  # at most MAX_LABELLED rows
    times = data[:, -1].astype(int)
    return fit_logistic(np.repeat(data[:, :SIGNS], times, axis=0), np.repeat(data[:, SIGNS], times))


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """Fits on the documents (doc_id, text) that labels (doc_id, toxic) cover and that aren't held out.

    Rows without text, id or label teach nothing. A document that has several labels is toxic if one says so. Where no
    word tells the classes apart, as with labels of one kind or none, every text gets the share of toxic labels (counted
    with a tenth of one in one more), so above 0.5 if nearly all are.
    """
    known = known_labels(labels)
    model, lexicon, n, n_toxic = learn(docs, known)
    if not lexicon:
        return Toxicity(model, {}, prior(n, n_toxic))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(known, n)), "doc_id")  # about MAX_LABELLED ids at most
    return Toxicity(model, lexicon, learn_weights(evidence_of(rows, ["toxic"], model, lexicon, "_evidence"), "_evidence"))


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """fit(docs, labels).score(docs, keep, name) by one reading of the texts for both: their evidence is written.

    keep must hold doc_id, and name is no column of keep.
    """
    known, found = known_labels(labels), free_name(keep)
    model, lexicon, n, n_toxic = learn(docs, known)
    if not lexicon:
        return Toxicity(model, {}, prior(n, n_toxic)).score(docs, keep, name)
    rows = materialize(evidence_of(docs, keep, model, lexicon, found), "evidence")
    weights = learn_weights(rows.select("doc_id", found).join(F.broadcast(sample(known, n)), "doc_id"), found)
    return rows.select(*keep, chance(F.col(found), weights).alias(name))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all docs.

    Null and empty texts have no evidence and get the score of such texts. A null id is not held out. Repeated rows
    are scored alike; an empty table gives an empty table.
    """
    out = fit_and_score(docs, labels, ["doc_id"])
    held = F.coalesce(held_out_rows(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from the labels that aren't held out."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
