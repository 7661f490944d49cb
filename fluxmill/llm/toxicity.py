"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reported speech), quotation
marks a class of their own.  Small transducers are composed into one machine that
runs over a clause from left to right and a second that runs back from right to
left; together (a bimachine) they mark every insult and threat with what governs
it on either side: a negation, a word of saying, somebody aimed at.  Weights
multiply along a path: a form's weight is its class's times the factor of each
mark, so an insult that is negated or quoted always counts less than the same
insult that isn't, and a threat hardly counts without somebody threatened.  A
document's score is a logistic function of the forms' weights times the logarithm
of how often each occurs.

Insults, slurs and threats are learned from labels, in a bounded sample of labelled
rows: word beginnings whose share of toxic documents is significant wherever they
occur (insults, class I), only where a document has them more than once (slurs,
class J, which clean texts hold by chance), or only where their clause has a target
(threats, class H); and the weights with them.  No insult is fixed; the closed
classes and a few verbs of threat are.

Words are compared in lower case, composed (NFC) and without apostrophes, so "isn't"
is ``isnt``; elided articles ("l'idiot") stand apart.

Null and empty texts and texts without a marked form get the score of an empty
text, which is below one half; a score of exactly one half counts as toxic; long
texts are scanned whole, clause by clause; a document whose labels disagree counts
as toxic; without labels nothing is an insult and the weights are the grammar's
own; repeated rows get equal scores, and rows that repeat an id teach once; an
empty table gives an empty result; extra columns are dropped unless kept.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import kept, stash
from fluxmill.llm.langid import held_out

SAMPLE_DOCS = 12_000  # labelled documents, a quarter of them toxic where there are enough
SAMPLE_CHARS = 64_000_000  # characters of them in all; in the order of a hash, documents that would pass it are left out
SIGNIFICANT = 20.0  # log-likelihood ratio that a learned stem must reach beyond what trying so many stems gives by chance
PRECISE = {"I": 0.9, "J": 0.75, "H": 0.9}  # least share of a stem's witnesses that are toxic; repetition is weighed by how often
LEAST = 4  # fewest witnesses of a stem
SHARED = 1.3  # how many times the witnesses of its best ending a repeated stem must have to stand for all of them
STEM = (4, 10)  # letters of a learned stem
SCOPE = 3  # words that a negation reaches

# The closed classes, without apostrophes, in several languages; and verbs of threat.
TARGETS = "you your youre yours he she they him her them this these those hes shes theyre du dich dir ihr euch sie ihn tu t te toi vous il elle ils elles lui eux tú usted ustedes ti os él ella ellos ellas".split()
NEGATIONS = "not never no nor neither isnt arent wasnt werent dont doesnt didnt aint wont cant nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás jamas tampoco".split()
REPORTS = "said says saying say called calls quote quoted quotes wrote writes told tells shouted claimed sagte sagt schrieb nannte rief dit disait appelé appela écrit écrivait dijo dice escribió escribio llamó llamo".split()
THREATS = "kill hurt murder destroy strangle stab shoot töten toeten umbringen tuer matar".split()
# Weights of the classes before fitting, the bias, and the factor of each mark (a threat's without a target).
BIAS, BASE = -3.5, {"I": 5.0, "J": 2.0, "H": 5.0}
MARKS = {"~": 0.15, '"': 0.4, ">": 1.2}
UNAIMED = 0.1
QUOTES = '"“”„«»'
KINDS = "IJH"

_APOSTROPHES = "'’ʼ`´"
_ELIDED = re.compile(rf"\b(l|d|j|n|s|c|t|m|qu)[{_APOSTROPHES}](?=\w)")
_INNER = re.compile(rf"(?<=\w)[{_APOSTROPHES}](?=\w)")
_SYMBOL = re.compile(rf"[^\W\d_]+|[{QUOTES}]")
_ENDS = ".!?;\n"
_CLAUSE = re.compile(r"[.!?;\n]")


def lower(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low)


def symbols(clause: str) -> list[str]:
    """Words and quotation marks of lower-case text; apostrophes join what they stand between, but for elided articles."""
    if not clause.isascii() or "'" in clause or "`" in clause:
        clause = _INNER.sub("", _ELIDED.sub(r"\1 ", clause))
    return _SYMBOL.findall(clause)


class Machine:
    """A deterministic transducer: (state, symbol) to (state, output); symbols it doesn't know pass unchanged."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, after: Machine) -> Machine:
        """Composition: this machine's output is the input of ``after``."""

        def step(state, symbol):
            first, middle = self.step(state[0], symbol)
            second, out = after.step(state[1], middle)
            return (first, second), out

        return Machine((self.start, after.start), step)

    def run(self, given: Sequence[str]) -> list[str]:
        state, made = self.start, []
        for s in given:
            state, out = self.step(state, s)
            made.append(out)
        return made


def _mark(symbol: str, mark: str, when) -> str:
    return symbol + mark if when and symbol[0] in KINDS and mark not in symbol else symbol


def negation() -> Machine:
    """Marks forms within SCOPE words after a negation; the state is how far its scope still goes."""
    return Machine(0, lambda left, s: (SCOPE, s) if s == "N" else (left if s == "Q" else max(left - 1, 0), _mark(s, "~", left)))


def reported() -> Machine:
    """Marks forms after a word of saying, to the clause's end."""
    return Machine(False, lambda on, s: (on or s == "R", _mark(s, '"', on)))


def quoted_before() -> Machine:
    """Read backwards: marks forms in quotation marks that a word of saying follows ("...", she said)."""
    def step(state, s):
        said, inside = state
        if s == "R":
            return (True, inside), s
        if s == "Q":
            return (said, said and not inside), s
        return state, _mark(s, '"', inside)

    return Machine((False, False), step)


def targeted() -> Machine:
    """Marks forms after a target, to the clause's end; read backwards, those before one."""
    return Machine(False, lambda on, s: (on or s == "T", _mark(s, ">", on)))


FORWARD = negation() @ reported() @ targeted()
BACKWARD = quoted_before() @ targeted()
FORMS = [base + a + b + c for base in KINDS for a in ("", "~") for b in ("", '"') for c in ("", ">")]


def marked(classes: Sequence[str]) -> list[str]:
    """The clause's symbols, insults and threats with their marks in one order."""
    made = BACKWARD.run(FORWARD.run(classes)[::-1])[::-1]
    return [s[0] + "".join(m for m in '~">' if m in s) for s in made]


def factors() -> np.ndarray:
    """The product of each form's marks."""
    return np.array([math.prod(MARKS[m] for m in f[1:]) * (UNAIMED if f[0] == "H" and ">" not in f else 1.0) for f in FORMS])


def prior() -> np.ndarray:
    """Weight of each form by the grammar alone, the bias last."""
    return np.r_[factors() * [BASE[f[0]] for f in FORMS], BIAS]


class Scorer:
    """Counts marked forms of a text and weighs them."""

    def __init__(self, insults: Sequence[str], slurs: Sequence[str], threats: Sequence[str], weights: Sequence[float]):
        self.weights = np.asarray(weights, float)
        self.place = {f: k for k, f in enumerate(FORMS)}
        self.plain = {w: c for words, c in ((TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R"), (QUOTES, "Q")) for w in words}
        stems = {**dict.fromkeys(THREATS, "H"), **dict.fromkeys(threats, "H"), **dict.fromkeys(slurs, "J"), **dict.fromkeys(insults, "I")}
        self.whole = frozenset(THREATS) - {*threats, *slurs, *insults}  # fixed verbs match as whole words, learned stems as beginnings
        self.trigger = ahocorasick.Automaton()
        for s in stems:
            self.trigger.add_word(s, len(s))
        self.trigger.make_automaton()
        pick = lambda kind: re.compile("|".join(sorted(re.escape(s) for s, c in stems.items() if c == kind and s not in self.whole)) or r"(?!)")
        self.insult, self.slur, self.threat = map(pick, KINDS)
        self.calm = self.weigh(np.zeros(len(FORMS)))

    def classify(self, word: str) -> str:
        if word in self.plain:
            return self.plain[word]
        return "I" if self.insult.match(word) else "J" if self.slur.match(word) else "H" if word in self.whole or self.threat.match(word) else "O"

    def counts(self, text: str | None) -> np.ndarray | None:
        """Occurrences of each form, or None where no clause holds a trigger."""
        if not text or not len(self.trigger):
            return None
        low, out, done = lower(text), None, -1
        for end, n in self.trigger.iter(low):
            start = end + 1 - n
            if start < done or start and low[start - 1].isalpha():
                continue
            first = max(low.rfind(c, max(done, 0), start) for c in _ENDS) + 1  # no clause is looked through twice
            stop = _CLAUSE.search(low, end + 1)
            done = stop.start() if stop else len(low)
            if out is None:
                out = np.zeros(len(FORMS))
            for form in marked([self.classify(w) for w in symbols(low[first:done])]):
                k = self.place.get(form)
                if k is not None:
                    out[k] += 1
        return out

    def weigh(self, counts: np.ndarray) -> float:
        z = float(np.log2(1 + counts) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None) -> float:
        counts = self.counts(text)
        return self.calm if counts is None else self.weigh(counts)


def _surprise(k: float, n: float, rate: float) -> float:
    """Log-likelihood ratio of k toxic among n witnesses against the overall rate."""
    p = k / n
    if p <= rate:
        return 0.0
    return 2 * (k * math.log(p / rate) + ((n - k) * math.log((1 - p) / (1 - rate)) if k < n else 0.0))


def _beginnings(word: str) -> Iterator[str]:
    return (word[:n] for n in range(STEM[0], min(len(word), STEM[1]) + 1))


class _Witnesses:
    """Contexts and documents of a stem; its witnesses are as many as the fewer of both."""

    __slots__ = ("contexts", "documents")

    def __init__(self):
        self.contexts, self.documents = set(), set()

    def __len__(self) -> int:
        return min(len(self.contexts), len(self.documents))


def learn_stems(texts: Sequence[str], toxic: Sequence[int], clean_weight: float = 1.0) -> tuple[list[str], list[str], list[str]]:
    """Word beginnings that mark toxic documents: insults (anywhere), slurs (more than once), threats (with a target in their clause).

    Documents that hold a beginning propose it; its witnesses decide.  A context is
    the pair of words around an occurrence: copies of one document have the same
    contexts, however many they are, and a word that one document repeats has one
    document, so both are one witness.  ``clean_weight`` is how many clean documents
    each clean one of the sample stands for.
    """
    targets = frozenset(TARGETS)

    def clauses(side: bool) -> Iterator[tuple[int, list[list[str]]]]:
        for k, (t, label) in enumerate(zip(texts, toxic)):
            if bool(label) == side:
                yield k, [symbols(c) for c in _CLAUSE.split(lower(t))]

    def held(found: list[list[str]]) -> set[tuple[str, str]]:
        out, seen = set(), set()
        for c in found:
            aimed = not targets.isdisjoint(c)
            for w in c:
                for s in _beginnings(w):
                    if s in seen:
                        out.add((s, "J"))
                    seen.add(s)
                    if aimed:
                        out.add((s, "H"))
        out.update((s, "I") for s in seen)
        return out

    bad: Counter = Counter()
    for _, found in clauses(True):
        bad.update(held(found))
    bad = Counter({s: k for s, k in bad.items() if k >= LEAST})  # few are left, and only these are looked for elsewhere
    good: Counter = Counter()
    for _, found in clauses(False):
        good.update(held(found) & bad.keys())
    proposed = {s for s, k in bad.items() if k >= PRECISE[s[1]] * (k + clean_weight * good[s])}
    stems = {s for s, _ in proposed}
    around = {s: (_Witnesses(), _Witnesses()) for s in proposed}
    for label in (True, False):
        for number, found in clauses(label):
            before: dict[str, tuple[str, str]] = {}  # each stem's first context in the document
            for c in found:
                aimed = not targets.isdisjoint(c)
                for k, w in enumerate(c):
                    for s in _beginnings(w):
                        if s not in stems:
                            continue
                        here = (c[k - 1] if k else "", c[k + 1] if k + 1 < len(c) else "")
                        first = before.setdefault(s, here)
                        for kind, context in (("I", here), ("H", here if aimed else None), ("J", (*first, *here) if first != here else None)):
                            if context is not None and (s, kind) in proposed:
                                to = around[s, kind][0 if label else 1]
                                to.contexts.add(context)
                                to.documents.add(number)
    n_bad = sum(map(bool, toxic))
    rate = n_bad / max(n_bad + clean_weight * (len(toxic) - n_bad), 1)
    strong: dict[str, list[tuple[int, int, str]]] = {k: [] for k in KINDS}
    for (s, kind), (a, b) in around.items():
        k, n = len(a), len(a) + clean_weight * len(b)
        if k >= LEAST and k >= PRECISE[kind] * n and _surprise(k, n, rate) >= SIGNIFICANT + 2 * math.log(max(len(proposed), 1)):
            strong[kind].append((k, len(s), s))
    # a stem that marks by repetition takes its endings, each of which marks by itself only because it is rarer
    everywhere = {s: k for k, _, s in strong["I"]}
    repeated = [x for x in strong["J"] if not any(x[2].startswith(i) for i in everywhere)]
    slurs = _shortest([x for x in repeated if x[0] >= SHARED * max((k for i, k in everywhere.items() if i.startswith(x[2])), default=0)])
    insults = [s for s in _shortest(strong["I"]) if not any(s.startswith(j) for j in slurs)]
    others = [*insults, *slurs]
    threats = [s for s in _shortest(strong["H"]) if not any(s.startswith(i) or i.startswith(s) for i in others)]
    return insults, slurs, threats


def _shortest(strong: list[tuple[int, int, str]]) -> list[str]:
    """Of stems that begin with one another, the shortest that has noticeably more witnesses."""
    chosen: dict[str, int] = {}
    for k, _, s in sorted(strong, key=lambda x: (-x[0], -x[1], x[2])):
        longer = [c for c in chosen if c.startswith(s)]
        if any(s.startswith(c) for c in chosen) or longer and k < 1.15 * max(chosen[c] for c in longer):
            continue
        for c in longer:
            del chosen[c]
        chosen[s] = k
    return sorted(chosen)


def _newton(x: np.ndarray, labels: np.ndarray, start: np.ndarray, spread: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights with a normal prior around ``start``."""
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (labels - p) - (w - start) / spread**2
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(1 / spread**2)
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit_weights(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The classes' weights and the bias first, with the marks' factors as they are; then each form's own, near that product.

    A form that is negated or quoted never passes the same form without the mark.
    """
    x, f = np.log2(1 + features), factors()
    kinds = [np.array([form[0] == base for form in FORMS]) for base in KINDS]
    whole = np.c_[*[x @ (f * k) for k in kinds], np.ones(len(x))]
    base = _newton(whole, labels, np.array([*(BASE[k] for k in KINDS), BIAS]), np.full(len(KINDS) + 1, 1.5))
    for k, seen in enumerate(whole[:, :-1].any(0)):  # a class the sample doesn't hold stands to the insults as before fitting
        if not seen:
            base[k] = base[0] * BASE[KINDS[k]] / BASE["I"] if whole[:, 0].any() else BASE[KINDS[k]]
    start = np.r_[f * sum(np.maximum(b, 0.0) * k for b, k in zip(base, kinds)), base[-1]]
    w = _newton(np.c_[x, np.ones(len(x))], labels, start, np.full(len(start), 0.5))
    place = {form: k for k, form in enumerate(FORMS)}
    for form in FORMS:  # fewer marks come first
        for m in '~"':
            if m in form:
                w[place[form]] = min(w[place[form]], max(w[place[form.replace(m, "")]], 0.0))
    w[-1] = min(w[-1], -0.5)  # a text without any form stays below one half
    return w


Model = tuple[list[str], list[str], list[str], list[float]]


def train(texts: Sequence[str], toxic: Sequence[int], clean_weight: float = 1.0) -> Model:
    """Insults, slurs, threats and weights."""
    stems = learn_stems(texts, toxic, clean_weight)
    draft = Scorer(*stems, prior())
    rows = [draft.counts(t) for t in texts]
    features = np.array([np.zeros(len(FORMS)) if r is None else r for r in rows]).reshape(-1, len(FORMS))
    return *stems, fit_weights(features, np.array(toxic, float)).tolist()


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", only: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model, from about ``sample_docs`` labelled documents, a quarter of them toxic where there are enough.

    Labels are aggregated by document and class; a hash threshold per class picks
    the sample's ids, a bounded set that is broadcast to the one scan of the
    documents.  Of rows that repeat an id the least text is taken, and texts only
    reach the driver while their lengths, known before, stay within ``sample_chars``.
    """
    rows = labels.where(only if only is not None else ~held_out(F.col(ident))).where("toxic IS NOT NULL").select(F.col(ident).alias("i"), (F.col("toxic") != 0).cast("int").alias("l")).groupBy("i").agg(F.max("l").alias("l"))
    place = F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1 << 30))
    counts = {r[0]: r[1] for r in rows.groupBy("l").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return [], [], [], prior().tolist()
    share = {k: int(min(1.0, sample_docs * (0.25 if k else 0.75) / n) * (1 << 30)) for k, n in counts.items()}
    picked = rows.where(place < F.when(F.col("l") == 1, share.get(1, 0)).otherwise(share.get(0, 0)))
    found = documents.select(F.col(ident).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").join(F.broadcast(picked), "i")
    found = stash(found.groupBy("i", "l").agg(F.min("t").alias("t")).withColumn("p", place), "toxicity-sample")
    total, kept = 0, []
    for r in found.select("p", "i", F.length("t").alias("n")).orderBy("p", "i").collect():
        if total + r["n"] <= sample_chars:
            total += r["n"]
            kept.append(r["p"])
    pairs = sorted((r["t"], r["l"]) for r in found.join(F.broadcast(documents.sparkSession.createDataFrame([(p,) for p in kept], "p bigint")), "p", "left_semi").select("t", "l").collect())
    weight = share.get(1, 1) / max(share.get(0, 1), 1)
    return train([p[0] for p in pairs], [p[1] for p in pairs], weight)


def _scorer(model: Model) -> Scorer:
    return kept("toxicity" + hashlib.sha256(repr(model).encode()).hexdigest(), lambda: Scorer(*model))


def score(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), output: str = "toxicity") -> DataFrame:
    """``keep`` plus ``output``, the toxicity from 0 to 1; narrow, one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand stems at most
    names = list(keep)
    others = [n for n in names if n != text]
    source = df.select(*others, df[text].alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for b in batches:
            texts = b.column(len(others))
            values = pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*(texts if n == text else b.column(others.index(n)) for n in names), values], [*names, output])

    return source.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"`{output}` double"]))
