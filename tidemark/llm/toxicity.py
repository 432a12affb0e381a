"""Toxicity: a learnt lexicon, matched with misspellings, weighed by context.

The lexicon holds words and stems that mark toxic training documents: those of
high odds that stand in more toxic documents than chance puts there, by binomial
tails and the Benjamini-Hochberg step over all of them, so that the documents a
term needs follow from the labelled rows. A word counts where it stands at all, a
stem (the first STEM letters or more of a word) where it begins at least one word
in DENSE; of a stem and what it covers the more significant one is kept. With
`copies_once` near copies among the labelled rows, told by the least hashes of their
runs of RUN words, are learnt from once, so that the words of a text copied often
aren't taken for terms.

The words are a trie. A word of a text is matched by the Levenshtein automaton
intersected with it, whose states are trie nodes with the edits spent: one at most
for terms of SHORT letters or more, two for those of LONG, none for shorter ones.
Stems are matched as they are. A word masked by signs ("stup!d", "id*ot", "$cum")
is read beside its parts, with signs and digits folded to letters or spent as
edits. A hit weighs the term's log odds, for exact and misspelled hits apart, so
that a term whose neighbours are ordinary words weighs little when misspelled.

Context: a hit inside a quotation (a span from an opening to a closing mark on one
line) or near a word that reports speech is scaled down, one near an address in the
second person up, by the factors QUOTED and ADDRESSED; the strongest hit of each of
these contexts is a feature of its own beside, so that the regression moves the
factors where the labelled rows say so and leaves them where they are silent. The
logistic regression sees these, the strongest hit, the number of different words
hit and the hits' weight per hundred words.

Edge cases: a null or empty text has no hit and the score of none; without
labelled rows of both classes the score is the intercept's; of rows with one id
the least text is learnt from; null labels and ids are not; an empty table gives
an empty one; other columns pass through or are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.llm.common import Workspace, lean, mix64, shingle_sets, small_batches

#: Labelled rows at most, those of least id hash.
MAX_ROWS = 20_000
#: Least log odds of a term, and the share of the lexicon that chance may put there.
MIN_ODDS, FALSE_SHARE = 3.5, 0.1
#: Letters of a stem at least, the words of which one begins with it, and the least log odds of a stem.
STEM, DENSE, STEM_ODDS = 4, 100, 3.0
#: Words in a run by which near copies are known, and the number of least hashes.
RUN, SIGNATURES = 4, 3
SHORT, LONG = 4, 9
CONTEXT = 6
QUOTED, ADDRESSED = 0.4, 1.2
WEAK = 2.0
#: Words remembered by a task at most, with what they match.
TABLE_WORDS = 200_000
#: Transitions of the automaton kept at most.
MAX_STEPS = 100_000
#: Fixed word lists: reports of speech, address in the second person, in the corpus's four languages.
REPORTS = frozenset("said says say wrote writes called calls quote quoted quotes word term phrase dit disait mot terme sagte sagt schrieb wort begriff dijo dice palabra".split())
ADDRESS = frozenset("you your youre u tu toi vous votre du dich dir ihr usted ustedes eres".split())
#: Quotations on one line, from an opening mark to the next closing one.
_QUOTATION = re.compile(r"""“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|"[^"\n]*"|(?<!\w)['‘`](?=\S)[^'‘’`\n]*['’`](?!\w)""")
#: Digits and signs read as letters inside a word; other signs there are spent as edits.
FOLD = str.maketrans("0123456789!@$+|€", "oizeasgtbgiastie")
_TOKEN = re.compile(r"\w+")
#: A word with signs inside, or with a sign that reads as a letter at an end.
_MASKED = re.compile(r"[@$€]?\w+(?:[!@$€+|*#%&?^~=.\-]{1,3}\w+)*[@$€+|]?")
#: Longer runs without white space are read anew each time.
CACHED_CHARS = 64


def fold(word: str) -> str:
    return word if word.isalpha() else word.translate(FOLD)


def masked(raw: str) -> list[str]:
    """Words of a run without white space that have signs in them."""
    return [] if raw.isalnum() else [w for w in _MASKED.findall(raw) if not _TOKEN.fullmatch(w)]


def allowed(term: str) -> int:
    """The edits that a term's misspellings may hold."""
    return 2 if len(term) >= LONG else 1 if len(term) >= SHORT else 0


class Lexicon:
    """A trie of terms, and the automaton of all words within some edits of one.

    A state of the automaton is a set of (trie node, edits spent): the
    Levenshtein automaton intersected with the trie, determinized while words
    are read. Most words reach the empty state after a few letters.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = term
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str, int], int] = {}
        self.starts = [self.number(self.closed({0: 0}, limit)) for limit in range(3)]

    def closed(self, reach: dict[int, int], limit: int) -> tuple[tuple[int, int], ...]:
        """Adds the nodes reached by leaving out letters of a term."""
        todo = list(reach.items())
        while todo:
            node, spent = todo.pop()
            if spent < limit and reach[node] == spent:
                for child in self.children[node].values():
                    if reach.get(child, limit + 1) > spent + 1:
                        reach[child] = spent + 1
                        todo.append((child, spent + 1))
        return tuple(sorted(reach.items()))

    def number(self, state: tuple[tuple[int, int], ...]) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def step(self, state: int, c: str, limit: int) -> int:
        reach: dict[int, int] = {}

        def offer(node: int, spent: int) -> None:
            if spent <= limit and reach.get(node, limit + 1) > spent:
                reach[node] = spent

        for node, spent in self.states[state]:
            offer(node, spent + 1)  # a letter too many
            for letter, child in self.children[node].items():
                offer(child, spent + (letter != c))
        found = self.steps[state, c, limit] = self.number(self.closed(reach, limit))
        return found

    def matches(self, word: str) -> list[tuple[str, int]]:
        """Terms within the limit of edits of the word's length, with their distances."""
        n = len(word)
        return self.within(word, 0 if n <= SHORT else 2 if n >= LONG else 1)

    def within(self, word: str, limit: int) -> list[tuple[str, int]]:
        if len(self.steps) > MAX_STEPS:
            self.reset()
        state, steps = self.starts[limit], self.steps
        for c in word:
            nxt = steps.get((state, c, limit))
            state = self.step(state, c, limit) if nxt is None else nxt
            if state < 0:
                return []
        return [(t, d) for node, d in self.states[state] if (t := self.term[node]) is not None]


class Misspellings:
    """Terms by the edits they may hold: an automaton for one edit and one for two, so that long words and long terms only meet the larger one."""

    def __init__(self, terms: list[str], exact: list[str]):
        """`exact`: terms whose misspellings weigh nothing."""
        self.exact = frozenset(exact) | {t for t in terms if not allowed(t)}
        self.one, self.two = (Lexicon([t for t in terms if allowed(t) == k]) for k in (1, 2))

    def matches(self, word: str) -> list[tuple[str, int]]:
        """Terms within their own limits of edits, with their distances."""
        n = len(word)
        found = [(word, 0)] if word in self.exact else []
        if SHORT - 1 <= n <= LONG:
            found += self.one.within(word, 1)
        if n >= LONG - 2:
            found += self.two.within(word, 2)
        return found


#: Numbers of a text that the regression sees: strongest hit, different strong words (as a logarithm, and whether there are two), weight per hundred words, strongest quoted, reported and addressed hit.
FEATURES = 7
#: The first of these are evidence, the others correct for contexts.
EVIDENCE = 4


@dataclass
class ToxicModel:
    #: For each term its weight when exact and when misspelled.
    terms: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Of features() in order; those without one weigh nothing.
    weights: tuple[float, ...] = ()
    intercept: float = -4.0
    #: For each stem the weight of a word that begins with it.
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lexicon = Misspellings(sorted(t for t, w in self.terms.items() if w[1] > 0), sorted(t for t, w in self.terms.items() if w[1] <= 0))
        self.lengths = sorted({len(s) for s in self.stems})
        self.known: dict[str, float] = {}
        self.runs: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights, "intercept": self.intercept, "stems": self.stems}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        """Empties what was remembered of words, not what was learnt."""
        self.known.clear()
        self.runs.clear()
        self.lexicon.one.reset()
        self.lexicon.two.reset()

    def weight(self, word: str) -> float:
        """The largest weight among the terms that a word matches and the stems that begin it."""
        got = self.known.get(word)
        if got is None:
            low = fold(word)
            got = max((self.terms[t][d > 0] for t, d in self.lexicon.matches(low)), default=0.0)
            for n in self.lengths:
                got = max(got, self.stems.get(low[:n], 0.0))
            if len(self.known) >= TABLE_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def hits(self, raw: str) -> tuple[str, ...]:
        """The words of a run without white space that match: plain ones, and masked ones without a matching part."""
        got = self.runs.get(raw)
        if got is None:
            plain = [w for w in _TOKEN.findall(raw) if self.weight(w) > 0]
            got = (*plain, *(w for w in masked(raw) if self.weight(w) > 0 and not any(self.weight(p) > 0 for p in _TOKEN.findall(w))))
            if len(raw) <= CACHED_CHARS:
                if len(self.runs) >= TABLE_WORDS:
                    self.runs.clear()
                self.runs[raw] = got
        return got

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """After contexts: the strongest hit, the number of different words above WEAK as a logarithm, and whether there are two."""
        return self.features(text)[:3]

    def features(self, text: str | None) -> tuple[float, ...]:
        """What the regression sees of a text."""
        if not text or not (self.terms or self.stems):
            return (0.0,) * FEATURES
        low = text.lower()
        hits = {w for raw in set(low.split()) for w in self.hits(raw)}
        if not hits:
            return (0.0,) * FEATURES
        spans = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(low)]
        found = [(i, *s) for i, s in enumerate(spans) if s[0] in hits]
        if any(not _TOKEN.fullmatch(w) for w in hits):
            starts = [s[1] for s in spans]
            found += [(bisect_left(starts, m.start()), m.group(), m.start(), m.end()) for m in _MASKED.finditer(low) if m.group() in hits and not _TOKEN.fullmatch(m.group())]
        quotations = [m.span() for m in _QUOTATION.finditer(low)]
        opened = [a for a, _ in quotations]
        values, total = dict.fromkeys(hits, 0.0), 0.0
        quoted = reported = addressed = 0.0
        for i, word, a, b in found:
            near = [s[0] for s in spans[max(0, i - CONTEXT) : i + CONTEXT + 1]]
            weight, factor = self.weight(word), 1.0
            k = bisect_left(opened, b) - 1
            if k >= 0 and b < quotations[k][1]:
                quoted, factor = max(quoted, weight), QUOTED
            elif not REPORTS.isdisjoint(near):
                reported, factor = max(reported, weight), QUOTED
            elif not ADDRESS.isdisjoint(near):
                addressed, factor = max(addressed, weight), ADDRESSED
            values[word] = max(values[word], weight * factor)
            total += weight * factor
        strong = sum(v > WEAK for v in values.values())
        return max(values.values()), math.log1p(strong), float(strong > 1), math.log1p(100 * total / max(1, len(spans))), quoted, reported, addressed

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty * len(y)] * x.shape[1] + [1e-6 * len(y)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def log_tail(t: int, n: int, rate: float) -> float:
    """The logarithm of the chance of t or more among n at `rate`, for t above n x rate."""
    first = math.lgamma(n + 1) - math.lgamma(t + 1) - math.lgamma(n - t + 1) + t * math.log(rate) + (n - t) * math.log1p(-rate)
    term = total = 1.0
    for i in range(t, n):
        term *= (n - i) / (i + 1) * rate / (1 - rate)
        total += term
        if term < 1e-12 * total:
            break
    return first + math.log(total)


def significant(counts: list[tuple[str, int, int]], tested: int, rate: float) -> list[str]:
    """Of (word, toxic rows, clean rows) those that the Benjamini-Hochberg step keeps among `tested` words, surest first."""
    tails = sorted((log_tail(t, t + c, rate), word) for word, t, c in counts)
    last = max((i for i, (p, _) in enumerate(tails, 1) if p <= math.log(FALSE_SHARE * i / tested)), default=0)
    return [word for _, word in tails[:last]]


def uncovered(words: dict[str, float], stems: dict[str, float]) -> tuple[list[str], list[str]]:
    """Words and stems, with the logarithms of their tails, without those that a surer stem begins, and without stems that begin a surer word or stem. Of equals the word goes first, then the longer stem."""
    kept: tuple[list[str], list[str]] = ([], [])
    begun: set[str] = set()
    chosen: set[str] = set()
    for _, stem, _, word in sorted([(p, 0, -len(w), w) for w, p in words.items()] + [(p, 1, -len(w), w) for w, p in stems.items()]):
        starts = [word[:n] for n in range(STEM, len(word) + 1)]
        if (stem and word in begun) or not chosen.isdisjoint(starts):
            continue
        kept[stem].append(word)
        begun.update(starts)
        if stem:
            chosen.add(word)
    return kept


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y) of MAX_ROWS ids at most, a row for each."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("long")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = named.join(F.broadcast(chosen), "doc_id")  # at most MAX_ROWS ids
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def distinct(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, y), bounded in number, without all but the first of those that share a label and one of SIGNATURES least hashes of runs."""
    seeds = np.arange(1, SIGNATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [[int(mix64(own ^ s).min() >> np.uint64(1)) if len(own) else -1 for s in seeds] for own in shingle_sets(batch.column("text").to_pylist(), RUN)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "signs"])

    signed = rows.select("doc_id", "text").mapInArrow(lean(sign), rows.select("doc_id").schema.add("signs", ArrayType(LongType())))
    left = signed.join(rows.select("doc_id", "y"), "doc_id")
    for k in range(SIGNATURES):
        least = left.groupBy(F.col("signs")[k].alias("sign"), "y").agg(F.min(F.struct("doc_id", "signs")).alias("r"))
        left = least.select("r.doc_id", "r.signs", "y")
    return rows.join(left.select("doc_id"), "doc_id", "left_semi")


def words_of(text: str | None) -> tuple[set[str], set[str]]:
    """The folded words of a text, and the stems that begin one word in DENSE."""
    low = (text or "").lower()
    plain = Counter(_TOKEN.findall(low))
    many = sum(plain.values())
    own, begun = set(), Counter()
    for w, n in plain.items():
        f = fold(w)
        if len(w) > 2:
            own.add(f)
        for k in range(STEM, len(f) + 1):
            begun[f[:k]] += n
    own |= {f for raw in set(low.split()) for w in masked(raw) if (f := fold(w)).isalpha()}
    return own, {s for s, n in begun.items() if n * DENSE >= many}


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", copies_once: bool = False) -> ToxicModel:
    """`labels`: the rows that may be learnt from. Word counts are aggregated on the executors; the lexicon, the terms' counts and the features of each sampled row reach the driver."""
    work = Workspace(docs.sparkSession, "toxicity")
    rows = small_batches(work.keep(_labelled(docs, labels, label_col, id_col, text_col), "sample"))  # bounded by MAX_ROWS
    if copies_once:
        rows = work.keep(distinct(rows), "distinct")
    model = _train(work, rows)
    work.close()
    return model


def _train(work: Workspace, rows: DataFrame) -> ToxicModel:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, stem, toxic = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for kind, found in enumerate(words_of(text)):
                    out += found
                    stem += [kind] * len(found)
                    toxic += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(stem, pa.int32()), pa.array(toxic, pa.int64())], names=["word", "stem", "y"])

    totals = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = (totals[0] or 0), (totals[1] or 0)
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return ToxicModel(intercept=math.log(rate / (1 - rate)))

    def log_odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1.0)) - math.log((c + 0.5) / (clean + 1.0))

    counted = rows.select("text", "y").mapInArrow(lean(words), "word string, stem int, y long").groupBy("word", "stem").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    counted = work.keep(counted.select("word", "stem", "t", "c", odds.alias("odds")), "words")
    likely = F.col("odds") >= F.when(F.col("stem") == 1, STEM_ODDS).otherwise(MIN_ODDS)
    tested, many = counted.agg(F.count("*"), F.count(F.when(likely, 1))).first()
    rate = toxic / (toxic + clean)
    # words in too few toxic rows to pass, whatever the others are, stay on the executors
    least = math.log(FALSE_SHARE * many / tested) if many else 0.0
    top = counted.where(likely & (F.col("t") * math.log(rate) <= least)).collect()
    named = {("*" if r["stem"] else "") + r["word"]: r for r in top}
    tails = {name: log_tail(named[name]["t"], named[name]["t"] + named[name]["c"], rate) for name in significant([(name, r["t"], r["c"]) for name, r in named.items()], tested, rate)}
    chosen = uncovered({w: p for w, p in tails.items() if w[0] != "*"}, {w[1:]: p for w, p in tails.items() if w[0] == "*"})
    exact = {w: named[w]["odds"] for w in chosen[0]}
    stems = {w: named[f"*{w}"]["odds"] for w in chosen[1]}
    draft = ToxicModel({w: (o, 1.0) for w, o in exact.items()})

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out, y_out = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen = set()
                low = (text or "").lower()
                for w in {*_TOKEN.findall(low), *(w for raw in set(low.split()) for w in masked(raw))}:
                    if w not in near:
                        if len(near) >= TABLE_WORDS:
                            near.clear()
                        near[w] = tuple(t for t, d in draft.lexicon.matches(fold(w)) if d and fold(w) not in exact)
                    seen.update(near[w])
                out += seen
                y_out += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(y_out, pa.int64())], names=["term", "y"])

    around = rows.select("text", "y").mapInArrow(lean(misspelled), "term string, y long").groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    fuzzy = {r["term"]: log_odds(r["t"], r["c"]) for r in around.collect()}  # a row per term
    unseen = math.log((clean + 1.0) / (toxic + 1.0)) if clean > toxic else 0.0
    # a misspelling that training never met weighs as its term, at a discount
    model = ToxicModel({w: (o, max(0.0, fuzzy[w]) if w in fuzzy else max(unseen, 0.7 * o)) for w, o in exact.items()}, stems=stems)
    names = [f"x{k}" for k in range(FEATURES)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *[pa.array([g[k] for g in got], pa.float64()) for k in range(FEATURES)]], names=["doc_id", "y", *names])

    schema = rows.select("doc_id", "y").schema
    for name in names:
        schema = schema.add(name, "double")
    sample = rows.select("doc_id", "y", "text").mapInArrow(lean(features), schema).toPandas().sort_values("doc_id")  # at most MAX_ROWS rows of numbers
    x, y = sample[names].to_numpy(float), sample["y"].to_numpy(float)
    w, intercept = logistic(x, y)
    while (w[:EVIDENCE] < 0).any():  # more evidence never lowers a score: features that would are left out
        x[:, :EVIDENCE] *= w[:EVIDENCE] > 0
        w, intercept = logistic(x, y)
    return ToxicModel(model.terms, tuple(float(v) for v in w), intercept, stems)


def scored(docs: DataFrame, model: ToxicModel, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score of each row's text."""
    columns = keep if text_col in keep else [*keep, text_col]  # the text goes to Python once, also where it is kept
    texts = columns.index(text_col)
    source = small_batches(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))
    schema = source.select([f"k{i}" for i in range(len(keep))]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([model.score(t) for t in batch.column(texts).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), score], names=schema.names)
        model.forget()

    out = source.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(name))
