"""Language identification with a byte-level convolutional network.

A text's bytes (A-Z lowered) are cut into windows of WINDOW bytes, the last one
padded with spaces. Each window passes an embedding, filters of several widths,
ReLU, max pooling over positions and a softmax; the text's probabilities are the
mean over all its windows. The network is trained in numpy on the driver, on
windows of at most PER_LANGUAGE documents of each language, picked by a hash of
the id; it is a few kilobytes and travels with the tasks.

Edge cases: a null text, or one without a letter (a character of Unicode category
L), is `und` with score 0; of languages with equal probability the first by name is
taken; more than `max_languages` languages raise; rows may repeat; an empty table gives an empty one; without any training row every
text is `und`; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 192
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 4, 8
#: Training rows at most, a language; windows at most of each; passes over them.
PER_LANGUAGE, WINDOWS_PER_TEXT, STEPS = 300, 6, 900
#: Languages that train() takes, unless told otherwise.
MAX_LANGUAGES = 200
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 256


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; other word characters (fractions, superscripts) are none."""
    return any(m.group().isalpha() for m in _LETTERS.finditer(text))


def windows(text: str) -> np.ndarray:
    """All windows of a text, (n, WINDOW) bytes."""
    raw = text.encode("utf-8", "replace").translate(_LOWER)
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


class ByteNet:
    """Embedding, multi-width filters, max pooling and softmax, with its gradients."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        p, n = self.p, len(x)
        e = p["embed"][x]
        parts = []
        for w in WIDTHS:
            cols = np.ascontiguousarray(sliding_window_view(e.reshape(n, -1), w * EMBED, axis=1)[:, ::EMBED]).reshape(-1, w * EMBED)
            z = (cols @ p[f"w{w}"]).reshape(n, WINDOW - w + 1, FILTERS)
            if keep is None:
                top = z.max(axis=1)
            else:
                at = z.argmax(axis=1)
                top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
                keep.append((w, cols.reshape(n, -1, w * EMBED), at))
            parts.append(np.maximum(top + p[f"b{w}"], 0))
        return np.concatenate(parts, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), _BLOCK):
            z = self.pooled(x[i : i + _BLOCK]) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n, keep = self.p, len(x), []
        h = self.pooled(x, keep)
        z = h @ p["out"] + p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (d @ p["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for k, (w, cols, at) in enumerate(keep):
            dz = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = cols[rows, at]  # (n, FILTERS, w * EMBED): what each pooled maximum saw
            g[f"w{w}"] = np.einsum("nf,nfc->cf", dz, seen)
            g[f"b{w}"] = dz.sum(0)
            de = dz[:, :, None] * p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["embed"], x[rows, at + j], de[:, :, j * EMBED : (j + 1) * EMBED])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> ByteNet:
        """Adam over batches that hold every language equally often."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, STEPS + 1):
            at = np.array([rng.choice(by[k]) for k in rng.integers(0, len(by), 64)])
            rate = 0.01 * (1 - step / (STEPS + 1))
            for k, g in self.gradients(x[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> ByteNet | None:
    """A network from at most PER_LANGUAGE rows of each language, those of least id hash up to a share that the language's count sets."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages to learn them all")
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("l") == lang, F.lit(min(1.0, PER_LANGUAGE / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # windows are cut on the executors: a very long text sends no more than its share
    picked = rows.where(unit < share).select("i", "l", F.encode("t", "UTF-8").alias("b"))
    most = F.greatest(F.floor((F.octet_length("b") - 1) / WINDOW) + 1, F.lit(1))
    take = F.least(most, F.lit(WINDOWS_PER_TEXT))
    cut = F.transform(F.sequence(F.lit(0), take.cast("int") - 1), lambda k: F.substring(F.col("b"), (F.floor(k * most / take) * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    got = picked.select("i", "l", cut.alias("w")).orderBy("l", "i").limit(2 * PER_LANGUAGE * len(counts)).collect()
    languages = sorted({r["l"] for r in got})
    x, y = [], []
    for r in got:
        for raw in r["w"]:
            x.append(np.frombuffer(bytes(raw).translate(_LOWER).ljust(WINDOW), np.uint8))
            y.append(languages.index(r["l"]))
    return ByteNet(languages).fit(np.array(x), np.array(y)) if x else None


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            pending: list[np.ndarray] = []
            owner: list[int] = []
            size = 0
            total = np.zeros((batch.num_rows, len(net.languages) if net else 1))

            def flush() -> None:
                if pending:
                    probs = net.probabilities(np.concatenate(pending))
                    ends = np.cumsum([len(w) for w in pending])
                    for i, part in zip(owner, np.split(probs, ends[:-1]), strict=True):
                        total[i] = part.astype(np.float64).mean(0)
                    pending.clear()
                    owner.clear()

            for i, text in enumerate(batch.column("text").to_pylist()):
                if net and text and has_letter(text):
                    pending.append(windows(text))
                    owner.append(i)
                    size += len(pending[-1])
                    if size >= 4096:
                        flush()
                        size = 0
            flush()
            for row in total:
                known = row.sum() > 0
                lang.append(net.languages[int(row.argmax())] if known else UNKNOWN)
                score.append(float(row.max() / row.sum()) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)

