"""Language identification by hierarchical discrimination: the family first, then one language against another."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import give_back, map_rows, map_texts
from tessera.llm.training import sample_by_label

#: Labelled rows of each language that a model is fitted on, at most.
SAMPLE_ROWS = 400
#: Character n-grams of 1 to GRAMS characters are hashed to 2 ** HASH_BITS features.
GRAMS, HASH_BITS = 3, 13
#: Characters that are counted at a time.
BLOCK = 1 << 16
#: Families by language code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LATIN = re.compile("[A-Za-z]")
#: Lengths of texts, as powers of 2, for which chance is measured, and texts of letters at random for each.
LENGTHS, DRAWN = range(4, 13), 32


def has_letter(text: str) -> bool:
    """Whether a text has a letter: a character of one of the Unicode categories L."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of a whole text's character n-grams, a vector of length 1."""
    codes = np.frombuffer(re.sub(r"\s+", " ", f" {text.lower()} ").encode("utf-32-le", "replace"), dtype=np.uint32)
    total = np.zeros(1 << HASH_BITS)
    mixers = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + GRAMS - 1]
        for n in range(1, GRAMS + 1):
            m = min(BLOCK, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, dtype=np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + m]) * np.uint32(mixers[k])
                h ^= h >> np.uint32(15)
            total += np.bincount(h >> np.uint32(32 - HASH_BITS), minlength=1 << HASH_BITS)
    return np.sqrt(total / max(1.0, total.sum())).astype(np.float32)


@dataclass
class Line:
    """A linear support vector machine with a logistic curve for its margin."""

    w: np.ndarray
    b: float
    slope: float

    def share(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.w + self.b), -30, 30)))


def fit_line(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 60) -> Line:
    """Squared-hinge loss, classes weighing the same, by accelerated gradient steps. y: True or False."""
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    x, w, b = np.ascontiguousarray(x), np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    w0, b0 = w.copy(), b
    rate = np.float32(1 / (2 * 2 + penalty))  # the rows have length 1, and the intercept adds 1
    for k in range(rounds):
        ahead = np.float32(k / (k + 3))
        vw, vb = w + ahead * (w - w0), b + ahead * (b - b0)
        slack = np.maximum(0, 1 - sign * (x @ vw + vb))
        g = -2 * weight * sign * slack
        w0, b0 = w, b
        w, b = vw - rate * (g @ x + np.float32(penalty) * vw), vb - rate * g.sum()
    margin = x @ w + b
    spread = max(1e-3, min(np.median(margin[y]) if y.any() else 1.0, np.median(-margin[~y]) if (~y).any() else 1.0))
    return Line(w.astype(np.float32), float(b), float(4.0 / spread))


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    family_lines: dict[str, Line] = field(default_factory=dict)
    pair_lines: dict[tuple[str, str], Line] = field(default_factory=dict)
    profiles: dict[str, np.ndarray] = field(default_factory=dict)
    chances: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score for each row of features."""
        names = sorted(self.families)
        if not names:
            return ["und"] * len(x), np.zeros(len(x))
        if len(names) == 1:
            shares = np.ones((len(x), 1))
        else:
            shares = np.stack([self.family_lines[f].share(x) for f in names], axis=1)
            shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-9)
        best = shares.argmax(axis=1)
        out, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, f in enumerate(names):
            at = np.flatnonzero(best == k)
            if not len(at):
                continue
            langs = self.families[f]
            votes = np.zeros((len(at), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                p = self.pair_lines[a, b].share(x[at])
                votes[:, i] += p
                votes[:, j] += 1 - p
            votes /= max(1, len(langs) - 1)
            pick_ = votes.argmax(axis=1)
            out[at] = [langs[i] for i in pick_]
            score[at] = shares[at, k] * (votes[np.arange(len(at)), pick_] if len(langs) > 1 else 1.0)
        return out.tolist(), np.clip(score, 0.0, 1.0)


def chance(profile: np.ndarray, texts: list[str]) -> np.ndarray:
    """How much texts of a language's letters, drawn at random, resemble its profile, for each of LENGTHS: 19 of 20 less."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    rng = random.Random(0)
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 10)))
    drawn = [[" ".join(word() for _ in range(2**k // 4 + 1))[: rng.randrange(2**k, 2 ** (k + 1))] for _ in range(DRAWN)] for k in LENGTHS]
    return np.array([np.quantile([features(t) @ profile for t in some], 0.95) for some in drawn])


def fit_language(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, chances: bool = False) -> LanguageModel:
    """A model from (doc_id, label, text): a bounded sample of `sample_rows` rows of each label at most, with whole texts; see
    sample_by_label. Families are told apart one against the rest, the languages of a family one against one. With
    `chances`, the model also knows what texts of each language resemble, and texts by chance."""
    rows = sample_by_label(labelled.select("doc_id", "label"), labelled.select("doc_id", "text"), sample_rows).toPandas()
    rows = rows[np.array([bool(t) and has_letter(t) for t in rows["text"]], dtype=bool)].sort_values(["label", "doc_id", "text"], kind="stable")
    if rows.empty:
        return LanguageModel()
    x = np.empty((len(rows), 1 << HASH_BITS), dtype=np.float32)
    for i, t in enumerate(rows["text"]):
        x[i] = features(t)
    label = rows["label"].to_numpy()
    family = np.array([FAMILY_OF.get(v, v) for v in label])
    families = {f: sorted(set(label[family == f])) for f in sorted(set(family))}
    lines = {f: fit_line(x, family == f) for f in families} if len(families) > 1 else {}
    pairs = {}
    for langs in families.values():
        for a, b in combinations(langs, 2):
            at = (label == a) | (label == b)
            pairs[a, b] = fit_line(x[at], label[at] == a)
    if not chances:
        del x
        give_back()
        return LanguageModel(families, lines, pairs)
    sums = {v: x[label == v].sum(axis=0) for v in sorted(set(label))}
    profiles = {v: p / np.linalg.norm(p) for v, p in sums.items()}
    chances_of = {v: chance(p, rows["text"][label == v].tolist()) for v, p in profiles.items()}
    del x, rows
    give_back()  # the driver's memory is short
    return LanguageModel(families, lines, pairs, profiles, chances_of)


def _predicted(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    return _judged(model, texts)[:2]


def _judged(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether it resembles its language more than by chance, if the model knows."""
    lang, score, better = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)]
    for at in range(0, len(known), 256):
        some = known[at : at + 256]
        x = np.stack([features(texts[i]) for i in some])
        found, s = model.predict(x)
        for k, (i, v) in enumerate(zip(some, found, strict=True)):
            lang[i] = v
            if v in model.profiles:
                size = min(max(len(texts[i]).bit_length() - 1, LENGTHS[0]), LENGTHS[-1])
                better[i] = x[k] @ model.profiles[v] > model.chances[v][size - LENGTHS[0]]
        score[some] = s
    return lang, score, better


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score 0 to 1) for each whole text. Null texts, and texts without a letter, are `und` with
    score 0. Rows that repeat come back each; an empty table gives no rows; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS numbers for each family and pair
    return map_texts(docs, id_col, text_col, {"lang_pred": "string", "score": "double"}, lambda: lambda texts: list(_predicted(sent.value, texts)))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3, *, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, as they are: without those that have no letter, those whose score is under
    `least`, and, if the model knows chances, those that resemble their language no more than letters at random do."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, better = _judged(sent.value, b.column(at).to_pylist())
        return b.filter(pa.array((np.array(lang, dtype=object) != "und") & (score >= least) & better))

    return map_rows(docs, text_col, work)
