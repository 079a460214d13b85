"""Quality scores by compression: which of two dictionaries, of good and of bad texts, compresses a text better."""

from __future__ import annotations

import random
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts
from tessera.llm.training import sample_by_label

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_ROWS = 1200
#: Bytes of a dictionary, and of the pieces in which texts are compressed.
DICT_BYTES, PIECE = 384 << 10, 1024
LEVEL = 7
#: Bytes that are added to a text's before its difference is divided by them: of a short text little is known.
SHORT = 100


def build_dictionary(texts: list[str], size: int = DICT_BYTES, piece: int = 64) -> bytes:
    """All of the texts, or `size` bytes of pieces drawn from them: whole texts are cut into pieces, and each is as likely
    to be drawn, wherever it stands."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    ends = list(accumulate(-(-len(r) // piece) for r in raw))
    if not ends or sum(map(len, raw)) <= size:
        return b"\n".join(raw)
    drawn = random.Random(0).sample(range(ends[-1]), min(ends[-1], -(-size // piece)))
    out = []
    for n in drawn:
        k = bisect_right(ends, n)
        at = (n - (ends[k - 1] if k else 0)) * piece
        out.append(raw[k][at : at + piece])
    return b"".join(out)[:size]


@dataclass
class QualityModel:
    """good, bad: dictionaries; weights: the score is 1 / (1 + exp(-evidence @ weights))."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0, 0.0)

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        out = []
        for d in (self.good, self.bad):
            primed = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False))
        return tuple(out)


def evidence(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """What a text's score depends on: how many bytes fewer the good dictionary needs than the bad one, divided by the
    text's bytes and SHORT (0 if neither helps, as in repetitions, which need next to nothing); and 1.

    The whole text is compressed, in pieces, so that what it says of itself doesn't outweigh the dictionaries."""
    raw = (text or "").encode("utf-8", "replace")
    saved = 0
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        saved += len(bad.compress(part)) - len(good.compress(part))
    return saved / (len(raw) + SHORT), 1.0


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of least squared-penalised log loss, by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w / scale


def fit_quality(labels: DataFrame, texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from (doc_id, label 0 or 1) and (doc_id, text): a bounded sample of `sample_rows` rows of each class at most,
    with whole texts; see sample_by_label.

    Half of the sample builds dictionaries by which the other half is scored, and the other way round; a logistic curve
    is fitted to those scores, with each class weighing as it does among all labelled rows. The dictionaries of the
    model come from the whole sample. Without rows of both classes every score is 0.5.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return QualityModel()
    rows = sample_by_label(labels, texts, sample_rows).toPandas()
    rows = rows[rows["text"].fillna("") != ""].sort_values(["label", "doc_id", "text"], kind="stable").reset_index(drop=True)
    texts = {k: rows.loc[rows["label"] == k, "text"].tolist() for k in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return QualityModel()
    x, y = [], []
    for side in (0, 1):
        half = QualityModel(build_dictionary(texts[1][side::2]), build_dictionary(texts[0][side::2]))
        good, bad = half.compressors()
        for k in (0, 1):
            own = texts[k][1 - side :: 2]
            x += [evidence(t, good, bad) for t in own]
            y += [k] * len(own)
    y = np.array(y, dtype=float)
    weights = logistic(np.array(x), y)
    weights[1] += np.log(counts[1] / counts[0] / (sum(y == 1) / sum(y == 0)))
    return QualityModel(build_dictionary(texts[1]), build_dictionary(texts[0]), tuple(weights))


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each whole text: 0 to 1, higher where label 1 is likelier. Null and empty texts get the score
    of a text of length 0. Rows that repeat come back each; an empty table gives no rows; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES

    def start():
        m = sent.value
        good, bad = m.compressors() if m.good else (None, None)

        def work(texts: list[str | None]) -> list[list]:
            x = np.array([evidence(t, good, bad) if m.good else (0.0, 0.0) for t in texts]).reshape(-1, 2)
            return [1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30)))]

        return work

    return map_texts(docs, id_col, text_col, {"score": "double"}, start)
