"""Line labelling with a linear-chain conditional random field, and retention by content share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.near_dup import small, texts
from rookery.llm.words import WordHashes, window_hashes

SPACES = b" \t\n\x0b\f\r"
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
EVERY = bytes(range(256))
NOT_UPPER = bytes(b for b in EVERY if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in EVERY if b not in LETTERS)
NOT_DIGIT = bytes(b for b in EVERY if not 48 <= b <= 57)
NOT_MARK = bytes(b for b in EVERY if b not in b"!?|_=~")
ENDS = b".!?:;\"'"
#: Names of the line features, in the order of line_features.
FEATURES = ("bias", "empty", "short", "medium", "long", "symbols", "many_symbols", "bars", "upper", "digits", "marks", "ends", "repeated", "long_words", "short_words")
#: State 1 is content. Used where too few documents are labelled to fit weights.
DEFAULT = {"bias": 1.0, "empty": 0.0, "symbols": -1.5, "many_symbols": -2.5, "bars": -1.5, "upper": -2.5, "digits": -1.5, "marks": -1.5, "ends": 0.5, "repeated": -2.0}


def line_features(lines: list[bytes]) -> np.ndarray:
    """0/1 features of each line, given the lines before it."""
    out, seen = np.zeros((len(lines), len(FEATURES))), set()
    for row, line in zip(out, lines, strict=True):
        words = line.split()
        n = len(words)
        size = max(1, sum(map(len, words)))
        symbols = size_of(line, SYMBOLS)
        letters = len(line.translate(None, NOT_LETTER))
        upper = len(line.translate(None, NOT_UPPER))
        row[:] = (
            1, n == 0, 0 < n <= 2, 2 < n <= 8, n > 8, symbols * 30 > size, symbols * 10 > size, line.count(b"|") * 6 > max(n, 1),
            upper * 2 > letters > 0, len(line.translate(None, NOT_DIGIT)) * 4 > size, len(line.translate(None, NOT_MARK)) * 12 > size,
            n > 0 and words[-1][-1] in ENDS, n > 0 and line in seen, size > 14 * n, n > 0 and size < 2.5 * n,
        )
        seen.add(line)
    return out


def size_of(line: bytes, kinds: bytes) -> int:
    return len(line) - len(line.translate(None, kinds))


class LineCrf:
    """Two states, 0 boilerplate and 1 content: scores `emit` per feature of content over boilerplate, `move` between states."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def default(cls) -> LineCrf:
        return cls(np.array([DEFAULT.get(f, 0.0) for f in FEATURES]), np.array([[0.4, -0.4], [-0.4, 0.4]]))

    @classmethod
    def fit(cls, docs: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> LineCrf:
        """Maximum likelihood by gradient steps over (features, states) of whole documents, padded to the longest."""
        long = max(len(y) for _, y in docs)
        x = np.zeros((len(docs), long, len(FEATURES)))
        y = np.zeros((len(docs), long), int)
        real = np.zeros((len(docs), long))
        for i, (f, s) in enumerate(docs):
            x[i, : len(s)], y[i, : len(s)], real[i, : len(s)] = f, s, 1
        total, step_of = real.sum(), real[:, 1:] * real[:, :-1]
        seen_emit = np.einsum("nt,ntf->f", real * y, x)
        seen_move = np.array([[(step_of * (y[:, :-1] == a) * (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
        crf = cls(np.zeros(len(FEATURES)), np.zeros((2, 2)))
        for _ in range(steps):
            score = np.stack([np.zeros_like(real), x @ crf.emit], axis=2)
            fwd, bwd = np.zeros_like(score), np.zeros_like(score)
            fwd[:, 0] = score[:, 0]
            for t in range(1, long):
                step = np.logaddexp(fwd[:, t - 1, :1] + crf.move[0], fwd[:, t - 1, 1:] + crf.move[1]) + score[:, t]
                fwd[:, t] = np.where(real[:, t, None] > 0, step, fwd[:, t - 1])
            for t in range(long - 2, -1, -1):
                ahead = score[:, t + 1] + bwd[:, t + 1]
                step = np.logaddexp(crf.move[:, 0] + ahead[:, :1], crf.move[:, 1] + ahead[:, 1:])
                bwd[:, t] = np.where(real[:, t + 1, None] > 0, step, 0)
            norm = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            content = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - norm[:, None]) * real
            pair = fwd[:, :-1, :, None] + crf.move + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - norm[:, None, None, None]
            moved = np.einsum("nt,ntab->ab", step_of, np.exp(np.minimum(pair, 0)))
            crf.emit += rate * ((seen_emit - np.einsum("nt,ntf->f", content, x)) / total - decay * crf.emit)
            crf.move += rate * ((seen_move - moved) / total - decay * crf.move)
        return crf

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Most likely states; content where two paths score the same."""
        gain = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b, back = 0.0, gain[0] if gain else 0.0, []
        for g in gain[1:]:
            from0, from1 = b + m10 < a + m00, b + m11 < a + m01  # whether state 0 was better before
            back.append((from0, from1))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + g
        states, now = [], int(b >= a)
        for from0, from1 in reversed(back):
            states.append(now)
            now = 0 if (from1 if now else from0) else 1
        return np.array([*states, now][::-1] if gain else [], int)


def training_lines(text: bytes, good: bool) -> tuple[np.ndarray, np.ndarray]:
    """Line labels from a document's label: lines of good documents are content unless they repeat an earlier one, lines of others aren't."""
    f = line_features(text.split(b"\n"))
    return f, ((f[:, FEATURES.index("repeated")] == 0) & good).astype(int)


def fit_line_crf(docs: DataFrame, labels: DataFrame | None, sample: int = 400, longest: int = 400, most_bytes: int = 50_000) -> LineCrf:
    """A CRF fitted on at most `sample` labelled documents of each class, drawn by a hash of doc_id.

    What comes to the driver is bounded by 2 * sample texts, one per doc_id, of at most most_bytes bytes each; those of more
    bytes or more than `longest` lines are left out of the sample. With fewer than 10 documents of a class the default weights are used.
    """
    if labels is None:
        return LineCrf.default()
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    draw = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    rows = draw[0].union(draw[1]).collect()
    if min(sum(r.quality == q for r in rows) for q in (0, 1)) < 10:
        return LineCrf.default()
    asked = docs.select("doc_id", "text").where(F.col("doc_id").isin([r.doc_id for r in rows]) & F.col("text").isNotNull())
    quality = {r.doc_id: r.quality for r in rows}
    small = asked.where((F.octet_length("text") <= most_bytes) & (F.size(F.split("text", "\n")) <= longest))
    few = small.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    found = [training_lines(r.text.encode(), quality[r.doc_id] == 1) for r in sorted(few, key=lambda r: (r.doc_id, r.text))]
    if min(sum(bool(y.any()) == q for _, y in found) for q in (False, True)) < 10:
        return LineCrf.default()
    return LineCrf.fit(found)


def measures(text: bytes, chars: int, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; chars is the length in code points."""
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    w = window_hashes(hashes.of(words), 5)
    repeated = 0
    if len(w):
        _, where, times = np.unique(w, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[where] > 1)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + 5, -1)
        repeated = int((np.cumsum(edge) > 0).sum())
    return len(words), chars - size_of(text, SPACES), size_of(text, SYMBOLS), dup, repeated


def content_share(text: bytes, crf: LineCrf) -> float:
    """Share of words in lines marked as content; 1 for a text without words."""
    lines = text.split(b"\n")
    counts = np.array([len(line.split()) for line in lines])
    if not counts.sum():
        return 1.0
    return float((counts * crf.viterbi(line_features(lines))).sum() / counts.sum())


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, least_share: float = 0.5, sample: int = 400) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) per row.

    Counts are of whole texts. A document fails the base if it has fewer than 10 words, or if more than a fifth of its words
    lie in 5-word windows found twice or more in it. Of the others, those stay of whose words a share of least_share or
    more is in lines that the line CRF marks as content (see fit_line_crf). Null texts have no words and fail.
    Each row is judged for itself, so repeated rows and null ids are all there; other columns are ignored.
    """
    crf = fit_line_crf(docs, labels, sample)
    emit, move = crf.emit.tolist(), crf.move.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), LineCrf(np.array(emit), np.array(move))
        for batch in small(batches):
            rows = []
            for text in texts(batch.column("text")):
                m = measures(text, len(text.decode()), hashes)
                failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
                share = content_share(text, model)
                rows.append((*m, failed, share, not failed and share >= least_share))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame | None = None, least_share: float = 0.5, sample: int = 400) -> DataFrame:
    """docs, all columns, less the rows that quality_rules rejects; each row is judged where it is read, without a join."""
    crf = fit_line_crf(docs, labels, sample)
    emit, move = crf.emit.tolist(), crf.move.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), LineCrf(np.array(emit), np.array(move))
        for batch in small(batches):
            keep = []
            for text in texts(batch.column("text")):
                m = measures(text, len(text.decode()), hashes)
                keep.append(m[0] >= 10 and 100 * m[4] <= 20 * m[0] and content_share(text, model) >= least_share)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
