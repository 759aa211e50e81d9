"""Language identification by a string kernel.

Two texts are as alike as the character n-grams of lengths 1 to ``longest`` that both hold, however often (a blended
spectrum of presence), over the geometric mean of how many each holds; n-grams that no landmark holds don't count. Landmark texts of each language span the Nyström
map of this kernel; one-versus-rest ridge regression on the map gives a score for each language. Scoring is two matrix
products for a batch of texts. Landmarks are lists of holders by n-gram, laid out for the n-grams of a batch only, so a
model grows with what its landmarks hold.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.common import batch, remainder_is, strings

UNKNOWN = "und"
BITS = 20
#: Characters of the longest n-grams.
LONGEST = 4
#: Folds code points below this by a table; those above, which have no case but for a few, are taken as they are.
LOW = 0x2000
#: Letters and the marks that belong to them are kept; only a letter makes a text one of a language.
_FOLD = np.array([ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] in "LM" else 32 for c in range(LOW)], np.uint32)
_LETTER = np.array([chr(c).isalpha() for c in range(LOW)])
_TABLES = 1 << BITS
#: Bounds of a model, whatever the number of languages: landmarks, and texts that are drawn (twice as many at most).
MOST_LANDMARKS, MOST_DRAWN = 2_048, 16_000
#: Places of the landmarks that are laid out at a time.
LAID_OUT = 1 << 22


def folded(text: str) -> np.ndarray:
    """Lower-case code points; all that is no letter or mark, a single space. A space stands at either end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < LOW, _FOLD[np.minimum(c, LOW - 1)], c)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def has_letter(code: np.ndarray) -> bool:
    return bool(_LETTER[code[code < LOW]].any()) or any(chr(c).isalpha() for c in np.unique(code[code >= LOW]).tolist())


def grams(code: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of BITS bits of all n-grams of 1 to ``longest`` code points; some may repeat."""
    out, key = [], np.zeros(len(code), np.uint64)
    for n in range(1, longest + 1):
        if len(code) < n:
            break
        key = key[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :].astype(np.uint64) + np.uint64(n)
        out.append((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int64)


@dataclass
class StringKernelModel:
    """Languages, the column of each n-gram (none: -1), the landmarks that hold it (``holders``, from ``begins`` of its column on), and the map from kernel values to scores."""

    languages: list[str]
    longest: int
    column: np.ndarray
    begins: np.ndarray
    holders: np.ndarray
    norms: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray

    def kernel(self, held: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their n-grams, with the landmarks."""
        text, at = np.repeat(np.arange(len(held)), list(map(len, held))), self.column[np.concatenate(held)]
        text, at = text[at >= 0], at[at >= 0]
        met = np.zeros(len(self.begins) - 1, bool)
        met[at] = True
        columns, at = np.flatnonzero(met), (np.cumsum(met) - 1)[at]
        size, common = np.zeros(len(held), np.float32), np.zeros((len(held), len(self.norms)), np.float32)
        step = max(1, LAID_OUT // max(len(self.norms), len(held)))
        for k in range(0, len(columns), step):
            some = columns[k : k + step]
            n = self.begins[some + 1] - self.begins[some]
            marks = np.zeros((len(some), len(self.norms)), np.float32)
            marks[np.repeat(np.arange(len(some)), n), self.holders[np.repeat(self.begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = 1
            present = np.zeros((len(held), len(some)), np.float32)
            here = (at >= k) & (at < k + step)
            present[text[here], at[here] - k] = 1
            size += present.sum(axis=1)
            common += present @ marks
        return common / (np.sqrt(np.maximum(size, 1))[:, None] * self.norms[None, :])

    def scores(self, held: list[np.ndarray]) -> np.ndarray:
        return np.c_[self.kernel(held) @ self.whiten, np.ones(len(held), np.float32)] @ self.weights

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for start in range(0, len(texts), 128):
            codes = {i: c for i in range(start, min(start + 128, len(texts))) if texts[i] and has_letter(c := folded(texts[i]))}
            if codes:
                s = self.scores([grams(c, self.longest) for c in codes.values()]).astype(np.float64)
                p = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, q in zip(codes, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    out[i] = self.languages[k], min(1.0, q)
        return out


def fit(known: list[tuple[np.ndarray, str]], landmarks_each: int = 32, longest: int = LONGEST, ridge: float = 1e-2) -> StringKernelModel:
    """Learns from the distinct n-grams of texts and their languages. Of many languages each has fewer landmarks, ``MOST_LANDMARKS`` in all."""
    languages = sorted({lang for _, lang in known})
    column, none = np.full(_TABLES, -1, np.int32), np.zeros((0, 0), np.float32)
    if not languages:
        return StringKernelModel([], longest, column, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), none, none)
    landmarks_each = max(1, min(landmarks_each, MOST_LANDMARKS // len(languages)))
    by_language: dict[str, list[np.ndarray]] = {lang: [] for lang in languages}
    for c, lang in known:
        if len(by_language[lang]) < landmarks_each:
            by_language[lang].append(c)
    chosen = [c for lang in languages for c in by_language[lang]]
    size = np.fromiter(map(len, chosen), np.int64, len(chosen))
    used, at = np.unique(np.concatenate(chosen), return_inverse=True)
    column[used] = np.arange(len(used), dtype=np.int32)
    holders = np.repeat(np.arange(len(chosen), dtype=np.int32), size)[np.argsort(at, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(used)))])
    model = StringKernelModel(languages, longest, column, begins, holders, np.sqrt(size.astype(np.float32)), none, none)
    k = np.concatenate([model.kernel(chosen[i : i + 128]) for i in range(0, len(chosen), 128)]).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6 * value.max()
    model.whiten = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    place = {lang: i for i, lang in enumerate(languages)}
    label = np.array([place[lang] for _, lang in known])
    weight = 1 / np.bincount(label)[label]  # a rare language weighs as much as a frequent one
    weight *= len(weight) / weight.sum()
    left, right = np.zeros((keep.sum() + 1,) * 2), np.zeros((keep.sum() + 1, len(languages)))
    for i in range(0, len(known), 128):
        x = np.c_[(model.kernel([c for c, _ in known[i : i + 128]]) @ model.whiten).astype(np.float64), np.ones(len(known[i : i + 128]))]
        weighted = x * weight[i : i + 128, None]
        left += x.T @ weighted
        right += weighted.T @ np.where(label[i : i + 128, None] == np.arange(len(languages)), 1.0, -1.0)
    model.weights = np.linalg.solve(left + ridge * len(known) / 100 * np.eye(len(left)), right).astype(np.float32)
    return model


def training_rows(docs: DataFrame, each: int, id_col: str, text_col: str, lang_col: str, most_languages: int = 256) -> list[tuple[np.ndarray, str]]:
    """A sample by the id's hash of about ``each`` labelled texts of each language, none of the held-out fold; twice as many at most.

    Of more than ``most_languages`` languages those with the most texts are learned, the first by name of equals; of many, each
    has a smaller sample, ``MOST_DRAWN`` texts in all. Only n-grams travel, each once for a text, of texts that have a letter; so a very long text is no larger than 2 ** BITS of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~remainder_is("id", 5, 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return []
    each = max(1, min(each, MOST_DRAWN // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("grams", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [folded(t) for t in strings(b.column(2))]
            keep = [has_letter(c) for c in codes]
            yield batch(schema, [b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_())), [np.unique(grams(c, LONGEST)).astype("<i4").tobytes() for c, k in zip(codes, keep, strict=True) if k]])

    sample = rows.filter(drawn < share[F.col("lang")]).select("lang", F.xxhash64("id", "text").alias("h"), "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = sample.withColumn("turn", turn).filter(F.col("turn") <= 2 * each).select("lang", "h", "text")
    got = sorted((r["lang"], r["h"], bytes(r["grams"])) for r in some.mapInArrow(cut, "lang string, h long, grams binary").collect())
    return [(np.frombuffer(raw, "<i4"), lang) for lang, _, raw in got]


def identify(docs: DataFrame, each: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = 256) -> DataFrame:
    """Predicts the language of every text.

    Learns from a sample of about ``each`` texts (``2 * each`` at most) of every language among the rows whose id's crc32
    mod 5 is not 0 and whose language and text are known, of the ``most_languages`` languages with the most texts. The model
    goes to every task: 4 MB, and what ``MOST_LANDMARKS`` texts hold at most. Returns ``doc_id, held_out, lang_pred, score``, one row for each row of ``docs``, without an exchange. A null text, or one without a
    letter, is ``und`` with score 0, and so is every text where nothing can be learned. A null id is not held out. Ties go
    to the language that is first by name. A very long text is read whole. Repeated rows get the same answer; an empty table
    gives none; other columns are not read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, each, id_col, text_col, lang_col, most_languages)))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = model.value.predict(strings(b.column(2)))
            yield batch(schema, [b.column(0), b.column(1), [x for x, _ in said], [y for _, y in said]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", remainder_is("doc_id", 5, 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, each: int = 300, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = 256) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language: not ``und``, and a score of ``least`` or more.

    A text that looks almost as much like one language as like another is rejected with that. Where the language of a row
    that stays is null, it becomes the predicted one. A null or empty text goes; a very long one is read whole; repeated rows
    get the same answer; an empty table gives no row; clashing names of other columns do no harm.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, each, id_col, text_col, lang_col, most_languages)))
    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = model.value.predict(strings(b.column(at)))
            known = b.column(lang)
            filled = known.fill_null("").to_pylist() if known.null_count else None
            if filled is not None:
                filled = [x if x or v else y for x, v, (y, _) in zip(filled, known.is_valid().to_pylist(), said, strict=True)]
                b = b.set_column(lang, b.schema.field(lang), pa.array(filled, b.schema.field(lang).type))
            yield b.filter(pa.array([x != UNKNOWN and y >= least for x, y in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
