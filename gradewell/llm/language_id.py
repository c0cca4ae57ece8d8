"""Language identification of mixed texts: script ranges, word scores and a Viterbi path.

A word is a run of letters and marks of one script. Code-point ranges give each word its script, and
only languages learnt with that script are its candidates (all of them, equally, if none is). A
word's score for a candidate is the sum of the log probabilities of its three-letter windows, word
ends included. The best labelling of all words of a text is a Viterbi path over the languages:
the sum of the word scores less ``penalty`` for each change of language. Runs of one label are the
text's spans; the label that covers the most letters (of several, the first in sorting order) is
the text's language and its share of the letters the score.

The path is exact for texts of any length. Words are scored in slices of at most ``SLICE`` characters.
Words are then laid out in blocks of ``BLOCK`` consecutive words; for all blocks at once, max-plus
recursion gives what each block does to each entering language, a scan over a text's blocks gives
the true entry scores, and a second recursion from these records one byte-sized pointer per word
and language. So the steps taken one after the other are ``BLOCK`` plus the number of blocks.

Learning counts windows per language in the tasks that read the texts and adds them up by key; what
comes to the driver is bounded by languages x ``BUCKETS``. It learns from labelled documents that
aren't held out: at most ``max_labelled`` different ids, those with the smallest hashes, and the
``max_languages`` most frequent languages among them.

A null or empty text, or one without a letter, is ``und`` with score 0, and so is every text
where nothing could be learnt. Rows with a null id aren't held out; repeated rows count each.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, give_back, prepared, runs, texts_of

BUCKETS = 1 << 16
BLOCK = 64
MARK = np.uint8(0x80)
UNDETERMINED = "und"
#: A score that no candidate reaches: languages that aren't learnt with a word's script.
NEVER = -1e6

# fixed values: the first code point of each range of the Unicode blocks that belong to one script
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"),
    (0x3000, "other"), (0x3005, "han"), (0x3008, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
    (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"),
    (0xFF00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(script number + 1 of each letter, plus ``MARK`` for marks, 0 elsewhere; simple lower-case form) by code point."""
    if not _TABLES:
        starts = np.array([a for a, _ in SCRIPTS])
        numbers = np.array([SCRIPT_NAMES.index(name) + 1 for _, name in SCRIPTS], dtype=np.uint8)
        points = np.arange(0x110000)
        script = numbers[np.searchsorted(starts, points, side="right") - 1]
        category = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        script[category == "M"] |= MARK
        script[(category != "L") & (category != "M")] = 0
        lower = points.astype(np.uint32)
        for c in np.flatnonzero(script):
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _TABLES.extend([script, lower])
    return _TABLES[0], _TABLES[1]


@dataclass
class Words:
    """Words of one run of characters: first and stop positions, script, text, and their windows."""

    first: np.ndarray
    stop: np.ndarray
    script: np.ndarray
    bucket: np.ndarray = field(repr=False)  # of the window around each letter, words one after the other
    at: np.ndarray = field(repr=False)  # where each word's windows begin


def words_of(points: np.ndarray) -> Words:
    """The words of an array of code points; windows reach over a word's own letters and its two ends."""
    script, lower = _tables()
    marked = script[points]
    kind = marked & ~MARK
    # segments of one kind, one after the other; those with a letter are the words (marks alone are none)
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    first, stop = edge[:-1], edge[1:]
    lettered = np.logical_or.reduceat((marked > 0) & (marked < MARK), first) if len(first) else np.zeros(0, dtype=bool)
    letters = np.flatnonzero(np.repeat(lettered, stop - first)) + (edge[0] if len(edge) else 0)
    first, stop = first[lettered], stop[lettered]
    sizes = stop - first
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    c = lower[points[letters]]
    before, after = np.empty_like(c), np.empty_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    before[at], after[at + sizes - 1] = 0, 0
    h = before * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return Words(first, stop, kind[first] - 1, h >> np.uint32(16), at)


def slices(text: str):
    """(first position, code points) of parts of at most about ``SLICE`` characters that don't cut a
    word, unless one word is longer; a word that long is cut."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = 0
    while begin < len(points):
        end = min(len(points), begin + SLICE)
        if end < len(points):
            script = _tables()[0]
            kind = script[points[begin : end + 1]] & ~MARK
            ends = np.flatnonzero(kind[1:] != kind[:-1])
            end = begin + int(ends[-1]) + 1 if len(ends) else end
        yield begin, points[begin:end]
        begin = end


@dataclass
class Model:
    """languages, sorted; logs[bucket, language]; fits[script, language]: learnt with the script."""

    languages: list[str]
    logs: np.ndarray
    fits: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Of each word (rows) for each language (columns)."""
        n = len(self.languages)
        if not len(words.first):
            return np.zeros((0, n))
        total = np.add.reduceat(self.logs[words.bucket], words.at, axis=0)
        fits = self.fits[words.script]
        known = fits.any(axis=1)
        return np.where(known[:, None], np.where(fits, total, NEVER), 0.0)


def fit(languages: list[str], windows: np.ndarray, scripts: np.ndarray, smoothing: float = 0.5, share: float = 0.01) -> Model:
    """From counts[bucket, language] and letters[script, language]; a language is a candidate for the
    scripts of at least ``share`` of its letters."""
    logs = np.log(windows + smoothing) - np.log(windows.sum(axis=0) + smoothing * len(windows))
    return Model(languages, logs.astype(np.float32), scripts >= np.maximum(1, share * scripts.sum(axis=0)))


def step(entering: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    """One step of the recursion over the last axis."""
    return np.maximum(entering, entering.max(axis=-1, keepdims=True) - penalty) + score


def viterbi(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of several texts; text i's words are rows begin[i] to begin[i + 1].

    Staying wins over an equal change; of equal languages the smaller number wins.
    """
    n, languages = scores.shape
    words = np.diff(begin)
    blocks = -(-words // BLOCK)
    head = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    if not head[-1]:
        return np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(words)), blocks)
    start = begin[text] + (np.arange(head[-1]) - head[text]) * BLOCK
    size = np.minimum(BLOCK, begin[text + 1] - start)
    row = lambda k: np.flatnonzero(size > k)

    # what a block makes of each entering language: moves[block, entering, leaving]
    moves = np.where(np.eye(languages, dtype=bool), 0.0, NEVER * NEVER)[None].repeat(head[-1], axis=0)
    for k in range(BLOCK):
        b = row(k)
        if not len(b):
            break
        moves[b] = step(moves[b], scores[start[b] + k][:, None, :], penalty)

    # true entry scores, block by block, for all texts together
    entry = np.zeros((head[-1], languages))
    for k in range(int(blocks.max()) - 1):
        t = np.flatnonzero(blocks > k + 1)
        b = head[t] + k
        leaving = (entry[b][:, :, None] + moves[b]).max(axis=1)
        entry[b + 1] = leaving - leaving.max(axis=1, keepdims=True)

    # again from the entry scores: where each word's best predecessor is, and each block's origin
    came = np.empty((n, languages), dtype=np.uint8 if languages <= 256 else np.uint16)
    origin = np.arange(languages)[None].repeat(head[-1], axis=0)
    value = entry.copy()
    for k in range(BLOCK):
        b = row(k)
        if not len(b):
            break
        v, top = value[b], value[b].argmax(axis=1)
        best = np.take_along_axis(v, top[:, None], axis=1) - penalty
        before = np.where(v >= best, np.arange(languages)[None], top[:, None])
        came[start[b] + k] = before
        value[b] = np.maximum(v, best) + scores[start[b] + k]
        origin[b] = np.take_along_axis(origin[b], before, axis=1)

    # the last word's best language, traced back block by block and then word by word
    last = np.zeros(head[-1], dtype=np.int64)
    has = np.flatnonzero(blocks)
    tail = head[has + 1] - 1
    last[tail] = value[tail].argmax(axis=1)
    for k in range(int(blocks.max()) - 1):
        t = has[blocks[has] > k + 1]
        b = head[t + 1] - 1 - k
        last[b - 1] = origin[b, last[b]]
    label = np.empty(n, dtype=np.int64)
    now = last.copy()
    for k in range(BLOCK - 1, -1, -1):
        b = row(k)
        label[start[b] + k] = now[b]
        now[b] = came[start[b] + k, now[b]]
    return label


def labelled(texts: list[str], model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, first, stop, label): words begin[i] to begin[i + 1] of text i with their positions and labels."""
    first, stop, scores, count = [], [], [], [0]
    for text in texts:
        found = 0
        for begin, points in slices(text):
            words = words_of(points)
            first.append(words.first + begin)
            stop.append(words.stop + begin)
            scores.append(model.scores(words))
            found += len(words.first)
        count.append(found)
    empty = np.zeros(0, dtype=np.int64)
    begin = np.cumsum(count)
    label = viterbi(np.concatenate([np.zeros((0, len(model.languages))), *scores]), begin, penalty)
    return begin, np.concatenate([empty, *first]), np.concatenate([empty, *stop]), label


def predict(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    if not model.languages:
        return [(UNDETERMINED, 0.0)] * len(texts)
    begin, first, stop, label = labelled(texts, model, penalty)
    n = len(model.languages)
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    letters = np.bincount(text * n + label, weights=stop - first, minlength=len(texts) * n).reshape(-1, n)
    total, best = letters.sum(axis=1), letters.argmax(axis=1)
    return [
        (model.languages[best[i]], float(letters[i, best[i]] / total[i])) if total[i] else (UNDETERMINED, 0.0) for i in range(len(texts))
    ]


def spans(text: str, model: Model, penalty: float = 12.0) -> list[tuple[int, int, str]]:
    """(first, stop, language) of the text's runs of words with one label, from its first letter on."""
    if not model.languages:
        return []
    _, first, stop, label = labelled([text], model, penalty)
    turns = np.flatnonzero(np.diff(label, prepend=-1))
    ends = np.append(turns[1:], len(label)) - 1
    return [(int(first[a]), int(stop[z]), model.languages[label[a]]) for a, z in zip(turns, ends)]


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    spark: SparkSession, docs: DataFrame, max_labelled: int = 20_000, max_languages: int = 256,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Window and script counts of the labelled sample, as log probabilities."""
    prepared(spark)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # the bound is a hash value, so no text is shuffled or collected
    bound = usable.select("h").distinct().orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    sample = usable.where(F.col("h") <= F.lit(bound)) if bound is not None else usable.limit(0)
    chosen = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    languages = sorted(r.lang for r in chosen)
    number = {lang: i for i, lang in enumerate(languages)}
    kinds = len(SCRIPT_NAMES)

    def count(batches):
        # per task: at most languages x (buckets + scripts) counts
        give_back()
        found = np.zeros((len(languages), BUCKETS + kinds), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                if lang in number:
                    for _, points in slices(text):
                        words = words_of(points)
                        own = found[number[lang]]
                        own[:BUCKETS] += np.bincount(words.bucket, minlength=BUCKETS)
                        own[BUCKETS:] += np.bincount(words.script, weights=words.stop - words.first, minlength=kinds).astype(np.int64)
        for i in range(len(languages)):
            at = np.flatnonzero(found[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(found[i, at])], names=["l", "at", "n"])

    got = sample.select("lang", "text").mapInArrow(count, "l int, at int, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + kinds, len(languages)))
    counts[got["at"].to_numpy(), got["l"].to_numpy()] = got["n"].to_numpy()
    return fit(languages, counts[:BUCKETS], counts[BUCKETS:])


def languages(
    spark: SparkSession, docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; a narrow pass over whole texts."""
    prepared(spark)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def place(batches):
        give_back()
        for batch in batches:
            texts = texts_of(batch)
            found = [p for a, b in runs([len(t) for t in texts], SLICE) for p in predict(texts[a:b], model, penalty)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.float64())],
                names=schema.names,
            )

    return rows.mapInArrow(place, schema)


def language_spans(
    spark: SparkSession, docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per span: id, span number, first and stop code point, language."""
    prepared(spark)
    schema = T.StructType(
        [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("span", "first", "stop")), T.StructField("language", T.StringType())]
    )

    def mark(batches):
        give_back()
        for batch in batches:
            for i, text in enumerate(texts_of(batch)):
                own = spans(text, model, penalty)
                ids = batch.column(0).slice(i, 1).take(pa.array([0] * len(own), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(range(len(own)), pa.int64()), *(pa.array([s[k] for s in own], pa.int64()) for k in (0, 1)), pa.array([s[2] for s in own], pa.string())],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(mark, schema)
