"""Secrets in texts: fixed patterns, and character Markov models for the rest.

A run of letters, digits and separators is scored under Markov models of random
strings (one per alphabet) and one of ordinary identifiers. It is a secret if the
log likelihood ratio per character is above a threshold. If the whole run is not,
its parts between separators are scored alone, and then the stretches of the run
whose ratios add up to the most. The identifiers' model is
trained on words of a bounded sample of documents, the random models on drawn
strings; both samples carry their labels by construction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Parameters: at most so many documents train the identifiers' model.
TRAINING_DOCUMENTS = 2000
RANDOM_STRINGS = 3000  # per alphabet
THRESHOLD = 0.8  # nats per character
LEAST_LENGTH = 16
STRONG = 20.0  # nats of a stretch, whatever its length
UNKNOWN = 0.06  # share of symbols in an identifier that follow no known pair
WHOLE = 0.35  # nats per character against identifiers, also of the part to which a stretch belongs
NUMBER = 8  # so many digits in a row are a number, and no part of a stretch
SEED = 9

# The base patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run shorter than 24 is dropped, so only long runs need to match
_HEX = re.compile(r"[0-9a-f]{24,}")

_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_N = len(_SYMBOLS)
_SEPARATORS = np.flatnonzero([not c.isalnum() for c in _SYMBOLS])
_PART = re.compile(r"[A-Za-z0-9]+")
_NUMBER = re.compile(rf"[0-9]{{{NUMBER},}}")
_WORD = re.compile(r"[A-Za-z0-9+/_-]{2,}")
_LETTERS = re.compile(r"[A-Za-z]{2,}")
_SMALL = re.compile(r"[a-z+/_-]+")
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(_N)
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _SYMBOLS[:62], _SYMBOLS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base matches, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def bigrams(words: list[str]) -> np.ndarray:
    """Counts of symbol pairs, ((_N + 1) x _N): row _N is the start of a word."""
    counts = np.zeros((_N + 1) * _N, dtype=np.int64)
    if words:
        codes = _CODE[np.frombuffer("".join(words).encode(), np.uint8)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        before = np.concatenate([[_N], codes[:-1]])
        before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = _N
        counts += np.bincount(before * _N + codes, minlength=len(counts))
    return counts.reshape(_N + 1, _N)


def _log(counts: np.ndarray) -> np.ndarray:
    """Log transition probabilities, add-one smoothed."""
    return np.log((counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True))


def random_models(seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    models = []
    for alphabet in _ALPHABETS:
        letters = np.array(list(alphabet))
        words = ["".join(rng.choice(letters, int(n))) for n in rng.integers(16, 65, RANDOM_STRINGS)]
        models.append(_log(bigrams(words)))
    return np.stack(models)


def _ratio(run: str, random: np.ndarray, ordinary: np.ndarray) -> float:
    """Log likelihood ratio per character of the best of the random models to the best ordinary one."""
    codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
    before = np.concatenate([[_N], codes[:-1]])
    return float((random[:, before, codes].sum(axis=1).max() - ordinary[:, before, codes].sum(axis=1).max()) / len(codes))


def log_ratio(run: str, random: np.ndarray, ordinary: np.ndarray) -> float:
    """Log likelihood ratio per character of the best random model to words as they stand."""
    return _ratio(run, random, ordinary[:1])


def unlike_names(run: str, random: np.ndarray, ordinary: np.ndarray) -> bool:
    """Whether a run is unlike identifiers made of words; small letters alone make words, no such names."""
    return _SMALL.fullmatch(run) is not None or _ratio(run, random, ordinary[1:]) > WHOLE


def looks_random(run: str, random: np.ndarray, ordinary: np.ndarray) -> bool:
    """Whether a run is unlike words as they stand, and unlike identifiers made of words."""
    return log_ratio(run, random, ordinary) > THRESHOLD and unlike_names(run, random, ordinary)


def identifiers(words: list[str]) -> tuple[list[str], list[str]]:
    """Identifiers of one to four consecutive words: mixed case, and upper case; some end in a number."""
    mixed, upper = [], []
    at = 0
    while at < len(words):
        n = 1 + at % 4
        parts = [w.lower() for w in words[at: at + n]]
        named = [w.capitalize() for w in parts]
        if at % 3 == 0:
            named[at % len(named)] = parts[at % len(parts)][:4].upper()  # an abbreviation
        number = str(at % 100) if at % 5 == 0 else ""
        mixed += [parts[0] + "".join(named[1:]) + number, "".join(named) + number]
        upper += [w.upper() for w in parts] + [parts[-1].upper() + number]
        at += n
    return mixed, upper


def _codes(run: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a run and the symbol before each, a separator standing for the start of a word."""
    codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
    before = np.concatenate([[_N], codes[:-1]])
    before[np.isin(before, _SEPARATORS)] = _N
    return codes, before


def _best_stretch(gains: np.ndarray) -> tuple[float, int, int]:
    """(sum, start, end) of the stretch with the greatest sum of any row of ``gains``."""
    total = np.concatenate([np.zeros((len(gains), 1)), np.cumsum(gains, axis=1)], axis=1)
    low = np.minimum.accumulate(total, axis=1)
    k, end = np.unravel_index(np.argmax(total - low), total.shape)
    return float(total[k, end] - low[k, end]), int(np.argmin(total[k, : end + 1])), int(end)


def _stretches(run: str, random: np.ndarray, ordinary: np.ndarray) -> Iterator[tuple[int, int]]:
    """Random parts and stretches of a run that is not random as a whole."""
    free = []  # what numbers and random parts leave of the run
    at = 0
    taken = [(m.start(), m.end(), False) for m in _NUMBER.finditer(run)]
    for m in _PART.finditer(run):
        if m.end() - m.start() >= LEAST_LENGTH and not m.group().isdigit() \
                and looks_random(m.group(), random, ordinary):
            taken = [t for t in taken if not m.start() <= t[0] < m.end()] + [(*m.span(), True)]
    for a, b, secret in sorted(taken):
        free.append((at, a))
        at = b
        if secret:
            yield a, b
    free.append((at, len(run)))
    codes, before = _codes(run)
    gains = random[:, before, codes] - ordinary[0, before, codes]
    of = np.isin(codes, _SEPARATORS)
    gains[:, of] = np.minimum(gains[:, of], 0.0)  # separators speak for neither
    parts = [(m.start(), m.end()) for m in _PART.finditer(run)]
    while free:
        low, high = free.pop()
        if low >= high:
            continue
        # above the threshold per character, as each is charged with it
        _, a, b = _best_stretch(gains[:, low:high] - THRESHOLD)
        a, b = low + a, low + b
        if a >= b:
            continue
        if gains[:, a:b].sum(axis=1).max() >= STRONG and any(c.isalpha() for c in run[a:b]):
            if unlike_names(run[a:b], random, ordinary) and any(
                    x < b and a < y and unlike_names(run[x:y], random, ordinary) for x, y in parts):
                yield a, b
        elif b - a == high - low:
            continue
        free += [(low, a), (b, high)]


def _worth(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """The most that a pair of symbols can add to a run's or a stretch's ratio, at least 0."""
    most = np.maximum((random - ordinary[0]).max(axis=0), 0.0)
    most[_SEPARATORS] = np.maximum(most[_SEPARATORS], most[_N])
    return most


def _candidates(text: str, worth: np.ndarray) -> list[tuple[int, int]]:
    """The runs of symbols that could hold a secret: all others cannot reach the least sum."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODE[np.minimum(points, 127)], -1)
    inside = np.concatenate([[False], codes >= 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return []
    before = np.concatenate([[_N], codes[:-1]])
    before[starts] = _N
    total = np.concatenate([[0.0], np.cumsum(np.where(codes >= 0, worth[before, codes], 0.0))])
    least = min(STRONG, THRESHOLD * LEAST_LENGTH)
    some = total[ends] - total[starts] >= least - 1e-6
    return list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))


def random_runs(text: str, random: np.ndarray, ordinary: np.ndarray,
                worth: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans that look random: whole runs, parts or stretches of them; not plain numbers.

    A run or a part needs LEAST_LENGTH characters and a ratio above THRESHOLD a
    character; any stretch, however short, that ratio and STRONG nats.
    """
    found = []
    for low, high in _candidates(text, _worth(random, ordinary) if worth is None else worth):
        run = text[low:high]
        if not any(c.isalpha() for c in run):
            continue
        more = 0
        while more < 2 and text[high + more: high + more + 1] == "=":
            more += 1
        if len(run) >= LEAST_LENGTH and looks_random(run, random, ordinary):
            found.append((low, high + more))
        else:
            found += [(low + a, low + b + (more if b == len(run) else 0))
                      for a, b in _stretches(run, random, ordinary)]
    return sorted(found)


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        counts = np.zeros((3, _N + 1, _N), dtype=np.int64)
        for text in batch.column(0).to_pylist():
            marked = base_spans(text)
            # words inside a base match carry the other label
            words = [m.group() for m in _WORD.finditer(text)
                     if not any(a <= m.start() < b or a < m.end() <= b for a, _, b in marked)]
            mixed, upper = identifiers([w for w in words if _LETTERS.fullmatch(w)])
            for i, some in enumerate((words, mixed, upper)):
                counts[i] += bigrams(some)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])


def ordinary_model(documents: DataFrame, limit: int = TRAINING_DOCUMENTS) -> np.ndarray:
    """Transitions of ordinary words, of mixed-case and of upper-case identifiers made of them,
    from the ``limit`` documents with the least hash of their id."""
    some = documents.where("doc_id is not null and text is not null").select("doc_id").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("d"))
    sample = documents.where("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("d")).select("text")
    counts = np.zeros(3 * (_N + 1) * _N, dtype=np.int64)
    # at most one row per model and pair of symbols
    for r in sample.mapInArrow(_training_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    words, *named = counts.reshape(3, _N + 1, _N)
    # names hold words and abbreviations that the sample does not
    return np.stack([_log(words), *(np.log((1 - UNKNOWN) * np.exp(_log(c)) + UNKNOWN / _N) for c in named)])


_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("n_markov", T.LongType()),
])


def _find(random: np.ndarray, ordinary: np.ndarray):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*KINDS, "markov")
        worth = _worth(random, ordinary)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                more = [(a, 3, b) for a, b in random_runs(text, random, ordinary, worth)
                        if not any(a < y and x < b for x, _, y in base)]
                say = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
                rows.append((doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)),
                             hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more)), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=_RESULT.names)
    return find


def find_secrets(documents: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Secrets of every row of documents (doc_id, text).

    doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans
    (kind:start:end, code points, end exclusive, by start, then kind; kind
    "markov" for what the models add outside base spans), n_markov.

    Null and empty texts have none. Rows that repeat, or lack a doc_id, are
    scanned like others. Without text to train on, all ordinary transitions are
    equally likely. Further columns play no part; an empty table gives none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordinary = ordinary_model(docs, training_documents)
    return docs.mapInArrow(_find(random_models(), ordinary), _RESULT)
