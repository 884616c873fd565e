"""Texts that were decoded with the wrong encoding: which, by what chain, and the original where it can be had back.

1. A sample of different texts, about `SAMPLE` at any size, gives words with characters beyond ASCII and how many texts have
   them; `WORDS` of the most common, of up to `LONGEST` characters, are garbled by every chain in `CHAINS`. Only they come to the driver.
2. A multinomial classifier is fitted on hashed byte bigrams of these words, one class for each chain and one for clean text.
   Words of the sample that it finds garbled leave the clean class, and it is fitted again.
3. In every text each word is given its most likely class. A chain counts for a text by the sum of how much likelier than
   clean text it makes the words it is the best for.
4. The chain is turned round, strictly: each run of characters must encode in the wrong encoding and decode in the right
   one, and the result must itself be likelier as clean text. What doesn't is left as it is and marked as lost.

Words are cut at ASCII white space and control characters only, as white space beyond ASCII is what some garbled bytes become.
U+FFFD in a word stands for bytes that are lost; such a text is found, and restored where other words can be.

Defined results
- null, empty, blank and ASCII texts: not found
- copies of a text are found with it; a repeated doc_id counts once
- texts of any length are read whole, words of any length in full
- a text garbled by two chains in different places gets the stronger one first, then the other, on what is left
- further columns are dropped; an empty table, or one without any text beyond ASCII, gives no rows
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, WORDS, LONGEST, BUCKETS, SMOOTH = 1500, 4000, 64, 1 << 15, 0.01
#: Of the words of the sample beyond `WORDS`, so many more are kept to tell garbled forms of common words.
_SEEN = 50_000
#: How much likelier than clean text (natural logarithms) a chain must make a word, and the different words of a text
#: together; less is asked where the chain's inverse is checked by UTF-8, which other text hardly ever is by chance.
WORD_GAIN, TEXT_GAIN, UTF8_GAIN, ALONE_GAIN, BETTER, KNOWN = 2.0, 9.0, 5.0, 9.0, 0.3, 4
_EDGE = ".,:;!?()[]{}\"'`*_-|<>"

_WORD = re.compile("[^\x00-\x20]+")
_RUN = re.compile("[^\x00-\x7f]+")
_PIECE = 32

_INTO = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850", "cp1250", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1253")
_SINGLE = [
    *((a, b) for a in ("cp1252", "mac_roman", "cp437", "cp850") for b in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251") if a != b),
    *((a, b) for a in ("cp1250", "iso8859-2") for b in ("cp1250", "iso8859-2", "cp1252", "latin-1", "mac_roman", "cp437", "cp1251") if a != b),
    *((a, b) for a in ("cp1251", "koi8-r", "cp866") for b in ("cp1251", "koi8-r", "cp866", "cp1252", "latin-1", "mac_roman", "cp437") if a != b),
    *((a, b) for a in ("cp1253",) for b in ("cp1252", "mac_roman", "cp437", "cp1251")),
]
_WIDE = [(a, b) for a in ("gbk", "shift_jis", "euc_jp") for b in ("cp1252", "latin-1", "cp1251", "mac_roman")] + [("utf-8", b) for b in ("gbk", "shift_jis")]
#: (right, wrong, times): text of `right` read as `wrong`, that many times over.
CHAINS = [("utf-8", b, 1) for b in _INTO] + [("utf-8", b, 2) for b in ("cp1252", "latin-1")] + [(a, b, 1) for a, b in [*_SINGLE, *_WIDE]]

_TABLES: dict[str, tuple[dict[int, str], dict[int, int]]] = {}
_MULTI = {"gbk", "big5", "shift_jis", "euc_jp", "utf-8"}


def _table(name: str) -> tuple[dict[int, str], dict[int, int]]:
    """byte → character and back for a single-byte encoding; bytes it leaves open stand for the control characters of their number, as browsers read them."""
    if name not in _TABLES:
        there = {b: bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)}
        _TABLES[name] = there, {ord(c): b for b, c in there.items()}
    return _TABLES[name]


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    right, wrong, times = chain
    for _ in range(times):
        try:
            data = text.encode(right)
        except UnicodeEncodeError:
            return None
        text = data.decode(wrong, "replace") if wrong in _MULTI else "".join(map(_table(wrong)[0].__getitem__, data))
    return text


def invert(text: str, chain: tuple[str, str, int]) -> str | None:
    """What text was before chain; None unless every step is exact."""
    right, wrong, times = chain
    for _ in range(times):
        try:
            if wrong in _MULTI:
                data = text.encode(wrong)
            else:
                back = _table(wrong)[1]
                data = bytes([back[ord(c)] for c in text])
            text = data.decode(right)
        except (KeyError, UnicodeError):
            return None
    return text


def _features(word: str) -> np.ndarray:
    """Hashed byte bigrams with a byte beyond ASCII, and the word as one more feature."""
    b = np.frombuffer(b" " + word.encode("utf-8", "replace") + b" ", np.uint8).astype(np.int64)
    wide = (b[:-1] >= 0x80) | (b[1:] >= 0x80)
    pair = (b[:-1] << 8 | b[1:])[wide]
    out = np.empty(len(pair) + 1, np.int64)
    out[:-1] = (pair * 0x9E3779B1 >> 7) % BUCKETS
    out[-1] = zlib.crc32(word.strip(_EDGE).encode("utf-8", "replace")) % BUCKETS
    return out


def _pieces(word: str) -> list[str]:
    """A long word in parts of bounded length, each with some character beyond ASCII."""
    if len(word) <= _PIECE:
        return [word]
    return [p for i in range(0, len(word), _PIECE) if not (p := word[i : i + _PIECE]).isascii()]


def words_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if not w.isascii()]


class Classifier:
    """log P(feature | class); class 0 is clean text, class i the chain i - 1. known: words of the sample that are clean."""

    def __init__(self, table: np.ndarray, chains: list[tuple[str, str, int]], known: set[str]):
        self.table, self.chains, self.known = table, chains, known
        self._known: dict[str, list[tuple[int, float]]] = {}
        self.seen: dict[str, tuple[int, float, str | None]] = {}
        self._clean_column, self._clean = np.ascontiguousarray(table[:, 0]), {}

    def knows(self, word: str) -> bool:
        word = word.strip(_EDGE)
        return word in self.known or word.lower() in self.known or word.capitalize() in self.known

    def clean(self, word: str) -> float:
        """log likelihood of a word as clean text, a feature."""
        if word not in self._clean:
            if len(self._clean) > 300_000:
                self._clean.clear()
            features = _features(word)
            self._clean[word] = float(self._clean_column[features].sum()) / len(features)
        return self._clean[word]

    def scores(self, words: list[str]) -> np.ndarray:
        """log likelihood of each word under each class."""
        grams = [_features(w) for w in words]
        if not grams:
            return np.zeros((0, self.table.shape[1]), np.float32)
        at = np.concatenate([[0], np.cumsum([len(g) for g in grams])[:-1]])
        return np.add.reduceat(self.table[np.concatenate(grams)], at, 0)

    def best(self, words: list[str]) -> list[list[tuple[int, float]]]:
        """(chain, gain over clean text) of each word's likeliest chains, best first, as far as they are likelier than clean text."""
        new = [w for w in dict.fromkeys(words) if w not in self._known]
        if len(self._known) > 300_000:
            self._known.clear()
            new = list(dict.fromkeys(words))
        pieces = [(i, p) for i, w in enumerate(new) for p in _pieces(w)]
        for lo in range(0, len(pieces), 4000):
            part = pieces[lo : lo + 4000]
            gain = self.scores([p for _, p in part])
            gain -= gain[:, :1]
            if lo == 0:
                total = np.zeros((len(new), gain.shape[1]), np.float32)
            np.add.at(total, [i for i, _ in part], gain)
        if new:
            likely = total > 0
            likely[:, 0] = False
            for w, row, gains in zip(new, likely, total):
                at = np.flatnonzero(row)
                self._known[w] = [(int(c) - 1, float(gains[c])) for c in at[np.argsort(-gains[at], kind="stable")]]
        return [self._known[w] for w in words]


class _Garbled:
    """The features of all words under one chain (None: as they are), so that counts for other weights are one sum."""

    def __init__(self, words: list[str], chain: tuple[str, str, int] | None):
        parts, of = [], []
        for i, w in enumerate(words):
            g = w if chain is None else garble(w, chain)
            if g is None or "\ufffd" in g or (chain is not None and g == w):
                continue
            for p in _pieces(g):
                parts.append(_features(p))
                of.append(i)
        self.grams = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.of = np.repeat(of, [len(x) for x in parts]).astype(np.int64)

    def count(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.grams, weights[self.of], BUCKETS)


def sampled_words(text: str) -> list[str]:
    """The different words of a text that a classifier can be fitted on."""
    return [w for w in dict.fromkeys(words_of(text)) if len(w) <= LONGEST and "\ufffd" not in w]


def train(texts: list[str]) -> Classifier | None:
    """The classifier of a sample of texts, most of them clean; equal texts count once."""
    return fitted(Counter(w for t in dict.fromkeys(texts) for w in sampled_words(t)))


def fitted(seen: Counter) -> Classifier | None:
    """The classifier of words with the number of texts that have them."""
    words = sorted(seen, key=lambda w: (-seen[w], w))[:WORDS]
    if not words:
        return None
    weights = np.array([0 if _copy_of_known(w, seen) else seen[w] for w in words], float)
    classes = [(c, _Garbled(words, c)) for c in [None, *CHAINS]]
    classes = [(c, g) for c, g in classes if c is None or len(g.grams)]
    written = [_Garbled([f(w) for w in words], None) for f in (str.upper, str.lower, str.capitalize)]
    for _ in range(3):
        counts = np.stack([g.count(weights) for _, g in classes], 1)
        counts[:, 0] += sum(g.count(0.1 * weights) for g in written)  # other ways to write the same words are clean too
        table = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)
        known: dict[str, float] = {}
        for w, n in zip(words, weights):
            known[w.strip(_EDGE)] = known.get(w.strip(_EDGE), 0) + n
        model = Classifier(table, [c for c, _ in classes[1:]], {w for w, n in known.items() if n >= KNOWN})
        bad = [i for i, (w, chains) in enumerate(zip(words, model.best(words))) if weights[i] and chains and _evidence(model, w, chains)[1] >= TEXT_GAIN]
        if not bad:
            break
        weights[bad] = 0
    return model


def _copy_of_known(word: str, seen: Counter) -> bool:
    """Whether UTF-8 shows beyond doubt that the word is a garbled form of one far more common in the sample."""
    for right, wrong, times in CHAINS:
        if right == "utf-8" and (before := invert(word, (right, wrong, times))) and before != word and seen[before] >= 5 * seen[word]:
            return True
    return False


_TOGETHER = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA"}


def _normal(text: str) -> bool:
    """Two letters or more, written in one alphabet and as words are: lower case, capitals, or one capital first."""
    letters = [c for c in text if c.isalpha()]
    word = "".join(letters)
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in letters}
    return len(letters) >= 2 and (len(scripts) == 1 or scripts <= _TOGETHER) and (word.islower() or word.isupper() or word[1:].islower() or not any(c.isupper() or c.islower() for c in letters))


def _evidence(model: Classifier, word: str, chains: list[tuple[int, float]]) -> tuple[int, float, str | None]:
    """(chain, what the word says for it, the word before it) of the likeliest chain whose inverse is exact and plausible, else of the one with most to say."""
    if word not in model.seen:
        if len(model.seen) > 300_000:
            model.seen.clear()
        most = None
        for c, gain in chains:  # likeliest first; the first that fits decides, so the others needn't be turned round
            e = (c, *_says(model, word, c, gain))
            if e[2] is not None and e[1] > 0:
                most = e
                break
            if most is None or e[1] > most[1]:
                most = e
        model.seen[word] = most
    return model.seen[word]


def _says(model: Classifier, word: str, chain: int, gain: float) -> tuple[float, str | None]:
    utf8, known = model.chains[chain][0] == "utf-8", model.knows(word)
    if known and not utf8:
        return 0.0, None
    before = _restored(model, word, chain)
    if before is None:
        return (gain if utf8 and not known else 0.0), None
    if model.knows(before) and (utf8 or sum(c.isalpha() for c in before) >= 2) and (utf8 or not known):
        return gain + (8.0 if utf8 else 5.0), before
    if known or not (utf8 or _normal(before)):
        return 0.0, None
    return gain if utf8 else min(gain, max(6.0, 1.5 * sum(c.isalpha() for c in before))), before


def _restored(model: Classifier, word: str, chain: int) -> str | None:
    """word before the chain, if that is exact and likelier as clean text than word, feature by feature."""
    before = invert(word, model.chains[chain])
    if before is None or before == word or any("\x80" <= c <= "\x9f" for c in before):
        return None
    if before.isascii() or model.knows(before):
        return before
    return before if model.clean(before) > model.clean(word) + BETTER else None


def repair(model: Classifier, text: str, words: list[str] | None = None) -> tuple[str, str | None, bool] | None:
    """(chain, text with what could be restored, whether all could) of a garbled text; None of a clean one."""
    words = words_of(text) if words is None else words
    if not words:
        return None
    different = list(dict.fromkeys(w for w in words if "\ufffd" not in w))
    lost = any("\ufffd" in w for w in words)
    votes: dict[int, float] = {}
    hits: dict[int, dict[str, str | None]] = {}
    for w, chains in zip(different, model.best(different)):
        if chains:
            c, says, before = _evidence(model, w, chains)
            if says > WORD_GAIN:
                votes[c] = votes.get(c, 0.0) + says
                hits.setdefault(c, {})[w] = before
    changed, open_, name = {}, set(), ""
    for c in sorted(votes, key=lambda k: -votes[k]):
        chain = model.chains[c]
        utf8 = chain[0] == "utf-8"
        good = {w: b for w, b in hits[c].items() if b is not None}
        rest = [w for w, b in hits[c].items() if b is None]
        if votes[c] < ((UTF8_GAIN if good else ALONE_GAIN) if utf8 else TEXT_GAIN):
            continue
        if rest:
            good |= {w: p for w in rest if (p := _partly(w, chain)) != w}
            open_ |= set(rest)
        if good:
            changed |= good
            name = name or ">".join(chain[:2]) + (" twice" if chain[2] == 2 else "")
    if not name and not lost:
        return None
    restored = _WORD.sub(lambda m: changed.get(m.group(), m.group()), text) if changed else None
    return name or "lost", restored, not lost and not open_


def _partly(word: str, chain: tuple[str, str, int]) -> str:
    """word with those of its runs turned back that can be."""
    return _RUN.sub(lambda m: invert(m.group(), chain) or m.group(), word)


def _run(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        classifier = Classifier(m.table, m.chains, m.known)
        for batch in batches:
            keys, found = [], []
            texts = batch.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            classifier.best([w for ws in words for w in ws])  # the batch's words at once
            for key, text, ws in zip(batch.column(0).to_pylist(), texts, words):
                if (r := repair(classifier, text, ws)) is not None:
                    keys.append(key)
                    found.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "chain", "restored", "whole"])

    return run


def _split_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(w for t in batch.column(0).to_pylist() for w in sampled_words(t))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def common_words(rows: DataFrame, sample: int) -> Counter:
    """The words of about `sample` different texts, with how many of these have them; `_SEEN` words of bounded length at most.

    Texts are chosen by their hash, so copies count once and no more than the chosen ones are moved.
    """
    h = F.xxhash64("text")
    different = rows.agg(F.approx_count_distinct(h).alias("n")).first().n
    chosen = rows.where(F.pmod(h, F.lit(max(1, different // max(1, sample)))) == 0).groupBy(h.alias("h")).agg(F.first("text").alias("text"))
    counts = chosen.select("text").mapInArrow(_split_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(_SEEN).toArrow()
    return Counter(dict(zip(found["word"].to_pylist(), found["n"].to_pylist())))


def garbled_documents(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, chain, restored, whole) of each garbled document; restored is null where nothing can be had back."""
    spark = documents.sparkSession
    wide = F.octet_length("text") > F.char_length("text")
    rows = documents.where(F.col("doc_id").isNotNull() & wide).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fitted(common_words(rows, sample))
    if model is None:
        return spark.createDataFrame([], "doc_id long, chain string, restored string, whole boolean")
    found = rows.mapInArrow(_run(spark.sparkContext.broadcast(Classifier(model.table, model.chains, model.known))), "doc_id long, chain string, restored string, whole boolean")
    return found.dropDuplicates(["doc_id"])
