"""Files that a tool wrote, a minifier squeezed, that come from third parties or only store data; the rest is hand-written.

1. Names: the character trigrams of the identifiers of each language are counted, each distinct name once a chunk, over all
   files that no path names. This gives, for each language, the cost of a name in bits a character and the usual way to join words.
2. Each chunk is measured: cross-entropy of its names and the share of very short ones; how diverse its name templates are
   (runs of four names, each as its shape) and how many of its compound names come once; how it joins words; how much is literal.
   The measures are sums, so a file's are those of its chunks; contents are never moved.
3. Names decide: mangled ones (costlier than usual, and short) are a minifier's, a few templates filled with ever new names
   a tool's, names joined in a way that is foreign to the language a third party's. Literals without names are data.
4. Header comments: which runs of two to four words mark such files is learned, not listed. Files that their path or, for generated ones, their
   names give away are the examples; a run is a marker if it stands in the headers of at least `LEAST_MARKED` of them and, with
   confidence, a share of `MARKER_SHARE` or more of the files that have it are examples. Files with a marker follow the examples.
   A header is all comments before the first line of code of a file's first chunk.

Defined results
- a chunk_id counts once, with its newest row; a file is (repository, file_path), both not null
- null, unknown or differently written languages: the language follows the extension; without one both are "other"
- null and blank contents measure nothing; such a file is judged by its path
- prose and configuration formats are judged by path and header only
- the first chunk is that of the lowest start_line (null ones last), of equal ones that of the lowest chunk_id
- texts, lines and names of any length are measured whole; further columns are never read; an empty table gives no rows
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

#: Extensions of code, with the language they stand for.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java",
    "go": "go", "rs": "rust", "rb": "ruby", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "php": "php", "swift": "swift",
    "kt": "kotlin", "scala": "scala", "css": "css",
}
_ORDER = sorted(set(LANGUAGES.values()))

#: Names and folders that conventions reserve for such files.
GENERATED_PATH = r"(?:^|/)(?:__generated__|generated|autogen|gen-src)/|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.pyi?$|\.g\.(?:cs|dart)$|\.[Dd]esigner\.(?:cs|vb)$"
MINIFIED_PATH = r"\.min\.(?:js|css|mjs)$|[-.]bundle\.(?:\w+\.)?(?:js|mjs|css)$"
VENDORED_PATH = r"(?:^|/)(?:vendor|vendors|third_party|third-party|thirdparty|external|deps|node_modules|bower_components|Pods|Carthage|site-packages|dist-packages)/"
#: Marks that generators publish for tools to look for.
PUBLISHED = re.compile(r"@generated\b|<auto-?generated|\bcode generated\b.*\bdo not edit\b", re.IGNORECASE)

#: What may stand before and between leading comments without being code.
_PREAMBLE = re.compile(r"^\ufeff?\s*(?:<\?php|<\?xml\b.*|<!DOCTYPE\b.*|<%|---|%YAML.*|@charset\b.*|([\"'])use strict\1;?|)\s*$", re.IGNORECASE)
#: Languages whose lines that begin with # are code, and those in which lines that begin with // or /* are no comments.
_HASH_IS_CODE = {"c", "cpp", "csharp", "css", "javascript", "typescript", "java", "go", "rust", "swift", "kotlin", "scala"}
_SLASH_IS_CODE = {"python", "ruby"}
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_SLASH_COMMENT, _HASH_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.DOTALL), re.compile(r"#[^\n]*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_DATA_LINE = re.compile(r"^[\s\[\]{}(),;+]*(?:(?:-?\d[\d.eExXa-fA-F_]*|0x[0-9a-fA-F]+|[\"'][A-Za-z0-9+/=\\x]{24,}[\"'])[\s\[\]{}(),;+\\]*)+$|^\s*[A-Za-z0-9+/=]{48,}\s*$")
_DIGITS = re.compile(r"\d+")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SAID = re.compile(r"[@<]?[^\W\d_]+|\d+")
_TINY, _RUN = 2, 4

#: How much costlier than usual (bits a character) mangled names are and how many are short; how diverse templates (entropy over its greatest value)
#: and how often unrepeated the compound names of generated files are; the least numbers of names that say anything.
COSTLIER, SHORT, DIVERSE, UNREPEATED, LEAST_NAMES, LEAST_KINDS = 0.25, 0.4, 0.75, 0.65, 20, 10
#: Examples a marker needs and the share of examples among the files that have it (lower limit at two standard errors).
LEAST_MARKED, MARKER_SHARE = 3, 0.1

_FEATURES = ["chars", "data_chars", "names", "tiny", "bits", "letters", "usual", "kinds", "once", "runs_bits", "runs_most", "snake", "camel", "published"]


def language_of(path: str, named: str | None) -> str:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ext in LANGUAGES:
        return LANGUAGES[ext]
    named = (named or "").strip().lower()
    return named if named in _ORDER else "other"


_ALPHABET = 29  # a boundary, a to z, the line below, a digit run
_CODE = np.zeros(256, np.int64)
_CODE[ord("a") : ord("z") + 1] = range(1, 27)
_CODE[ord("_")], _CODE[ord("0")] = 27, 28
_GRAMS = _ALPHABET**3


def _trigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the trigrams of all names, each name between two boundaries, and where those of each name begin."""
    text = "\n" + "\n".join(_DIGITS.sub("0", n) for n in names).lower() + "\n"
    x = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
    codes = (x[:-2] * _ALPHABET + x[1:-1]) * _ALPHABET + x[2:]
    inside = x[1:-1] != 0  # a boundary in the middle belongs to two names
    ends = np.flatnonzero(x == 0)
    starts = np.concatenate([[0], np.cumsum(inside)])[ends[:-1]]
    return codes[inside], starts


def _style(name: str) -> int:
    """1: words joined by lines below, -1: by capitals, 0: neither."""
    if "_" in name.strip("_") and name.islower():
        return 1
    return -1 if name[0].islower() and not name.islower() and "_" not in name else 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, code, n) of a batch; codes from _GRAMS on count the two styles."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for path, named, text in zip(*(c.to_pylist() for c in batch.columns)):
            lang = language_of(path, named)
            if text and lang != "other":
                found.setdefault(lang, Counter()).update(set(_NAME.findall(_STRING.sub('""', text))))
        for lang, names in found.items():
            each = list(names)
            times = np.fromiter(names.values(), np.int64, len(each))
            codes, starts = _trigrams(each)
            lengths = np.diff(np.append(starts, len(codes)))
            n = np.bincount(codes, np.repeat(times, lengths), _GRAMS + 2)
            style = np.fromiter(map(_style, each), np.int64, len(each))
            n[_GRAMS], n[_GRAMS + 1] = times[style == 1].sum(), times[style == -1].sum()
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], names=["lang", "code", "n"])


class Names:
    """For each language the bits of a trigram's last character given the two before, and what its names cost on average.

    A dense table of languages x 29^3 floats (1.6 MB) and two numbers a language, whatever the size of the collection.
    """

    def __init__(self, langs: np.ndarray, codes: np.ndarray, n: np.ndarray):
        counts = np.zeros((len(_ORDER), _GRAMS + 2))
        known = [(_ORDER.index(x), c, k) for x, c, k in zip(langs, codes, n)]
        for lang, c, k in known:
            counts[lang, c] = k
        grams = counts[:, :_GRAMS].reshape(len(_ORDER), -1, _ALPHABET)
        self.bits = -np.log2((grams + 0.1) / (grams.sum(2, keepdims=True) + 0.1 * _ALPHABET)).reshape(len(_ORDER), _GRAMS).astype(np.float32)
        self.usual = (counts[:, :_GRAMS] * self.bits).sum(1) / np.maximum(counts[:, :_GRAMS].sum(1), 1)
        self.styles = counts[:, _GRAMS:]

    def cost(self, lang: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits, characters) of each name."""
        codes, starts = _trigrams(names)
        bits = np.add.reduceat(self.bits[_ORDER.index(lang)][codes], starts)
        return bits.astype(np.float64), np.diff(np.append(starts, len(codes)))


def _leading(lines: list[str], lang: str) -> Iterator[str]:
    """The comment lines before the first line of code, without blank ones; text inside of block comments needs no mark."""
    closing, first, starred = "", True, lang != "other"
    for x in lines:
        said = x.strip().lstrip("\ufeff")
        if closing:
            yield said
            rest = said.partition(closing)[2] if closing in said else None
        elif lang not in _SLASH_IS_CODE and said.startswith(("/*", "<!--")):
            closing = "*/" if said.startswith("/*") else "-->"
            yield said
            rest = said.partition(closing)[2] if closing in said[2:] else None
        elif (
            lang not in _SLASH_IS_CODE and said.startswith("//")
            or lang not in _HASH_IS_CODE and said.startswith("#") and not said.startswith("#[")
            or said.startswith("#!") and first
            or lang == "other" and said.startswith(("--", ";")) and not said.startswith("---")
            or starred and (said == "*" or said.startswith(("* ", "*/")))  # the chunk begins inside a block
        ):
            starred = starred and said.startswith("*") and "*/" not in said
            yield said
            rest = None
        elif _PREAMBLE.match(x):
            rest = None
        else:
            return
        first, starred = False, starred and said.startswith("*")
        if rest is not None:
            closing = ""
            if rest.strip() and not rest.strip().startswith(("//", "/*")):
                return


class _Shapes(dict):
    """name → the number of its shape: words in lower case a, in capitals A, digits 0, repeats of a word once."""

    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        shape = re.sub(r"(Aa)+", "Aa", _DIGITS.sub("0", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", name))))
        self[name] = h = xxhash.xxh3_64_intdigest(shape)
        return h


_SHAPES = _Shapes()


def _runs(names: list[str]) -> tuple[float, float]:
    """(entropy, its greatest value), both times the number of runs of four name shapes."""
    n = len(names) - _RUN + 1
    if n < 2:
        return 0.0, 0.0
    h = np.fromiter(map(_SHAPES.__getitem__, names), np.uint64, len(names))
    x = np.zeros(n, np.uint64)
    for i in range(_RUN):
        x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    times = np.unique(x, return_counts=True)[1]
    return float(-(times * np.log2(times / n)).sum()), float(n * np.log2(n))


def header_runs(header: list[str]) -> list[int]:
    """The distinct runs of two to four words in header lines, hashed; numbers are all alike."""
    out = set()
    for line in header:
        words = ["0" if w[0].isdigit() else w for w in _SAID.findall(line.lower())]
        for n in (2, 3, 4):
            out.update(xxhash.xxh3_64_intdigest(" ".join(words[i : i + n])) - (1 << 63) for i in range(len(words) - n + 1))
    return list(out)


def measure(model: Names, lang: str, text: str | None) -> tuple[list[float], list[int]]:
    """The features of one chunk, in the order of _FEATURES, all of which add up over chunks, and the runs of its header."""
    out = dict.fromkeys(_FEATURES, 0.0)
    if not text or not text.strip():
        return list(out.values()), []
    lines = [x for x in text.split("\n") if x.strip()]
    header = list(_leading(lines, lang))
    out["published"] = float(any(PUBLISHED.search(x) for x in header))
    if lang == "other":
        return list(out.values()), header_runs(header)
    for x in lines:
        out["chars"] += len(x)
        if _DATA_LINE.match(x):
            out["data_chars"] += len(x)
    bare = _STRING.sub('""', text)
    found = _NAME.findall((_HASH_COMMENT if lang in _SLASH_IS_CODE else _SLASH_COMMENT).sub("", bare))
    if found:
        names = Counter(found)
        each, times = list(names), np.fromiter(names.values(), np.int64, len(names))
        bits, letters = model.cost(lang, each)
        out["names"] = float(len(found))
        out["tiny"] = float(sum(n for name, n in names.items() if len(name) <= _TINY))
        out["bits"], out["letters"] = float((bits * times).sum()), float((letters * times).sum())
        out["usual"] = float(model.usual[_ORDER.index(lang)] * out["letters"])
        several = [n for name, n in names.items() if len(_HUMPS.findall(name)) > 1]
        out["kinds"], out["once"] = float(len(several)), float(several.count(1))
        out["runs_bits"], out["runs_most"] = _runs(found)
        style = np.fromiter(map(_style, each), np.int64, len(each))
        out["snake"], out["camel"] = float(times[style == 1].sum()), float(times[style == -1].sum())
    return list(out.values()), header_runs(header)


def _measures(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value
        for batch in batches:
            rows, langs, runs = [], [], []
            for path, named, text in zip(*(c.to_pylist() for c in batch.columns[4:])):
                lang = language_of(path, named)
                features, said = measure(names, lang, text)
                langs.append(lang)
                rows.append(features)
                runs.append(said)
            cols = list(zip(*rows)) if rows else [[]] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.int64())), *(pa.array(c, pa.float64()) for c in cols)],
                names=["repository", "chunk_id", "created_at", "start_line", "file_path", "lang", "runs", *_FEATURES],
            )

    return run


def name_models(rows: DataFrame) -> Names:
    """The models of all files that no path names; the driver gets languages x 29^3 counts at most."""
    plain = rows.where(~F.col("file_path").rlike(f"{GENERATED_PATH}|{MINIFIED_PATH}|{VENDORED_PATH}"))
    counts = plain.select("file_path", "prog_lang", "content").mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    return Names(*(counts[c].to_numpy() for c in ("lang", "code", "n")))


def file_measures(chunks: DataFrame) -> tuple[DataFrame, Names]:
    """A row for each file: the sums of its chunks' measures and the runs of words in its header; and the models."""
    rows = chunks.where("repository is not null and file_path is not null and chunk_id is not null")
    model = name_models(rows)
    kind = dict(rows.dtypes)["created_at"]
    schema = f"repository string, chunk_id string, created_at {kind}, start_line int, file_path string, lang string, runs array<long>, " + ", ".join(f"{f} double" for f in _FEATURES)
    columns = ["repository", "chunk_id", "created_at", F.col("start_line").cast("int"), "file_path", "prog_lang", "content"]
    each = rows.select(*columns).mapInArrow(_measures(rows.sparkSession.sparkContext.broadcast(model)), schema)
    values = F.struct("start_line", "lang", "runs", *_FEATURES)
    newest = each.groupBy("repository", "file_path", "chunk_id").agg(F.max_by(values, F.struct("created_at", values)).alias("m"))
    place = F.struct(F.col("m.start_line").isNull(), F.col("m.start_line"), F.col("chunk_id"))
    sums = (F.sum(f"m.{f}").alias(f) for f in _FEATURES)
    return newest.groupBy("repository", "file_path").agg(F.min_by("m.lang", place).alias("lang"), F.min_by("m.runs", place).alias("runs"), *sums), model


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _foreign(model: Names) -> Column:
    """Names joined in the way that nine of ten names of the language aren't."""
    snake, camel = model.styles[:, 0], model.styles[:, 1]
    of = lambda mostly: [x for x, a, b in zip(_ORDER, snake, camel) if (a > 9 * b if mostly == "snake" else b > 9 * a)]
    lang, enough = F.col("lang"), F.col("snake") + F.col("camel") >= 12
    return enough & ((lang.isin(*of("snake")) & (F.col("camel") > 3 * F.col("snake"))) | (lang.isin(*of("camel")) & (F.col("snake") > 3 * F.col("camel"))))


def evidence(files: DataFrame, model: Names) -> DataFrame:
    """files with what path and names say of each, each alone; boolean columns."""
    path = F.col("file_path")
    return files.withColumns(
        {
            "path_vendored": path.rlike(VENDORED_PATH),
            "path_minified": path.rlike(MINIFIED_PATH),
            "path_generated": path.rlike(GENERATED_PATH),
            "mangled": (F.col("names") >= LEAST_NAMES) & (_share("bits", "letters") > _share("usual", "letters") + COSTLIER) & (_share("tiny", "names") > SHORT),
            "templated": (F.col("kinds") >= LEAST_KINDS) & (_share("once", "kinds") >= UNREPEATED) & (_share("runs_bits", "runs_most") < DIVERSE),
            "foreign": _foreign(model),
            "literal": (F.col("chars") >= 200) & (_share("data_chars", "chars") >= 0.75),
        }
    )


def learned_markers(files: DataFrame) -> DataFrame:
    """(run, vendored, generated): the runs of header words that mark one of the two, learned from the files that path or names give away."""
    vendored = F.col("path_vendored")
    generated = ~vendored & ~F.col("path_minified") & ~F.col("mangled") & (F.col("path_generated") | F.col("templated"))
    each = files.select(F.explode("runs").alias("run"), vendored.cast("int").alias("v"), generated.cast("int").alias("g"))
    counts = each.groupBy("run").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("g").alias("g")).where((F.col("v") >= LEAST_MARKED) | (F.col("g") >= LEAST_MARKED))

    def sure(hits: str) -> Column:
        n, p, z = F.col("n"), F.col(hits) / F.col("n"), 2.0
        low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return (F.col(hits) >= LEAST_MARKED) & (low >= MARKER_SHARE)

    return counts.select("run", sure("v").alias("vendored"), sure("g").alias("generated")).where("vendored or generated")


def judged_files(chunks: DataFrame) -> DataFrame:
    """The evidence on each file and its kind: generated, minified, vendored, data or handwritten."""
    measured, model = file_measures(chunks)
    files = written(evidence(measured, model), "files")
    marked = files.select("repository", "file_path", F.explode("runs").alias("run")).join(learned_markers(files), "run")
    marks = marked.groupBy("repository", "file_path").agg(F.bool_or("vendored").alias("says_vendored"), F.bool_or("generated").alias("says_generated"))
    f = files.drop("runs").join(marks, ["repository", "file_path"], "left").na.fill(False, ["says_vendored", "says_generated"])
    f = f.withColumn("says_generated", F.col("says_generated") | (F.col("published") > 0))
    kind = (
        F.when(F.col("path_vendored"), "vendored")
        .when(F.col("path_minified") | F.col("mangled"), "minified")
        .when(F.col("path_generated") | F.col("templated"), "generated")
        .when(F.col("literal"), "data")
        .when(F.col("says_vendored") & ~F.col("published").cast("boolean"), "vendored")
        .when(F.col("says_generated"), "generated")
        .when(F.col("foreign"), "vendored")
        .otherwise("handwritten")
    )
    return f.withColumn("kind", kind)


def classified_files(chunks: DataFrame) -> DataFrame:
    """(repository, file_path, kind): kind is generated, minified, vendored, data or handwritten."""
    return judged_files(chunks).select("repository", "file_path", "kind")


def not_handwritten(chunks: DataFrame) -> DataFrame:
    return classified_files(chunks).where("kind <> 'handwritten'").select("repository", "file_path")
