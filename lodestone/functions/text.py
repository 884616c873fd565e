"""Column functions on text: token estimates, normal forms, identifiers, Markdown. All of them stay in the JVM.

Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little in an identifier.
SYNTAX_WORDS = [
    "a", "an", "and", "as", "by", "class", "def", "else", "for", "from", "function", "if", "import", "in", "is", "method", "module", "not",
    "of", "or", "private", "protected", "public", "return", "self", "static", "the", "this", "while",
]
PATH_WORDS = ["app", "backend", "build", "dist", "docs", "doc", "lib", "main", "src", "spec", "test", "tests"]
WEAK_WORDS = [
    "api", "backend", "boolean", "change", "code", "count", "date", "false", "logic", "model", "module", "modified", "new", "number",
    "string", "true", "update", "value", "values",
]

SPACE = "[\\t-\\r ]"


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1 where there is text; 0 for empty and null."""
    n = F.char_length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.lit(0))


def available_tokens(window: int, prompt: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(window) - estimate_tokens(prompt))


def fits(text: Column, window: int) -> Column:
    return estimate_tokens(text) <= window


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.substring(text, 1, 4 * limit)


def normalize_space(text: Column) -> Column:
    """Runs of ASCII white space become one blank; none at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def search_terms(text: Column) -> Column:
    """The words a lexical index holds: runs of ASCII letters, digits and _, lower case, in order and with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


def identifier_words(name: Column) -> Column:
    """foo_barBaz.HTTPServer -> [foo, bar, baz, http, server]."""
    s = F.regexp_replace(name, "[^0-9A-Za-z]+", " ")
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), " +"), lambda x: x != "")


def keyword_forms(name: Column) -> Column:
    """The words with blanks and without, once if that is the same."""
    words = identifier_words(name)
    return F.filter(F.array_distinct(F.array(F.array_join(words, " "), F.array_join(words, ""))), lambda x: x != "")


def telling_words(name: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in sorted({*SYNTAX_WORDS, *PATH_WORDS, *WEAK_WORDS})))
    return F.filter(identifier_words(name), lambda x: (F.char_length(x) > 1) & ~F.array_contains(stop, x))


def phrases(words: Column, longest: int = 3) -> Column:
    """All runs of 1 to `longest` words, short ones first, each once."""

    def runs(size: int) -> Column:
        last = F.size(words) - size + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, size), " "))

    return F.array_distinct(F.concat(*(runs(s) for s in range(1, longest + 1))))


def listed(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"; empty for none."""
    n = F.size(items)
    return (
        F.when(n <= 1, F.array_join(items, ""))
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_\\-]", "_")


def document_id(path: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(path, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def document_path(identifier: Column) -> Column:
    padded = F.concat(F.translate(identifier, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(identifier), F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def branch(ref: Column) -> Column:
    return F.regexp_replace(ref, "^refs/heads/", "")


def fence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^```"))


def empty_headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^#{1,6}[\\t ]*$"))


def tidy_markdown(text: Column) -> Column:
    """Unix line ends, no white space at line ends, at most one blank line in a row, and an even number of fences."""
    t = F.regexp_replace(unix_lines(text), "(?m)[\\t ]+$", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.when(fence_count(t) % 2 == 1, F.concat(t, F.lit("\n```"))).otherwise(t)


def without_thoughts(text: Column) -> Column:
    """Drops <think>...</think>; with only an opening tag what follows it is dropped too."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "(?s)<think>.*$", "")


def requirement_name(line: Column) -> Column:
    """The package of a requirements line; null for comments, options and blank lines."""
    name = F.trim(F.split(line, "==|>=|<=|!=|~=|>|<|\\[")[0])
    return F.when((name != "") & ~name.rlike("^[#-]"), name)


def unfenced(text: Column) -> Column:
    """What stands in the first ``` block, or the text itself."""
    inner = F.regexp_extract(text, "(?s)```[A-Za-z]*\\s*\\n(.*?)\\n?```", 1)
    return F.when(inner != "", inner).otherwise(text)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def local_date(stamp: Column) -> Column:
    """The date written in an ISO time stamp, in its own zone."""
    return F.regexp_extract(stamp, "^(\\d{4}-\\d{2}-\\d{2})", 1)


def local_time(stamp: Column) -> Column:
    return F.regexp_extract(stamp, "T(\\d{2}:\\d{2}:\\d{2})", 1)
