"""Benchmark decontamination (op 8): one Aho-Corasick automaton over normalised test questions and answers.

Normalised: lower case, every run of characters that are neither letters nor digits is one space. The patterns are all
windows of ``window`` words of the benchmark's texts (a shorter text is one pattern, whole), so whole and partial leaks are both met. The automaton's symbols
are words (a character for each of the benchmark's vocabulary), so matches begin and end with words, and it has a node for a word instead of one for a character.
Each text is scanned once; hits of one item that overlap or touch are one span, and only texts with hits pay for the way back to offsets in the original.

``find`` reports every item, however short. ``drop`` goes by items of at least ``min_words`` words: an answer such as "four" is in texts that have nothing to do with it.

Defined cases: null or empty texts have no hits; null or empty items, or those without a word, give no patterns; items that share a window are both reported;
repeated rows are reported once each; an empty benchmark or table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import attach

WINDOW = 13
MIN_WORDS = 5
#: Words of patterns in an automaton that is sent to the executors (a node of some 60 bytes each at most; 600,000 words of benchmark text);
#: a benchmark beyond that is split by items, and texts are scanned for each part.
AUTOMATON_WORDS = 8_000_000

_GAP = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
OTHER = chr(0)
SCHEMA = "doc_id long, item_id long, start int, end int, matched string"
_cache: dict = {}


def normalise(text: str) -> str:
    """Words with one space between them and at both ends."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def _lower_map(text: str) -> tuple[str, list[int]]:
    """The lower-case text and the original index of each of its characters (a few characters become two)."""
    low = text.lower()
    if len(low) == len(text):
        return low, list(range(len(text) + 1))
    at: list[int] = []
    for i, c in enumerate(text):
        at.extend([i] * len(c.lower()))
    # A final sigma is the one context that lower() looks at; it keeps the length.
    return low, [*at, len(text)]


def offsets(text: str) -> list[tuple[int, int]]:
    """For each word of ``normalise(text)`` where it begins and ends in ``text``."""
    low, at = _lower_map(text)
    out, last = [], 0
    for m in _GAP.finditer(low):
        if m.start() > last:
            out.append((at[last], at[m.start() - 1] + 1))
        last = m.end()
    if last < len(low):
        out.append((at[last], at[len(low) - 1] + 1))
    return out


def patterns(items: list[tuple[int, str | None]], window: int = WINDOW, min_words: int = 1) -> dict[tuple[str, ...], list[int]]:
    """Windows of words and the items that hold them."""
    out: dict[tuple[str, ...], set[int]] = {}
    for item, text in items:
        words = normalise(text or "").split()
        if len(words) < max(1, min_words):
            continue
        for i in range(max(1, len(words) - window + 1)):
            out.setdefault(tuple(words[i : i + window]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def parts(items: list[tuple[int, str | None]], window: int, min_words: int, limit: int) -> list[list[tuple[tuple[str, ...], list[int]]]]:
    """Patterns in parts of about ``limit`` words. All windows of an item are in one part, so its spans come out whole."""
    out, mine, size = [], [], 0
    for item in sorted(items, key=lambda x: (x[0], x[1] or "")):
        grown = sum(map(len, patterns([item], window, min_words)))
        if mine and size + grown > limit:
            out.append(mine)
            mine, size = [], 0
        mine.append(item)
        size += grown
    return [list(x.items()) for x in (patterns(p, window, min_words) for p in [*out, mine]) if x]


def _symbol(i: int) -> str:
    """A character for the word of number ``i``; surrogates are left out. There are more of them than words in ``AUTOMATON_WORDS``' texts."""
    return chr(i + 1 if i < 0xD000 else i + 0x1000)


class Matcher:
    """The vocabulary of the patterns, a character for each word (``OTHER`` for all that aren't in it), and the automaton over those characters."""

    def __init__(self, known: list[tuple[tuple[str, ...], list[int]]]) -> None:
        self.vocab: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for words, items in known:
            self.automaton.add_word("".join(self.vocab.setdefault(w, _symbol(len(self.vocab))) for w in words), (len(words), items))
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, list[int]]]:
        """First word, end and items of each window found, by their ends."""
        if not self.vocab:
            return []
        words = "".join(map(self.vocab.get, _WORD.findall(text.lower()), repeat(OTHER)))
        return [(end + 1 - n, end + 1, items) for end, (n, items) in self.automaton.iter(words)]


def _matcher(shared) -> Matcher:
    key = getattr(shared, "_jbroadcast_id", id(shared))
    if key not in _cache:
        _cache.clear()
        _cache[key] = (Matcher(shared.value), shared)
    return _cache[key][0]


def hits(m: Matcher, text: str) -> list[tuple[int, int, int]]:
    """(item, start, end) in the original text, hits of an item that overlap or touch joined."""
    words = m.places(text)
    if not words:
        return []
    where = offsets(text)
    by: dict[int, list[list[int]]] = {}
    for lo, hi, items in words:
        for item in items:
            runs = by.setdefault(item, [])
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
                runs[-1][0] = min(lo, runs[-1][0])
            else:
                runs.append([lo, hi])
    return [(item, where[lo][0], where[hi - 1][1]) for item, runs in sorted(by.items()) for lo, hi in runs]


def _shared(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int, automaton_words: int) -> list:
    sc = attach(docs.sparkSession).sparkContext
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator()]
    return [sc.broadcast(p) for p in parts(items, window, min_words, automaton_words)]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = 1, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Every passage of ``docs`` that is in ``benchmark``: doc_id, item_id, start, end (characters of the original), matched.

    No shuffle. The patterns are sent to the executors in parts of ``automaton_words``; usually there is one.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    for shared in _shared(docs, benchmark, window, min_words, automaton_words):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared)
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0), b.column(1)):
                    text = text.as_py()
                    rows += [(doc.as_py(), item, lo, hi, text[lo:hi]) for item, lo, hi in hits(m, text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "start", "end", "matched"])

        out = out.unionByName(slim.mapInArrow(scan, SCHEMA))
    return out


def drop(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """The documents that hold no passage of the benchmark, all columns as they were. One scan, row by row: ids don't matter."""
    at = docs.columns.index("text")
    for shared in _shared(docs, benchmark, window, min_words, automaton_words):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared)
            for b in batches:
                yield b.filter(pa.array([not hits(m, t.as_py() or "") for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for ``find`` where doc_ids are unique: all windows joined."""
    parts = "regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')"
    return rf"""
WITH d AS (SELECT doc_id, {parts} AS p FROM documents WHERE text IS NOT NULL),
 x AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM d),
 o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS pos FROM x),
 g AS (SELECT doc_id, list(lower(piece) ORDER BY k) AS ws, list(pos ORDER BY k) AS ats, list(pos + length(piece) ORDER BY k) AS ends
       FROM o WHERE regexp_full_match(piece, '[\p{{L}}\p{{N}}]+') GROUP BY doc_id),
 b AS (SELECT item_id, list_transform(list_filter({parts}, lambda x: regexp_full_match(x, '[\p{{L}}\p{{N}}]+')), lambda x: lower(x)) AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
 q AS (SELECT DISTINCT item_id, least({window}, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - {window - 1}) + 1), lambda i: array_to_string(ws[i:i + {window - 1}], ' '))) AS w FROM b WHERE len(ws) > 0),
 l AS (SELECT DISTINCT n FROM q),
 v AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w, unnest(range(len(ws) - n + 1)) AS i,
       unnest(ats[1:len(ws) - n + 1]) AS lo, unnest(ends[n:len(ws)]) AS hi FROM g, l WHERE len(ws) >= n),
 m AS (SELECT doc_id, item_id, i, i + n AS j, lo, hi FROM v JOIN q USING (n, w)),
 s AS (SELECT *, CASE WHEN i > max(j) OVER (PARTITION BY doc_id, item_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM m),
 t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM s),
 r AS (SELECT doc_id, item_id, CAST(min(lo) AS INT) AS start, CAST(max(hi) AS INT) AS "end" FROM t GROUP BY doc_id, item_id, run)
SELECT r.*, substring(text, start + 1, "end" - start) AS matched FROM r JOIN documents USING (doc_id)"""
