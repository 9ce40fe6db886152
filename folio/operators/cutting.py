"""Texts of a corpus cut into tokens, an Arrow batch at a time: what an index build does with every text.

The rules are those of ``functions.text.word_tokens`` and ``functions.excerpt.with_layout``, which stay for texts that are few; tests
compare the two. The code points of some texts at once are looked up in a table of classes, and tokens are where the class changes.
The table is asked of Spark's regular expressions, so that both know the same letters; texts come lower-cased by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from folio.functions.excerpt import LAYOUT
from folio.functions.porter import Stemmer
from folio.functions.text import FOLD_FROM, FOLD_TO, MARKS, TOKEN_PATTERN

#: Characters cut at once; a longer text is cut alone.
CHARS = 1 << 22
#: Line ends that a ``$`` may stand before and that are no blank of ``BLANKS``.
LINE_ENDS, BLANKS, STOPS = "\u0085\u2028\u2029", " \t\n\r", ".:"

INTS = ArrayType(IntegerType())
_TABLES: dict[str, bytes] = {}


def letters(spark: SparkSession) -> bytes:
    """A bit for each code point, set where it may stand in a token. Asked once an application, of a fixed size."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        rows = spark.range(0, 0x110000, 1, 8).where("id not between 55296 and 57343").where(point.rlike(f"^{TOKEN_PATTERN}$"))
        rows = rows.groupBy(F.expr("id div 32").alias("at")).agg(F.sum(F.expr("shiftleft(1L, int(id % 32))")).alias("bits"))
        words = np.zeros(0x110000 // 32, "<u4")
        for r in rows.collect():
            words[r["at"]] = r["bits"]
        _TABLES[key] = words.tobytes()
    return _TABLES[key]


def _flags(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool)


def _set(chars: str) -> np.ndarray:
    flags = np.zeros(0x110000, bool)
    flags[[ord(c) for c in chars]] = True
    return flags


def _texts(column: pa.Array) -> list[str | None]:
    return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _parts(*columns: list[str | None]) -> Iterator[slice]:
    """Slices of rows whose texts have up to ``CHARS`` characters."""
    start, size = 0, 0
    for i, row in enumerate(zip(*columns)):
        n = sum(len(t) for t in row if t)
        if size and size + n > CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if columns[0]:
        yield slice(start, len(columns[0]))


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one of no class after each, and where each text starts (one more: the end)."""
    points = np.frombuffer("".join(t + "\0" if t else "\0" for t in texts).encode("utf-32-le"), "<i4")
    return points, np.cumsum([0, *(len(t) + 1 if t else 1 for t in texts)])


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _lists(offsets: np.ndarray, values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=None if null is None else pa.array(null))


class Cutter:
    def __init__(self, table: bytes):
        self.letter, self.mark = _flags(table), _set(MARKS)
        self.raw, self.blank, self.stop, self.line_end = self.letter | self.mark, _set(BLANKS), _set(STOPS), _set(LINE_ENDS)
        self.fold = np.arange(0x110000, dtype="<i4")
        self.fold[[ord(c) for c in MARKS]] = -1
        self.fold[[ord(c) for c in FOLD_FROM[:len(FOLD_TO)]]] = [ord(c) for c in FOLD_TO]

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased texts: folded code points, starts and ends of the tokens, and the text each is of."""
        points, starts = _points(texts)
        points = self.fold[points]
        kept = points >= 0
        if not kept.all():
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            points = points[kept]
        s, e = _runs(self.letter[points])
        return points, s, e, np.searchsorted(starts, s, "right") - 1

    def layout(self, texts: list[str | None]) -> list[pa.Array]:
        """``LAYOUT`` of the texts as they stand."""
        points, starts = _points(texts)
        letter = self.letter[points]
        s, e = _runs(self.raw[points])
        odd = ~letter[s]  # marks before the first letter are none of its token's
        if odd.any():
            where = np.append(np.flatnonzero(letter), len(points))
            s[odd] = where[np.searchsorted(where, s[odd])]
            s, e = s[s < e], e[s < e]
        n = len(texts)
        firsts = np.searchsorted(s, starts)  # tokens before each text
        # A text of k tokens has k + 1 gaps: from its start or a token's end to the next token's start or its end.
        heads, tails = firsts[:-1] + np.arange(n), firsts[1:] + np.arange(n)
        inner = np.ones(len(s) + n, bool)
        inner[heads] = False
        begin, end = np.empty(len(s) + n, np.int64), np.empty(len(s) + n, np.int64)
        begin[heads], begin[inner] = starts[:-1], e
        inner[:] = True
        inner[tails] = False
        end[tails], end[inner] = starts[1:] - 1, s
        # A stop, blanks, and then the gap's end or one line end before it.
        bound = end - ((end > begin) & self.line_end[points[np.maximum(end - 1, 0)]])
        solid = np.maximum.accumulate(np.where(self.blank[points], -1, np.arange(len(points))))
        last = np.where(bound > begin, solid[np.maximum(bound - 1, 0)], -1)
        opens = (last >= begin) & (last < bound - 1) & self.stop[points[np.maximum(last, 0)]]
        opens[heads] = True
        at = np.flatnonzero(opens)
        offsets = np.append(heads, len(s) + n)
        null = np.array([t is None for t in texts], bool)
        sentences = (at - heads[np.searchsorted(heads, at, "right") - 1])
        return [_lists(firsts, e - s, null), _lists(offsets, end - begin, null), _lists(np.searchsorted(at, offsets), sentences, null)]

    def places(self, texts: list[str | None], stemmer: Stemmer | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Each distinct token, or stem, of a text once: the text, the distinct tokens and the number of the token among them, and where
        its places begin (one more: the end) among all places, which are in order."""
        points, s, e, owner = self.tokens(texts)
        body = points[self.letter[points]]
        width = 1 + (body > 0x7F).astype(np.int8) + (body > 0x7FF) + (body > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.concatenate([[0], np.cumsum(e - s)])]
        words = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends.astype("<i4")), pa.py_buffer(body.astype("<i4").tobytes().decode("utf-32-le").encode()))
        coded = words.dictionary_encode()
        code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if stemmer:
            stems = pa.array(stemmer(terms.to_pylist()), pa.string()).dictionary_encode()
            code, terms = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], stems.dictionary
        place = np.arange(len(s)) - np.searchsorted(owner, owner)
        key = owner * max(len(terms), 1) + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        offsets = np.append(first, len(s))
        return owner[order][first], terms, code[order][first], offsets, place[order]


def with_cuts(rows: DataFrame, title: str, doc: str = "doc") -> DataFrame:
    """``rows`` with ``lens``, ``gaps`` and ``sentences`` of the body (see ``with_layout``) and ``dl``, the tokens of ``title`` and body."""
    table = letters(rows.sparkSession)
    names = rows.columns
    n, at = len(names), names.index(doc)
    low = rows.select("*", F.lower(title).alias("_title"), F.lower(doc).alias("_doc"))

    def cut(batches):
        cutter = Cutter(table)
        for batch in batches:
            bodies, titles, docs = (_texts(batch.column(i)) for i in (at, n, n + 1))
            for part in _parts(bodies, titles, docs):
                size = np.zeros(part.stop - part.start, np.int64)
                for texts in (titles[part], docs[part]):
                    size += np.bincount(cutter.tokens(texts)[3], minlength=len(size))
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*kept, *cutter.layout(bodies[part]), pa.array(size)], names=[*names, *LAYOUT, "dl"])

    return low.mapInArrow(cut, StructType([*rows.schema.fields, *[StructField(name, INTS) for name in LAYOUT], StructField("dl", LongType())]))


def term_places(rows: DataFrame, title: str, doc: str = "doc", by_package: bool = True, stem: bool = False) -> DataFrame:
    """``(package, id, col, term, tf, places)``: each distinct word, or stem, of a title (col 0) or body (col 1) once, with the
    number and the list of its places; in runs in order of package and term, or of term and package."""
    table = letters(rows.sparkSession)
    low = rows.select("package", "id", F.lower(title).alias("_title"), F.lower(doc).alias("_doc"))

    def cut(batches):
        cutter, stemmer = Cutter(table), Stemmer() if stem else None
        for batch in batches:
            titles, docs = _texts(batch.column(2)), _texts(batch.column(3))
            for part in _parts(titles, docs):
                owner, words, code, offsets, place = cutter.places([t for row in zip(titles[part], docs[part]) for t in row], stemmer)
                package = batch.column(0).slice(part.start, part.stop - part.start).dictionary_encode("encode")
                of = package.indices.to_numpy(zero_copy_only=False)[owner // 2]
                rank = np.empty(len(words), np.int64)
                rank[pc.sort_indices(words)] = np.arange(len(words))
                # Nearly in the order they are to be laid in: a sort of such runs merges them, with far fewer comparisons.
                order = np.lexsort((owner, rank[code], of) if by_package else (owner, of, rank[code]))
                row, tf = pa.array(part.start + owner[order] // 2), np.diff(offsets)[order]
                ends = np.cumsum(tf)
                moved = np.arange(len(place)) + np.repeat(offsets[:-1][order] - (ends - tf), tf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(owner[order] % 2, pa.int32()), words.take(pa.array(code[order])),
                     pa.array(tf, pa.int64()), _lists(np.append(0, ends), place[moved])], names=["package", "id", "col", "term", "tf", "places"])

    found = [StructField("col", IntegerType()), StructField("term", StringType()), StructField("tf", LongType()), StructField("places", INTS)]
    return low.mapInArrow(cut, StructType([rows.schema["package"], rows.schema["id"], *found]))
