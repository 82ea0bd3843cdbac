"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies them.

Texts and templates are words ([0-9a-z] and non-ASCII after A-Z are lowered) and their 3-word shingles. A template of
more than 64 shingles is cut into pieces. A piece of s shingles belongs to the size class c, the least of 8, 16, 32,
64 that is s or more; windows of the class hold 2c shingles and begin every c, so each run of c shingles lies in one.

If a window holds at least 3/4 of a piece's shingles, their Jaccard similarity is at least (3/4 s) / (2c + s/4); as
s > c / 2 (in the first class, s >= 3), that is 0.17 or more. With 64 bands of one row, a window that must be found
is missed with a probability of at most (1 - 0.17)^64 < 10^-5. What bands retrieve is verified on exact shingle sets.
A license is found in a document when at least 3/4 of the template's distinct shingles are contained. A template of one
piece is counted in a window. Of a longer one, a window with 1/4 of a piece is a hit, and the whole template is counted
in what lies within its length of the document's hits: pieces may be altered unevenly. If 3/4 of a template is there,
so is 3/4 of some piece (but for shingles that the template repeats), so the bound above holds for it too.

Templates are a parameter and bounded (they're broadcast); texts are read whole, without a shuffle.

Defined results: a null, empty or short text has no match; repeated documents each get their own row; templates of
fewer than 5 words are an error; input columns named as a result column come back as <name>_input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import map_rows, once, table, utf8
from .license_texts import TEMPLATES
from .words import ALNUM, find, grams, mix

WORDS, CLASSES, BANDS, NUM, DEN = 3, (8, 16, 32, 64), 64, 3, 4
#: Quarters (of DEN) of a piece that make a window a hit of a longer template.
HIT = 1
MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())])
NEW = [T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))]
#: Odd factors of the bands' hashes.
FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def pieces_of(templates: dict[str, list[str]]) -> list[tuple[str, int, np.ndarray]]:
    """(license, number of the template, distinct shingles) of each piece."""
    out = []
    for k, (name, text) in enumerate((name, text) for name, texts in sorted(templates.items()) for text in texts):
        g = grams(find(pa.array([text]), ALNUM).hash, WORDS)
        if len(g) < 3:
            raise ValueError(f"template of {name} has fewer than {WORDS + 2} words")
        n = -(-len(g) // CLASSES[-1])
        out += [(name, k, np.unique(part)) for part in np.array_split(g, n)]
    return out


def band(h: np.ndarray, k: int) -> np.ndarray:
    return (h * FACTORS[k]) ^ (h >> np.uint64(29))


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.pieces = pieces_of(templates)
        self.total: dict[int, int] = {}
        parts: dict[int, list[np.ndarray]] = {}
        self.by_class: dict[int, list[int]] = {c: [] for c in CLASSES}
        for i, (_, k, s) in enumerate(self.pieces):
            self.total[k] = self.total.get(k, 0) + len(s)
            parts.setdefault(k, []).append(s)
            self.by_class[next(c for c in CLASSES if c >= len(s))].append(i)
        #: By template: distinct shingles, and whether it has several pieces.
        self.shingles = {k: np.unique(np.concatenate(held)) for k, held in parts.items()}
        self.long = {k: len(held) > 1 for k, held in parts.items()}
        #: By class and band: a bit table over the low bits of the pieces' least hashes, and pieces by least hash.
        self.bits: dict[tuple[int, int], np.ndarray] = {}
        self.least: dict[tuple[int, int], dict[int, list[int]]] = {}
        for c, own in self.by_class.items():
            for k in range(BANDS):
                held: dict[int, list[int]] = {}
                for i in own:
                    held.setdefault(int(band(self.pieces[i][2], k).min()), []).append(i)
                table = np.zeros(1 << 16, bool)
                table[[x & 0xFFFF for x in held]] = True
                self.bits[c, k], self.least[c, k] = table, held

    def candidates(self, g: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(piece, first and end shingle of a window) that some band retrieves; `first`: each document's shingles."""
        found: set[tuple[int, int, int]] = set()
        unit, size = CLASSES[0], np.diff(first)
        n_blocks = -(-size // unit)
        block_doc = np.repeat(np.arange(len(size)), n_blocks)
        place = np.arange(len(block_doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        starts = first[:-1][block_doc] + place * unit
        if not len(starts):
            return found
        for k in range(BANDS):
            mins, at, where = np.minimum.reduceat(band(g, k), starts), starts, place
            doc = block_doc
            for c in CLASSES:
                if c > unit:  # two blocks of half the size are one; a document's last may be alone
                    lead = np.flatnonzero(where % 2 == 0)
                    pair = np.minimum(lead + 1, len(mins) - 1)
                    both = np.where(doc[pair] == doc[lead], np.minimum(mins[lead], mins[pair]), mins[lead])
                    mins, at, doc, where = both, at[lead], doc[lead], where[lead] // 2
                if not self.by_class[c]:
                    continue
                follow = np.minimum(np.arange(len(mins)) + 1, len(mins) - 1)
                window = np.where(doc[follow] == doc, np.minimum(mins, mins[follow]), mins)
                for w in np.flatnonzero(self.bits[c, k][(window & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    for i in self.least[c, k].get(int(window[w]), ()):
                        found.add((i, int(at[w]), int(min(at[w] + 2 * c, first[doc[w] + 1]))))
        return found

    def scan(self, texts: pa.Array) -> list:
        w = find(texts, ALNUM)
        docs = len(w.first) - 1
        g_all = grams(w.hash, WORDS)
        doc = w.doc[: len(g_all)]
        inside = np.flatnonzero(np.arange(len(g_all)) + WORDS <= w.first[doc + 1]) if len(g_all) else np.zeros(0, np.int64)
        g = g_all[inside]
        first = np.searchsorted(inside, w.first)
        best: dict[tuple[int, int], int] = {}
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        near: dict[tuple[int, int], list[np.ndarray]] = {}  # shingles around the hits of a longer template
        for i, a, b in sorted(self.candidates(g, first)):
            _, k, own = self.pieces[i]
            hit = np.isin(g[a:b], own)
            n = len(np.unique(g[a:b][hit]))
            if n * DEN < len(own) * (HIT if self.long[k] else NUM):
                continue
            d = int(np.searchsorted(first, a, "right")) - 1
            at = np.flatnonzero(hit)
            begin, end = int(inside[a + at[0]]), int(inside[a + at[-1]] + WORDS - 1)
            spans.setdefault(d, []).append((begin, end, i, n))
            best[d, i] = max(n, best.get((d, i), 0))
            if self.long[k]:
                more = self.total[k]
                near.setdefault((d, k), []).append(g[max(first[d], a - more) : min(first[d + 1], b + more)])
        found: list[dict[int, int]] = [{} for _ in range(docs)]
        for (d, i), n in best.items():
            if not self.long[k := self.pieces[i][1]]:
                found[d][k] = n
        for (d, k), held in near.items():
            found[d][k] = int(np.isin(self.shingles[k], np.concatenate(held)).sum())
        data, offsets = utf8(texts)
        licenses, matches = [], []
        names = {k: name for name, k, _ in self.pieces}
        for d in range(docs):
            whole = {k for k, n in found[d].items() if n * DEN >= len(self.shingles[k]) * NUM}
            licenses.append(sorted({names[k] for k in whole}))
            rows: list[dict] = []
            if whole:
                lead = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])
                shown = sorted((self.pieces[i][1], begin, end) for begin, end, i, n in spans[d] if self.pieces[i][1] in whole and (n * DEN >= len(self.pieces[i][2]) * NUM or n == best[d, i]))
                joined: list[list] = []  # overlapping windows that show one occurrence of a template
                for k, begin, end in shown:
                    if joined and joined[-1][0] == k and begin <= joined[-1][2]:
                        joined[-1][2] = max(end, joined[-1][2])
                    else:
                        joined.append([k, begin, end])
                rows = [{"license": names[k], "start": int(lead[w.start[a] - offsets[d]]), "end": int(lead[w.end[b] - offsets[d]]), "containment": found[d][k] / len(self.shingles[k])} for k, a, b in joined]
            matches.append(sorted(rows, key=lambda r: (r["start"], r["license"])))
        return [licenses, matches]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`keep` columns (all, if None), licenses (sorted names) and matches (spans in code points, the template's containment in the document)."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)  # bounded: the caller's templates

    def work(texts: pa.Array) -> list:
        return once(shared, Scanner).scan(texts)

    return map_rows(docs, docs.columns if keep is None else keep, text_col, NEW, work)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), spans.alias("spans"))
