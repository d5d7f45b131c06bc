"""Language ID by rank-order profiles (the out-of-place distance).

A profile ranks the most frequent n-grams of one to three letters of a language. A document's own ranking is compared
with every profile: each n-gram costs the difference of its ranks, or the profile's length where it is missing. The
language with the smallest sum wins. Texts are lower-cased; whatever is not a letter is a word boundary, and a
boundary counts as a letter at the start and end of a word. Ranks go by count, then shorter n-grams, then code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenhand.llm.words import tidy_map

#: N-grams of a profile, and the longest n-gram.
TOP = 400
LONGEST = 3
#: A task's counts go on to the shuffle when there are so many.
FLUSH = 200_000


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """A fixed fold of the documents that no profile sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


class Grams:
    """N-grams of some texts: ``doc``, and a number that orders n-grams by length, then code points."""

    def __init__(self, texts: list[str | None]):
        texts = ["" if t is None else t.lower() for t in texts]
        points = np.frombuffer((" " + "".join(t + " " for t in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found, index = _index(points)
        letter = np.array([chr(x).isalpha() if x < 0xD800 or x > 0xDFFF else False for x in found], dtype=bool)
        #: Letters by code point; number 0 is the boundary.
        self.letters = [chr(x) for x in found[letter]]
        number = np.zeros(len(found), dtype=np.int64)
        number[letter] = np.arange(1, letter.sum() + 1)
        code = number[index]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        doc = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths)])[: len(code)]
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code, doc = code[keep], doc[keep]
        self.base = a = len(self.letters) + 1
        self.space = a + a * a + a**3
        self.code, self.char_doc = code, doc

    def numbers(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, n-grams) for each length; a boundary stands only at the ends of an n-gram."""
        c, a = self.code, self.base
        one = np.flatnonzero(c)
        yield self.char_doc[one], c[one]
        if len(c) > 1:  # a boundary belongs to the text before it, so an n-gram to the text of its letter
            two = np.flatnonzero((c[:-1] != 0) | (c[1:] != 0))
            at = np.where(c[two] != 0, two, two + 1)
            yield self.char_doc[at], a + c[two] * a + c[two + 1]
        if len(c) > 2:
            three = np.flatnonzero(c[1:-1])
            yield self.char_doc[three + 1], a + a * a + (c[three] * a + c[three + 1]) * a + c[three + 2]

    def number_of(self, gram: str) -> int:
        """The number of an n-gram here, or -1 if one of its letters does not occur."""
        place = {x: i + 1 for i, x in enumerate(self.letters)} | {" ": 0} if not hasattr(self, "_place") else self._place
        self._place = place
        n, a = 0, self.base
        for x in gram:
            if x not in place:
                return -1
            n = n * a + place[x]
        return n + (0, 0, a, a + a * a)[len(gram)]

    def text_of(self, n: int) -> str:
        a = self.base
        k = 1 if n < a else 2 if n < a + a * a else 3
        n -= (0, 0, a, a + a * a)[k]
        out = ""
        for _ in range(k):
            n, x = divmod(n, a)
            out = (self.letters[x - 1] if x else " ") + out
        return out


def _index(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct code points in order, and the place of each point among them."""
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    found = np.flatnonzero(seen)
    place = np.zeros(found[-1] + 1 if len(found) else 1, dtype=np.int32)
    place[found] = np.arange(len(found))
    return found, place[points]


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, n`` over all texts; tasks send sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}

        def rows() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())],
                names=["lang", "gram", "n"],
            )
            sums.clear()
            return out

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for part in _parts(own, 1_000_000):
                    g = Grams([own[i] for i in part])
                    for _, numbers in g.numbers():
                        if g.space <= 1 << 21:
                            n = np.bincount(numbers)
                            which = np.flatnonzero(n)
                            n = n[which]
                        else:
                            which, n = np.unique(numbers, return_counts=True)
                        for x, k in zip(which.tolist(), n.tolist()):
                            key = (lang, g.text_of(x))
                            sums[key] = sums.get(key, 0) + k
                    if len(sums) > FLUSH:
                        yield rows()
        yield rows()

    return docs.select(text_col, lang_col).mapInArrow(tidy_map(count), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[str]]:
    """The ``top`` n-grams of each language, most frequent first, over all rows with a text and a language.

    The result has at most ``top`` entries for each language that the labels name.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = W.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    best = count_grams(rows, text_col, lang_col).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out: dict[str, list[str]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def rank_texts(texts: list[str | None], profiles: dict[str, list[str]], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """For each text the distances to the profiles (in their order) and the number of its n-grams that were ranked."""
    g = Grams(texts)
    n_docs, langs = len(texts), list(profiles)
    keys = np.sort(np.concatenate([d * g.space + n for d, n in g.numbers()]))
    dist, size = np.zeros((n_docs, len(langs)), dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    if not len(keys):
        return dist, size
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    doc, gram = np.divmod(keys[at], g.space)
    order = np.argsort((doc << 32) + ((1 << 32) - 1 - counts), kind="stable")  # the rest is in order already
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    rank = np.arange(len(doc)) - first[doc]
    keep = rank < top
    doc, gram, rank = doc[keep], gram[keep], rank[keep]
    size += np.bincount(doc, minlength=n_docs)
    for j, lang in enumerate(langs):
        known = np.array([g.number_of(x) for x in profiles[lang]], dtype=np.int64)
        place = np.flatnonzero(known >= 0)
        by = place[np.argsort(known[place])]
        miss = np.full(len(gram), top, dtype=np.int64)
        if len(by):
            hit = np.minimum(np.searchsorted(known[by], gram), len(by) - 1)
            same = known[by][hit] == gram
            miss[same] = np.abs(by[hit][same] - rank[same])
        dist[:, j] = np.bincount(doc, weights=miss, minlength=n_docs).astype(np.int64)
    return dist, size


def predict(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", keep: list[str] = (), top: int = TOP) -> DataFrame:
    """Columns ``keep`` as they are, then ``lang_pred`` and ``score``, for every row from its whole text.

    ``score`` is 1 minus the distance over the largest one possible (every n-gram missing). ``und`` with score 0 is
    given for a null text, one without a letter, or if there are no profiles. Ties go to the smaller language name.
    """
    langs = sorted(profiles)
    ordered = {x: profiles[x] for x in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(source).to_pylist()
            preds, scores = np.full(len(texts), None, dtype=object), np.zeros(len(texts))
            for part in _parts(texts):
                dist, size = rank_texts([texts[i] for i in part], ordered, top)
                ok = size > 0 if langs else np.zeros(len(part), dtype=bool)
                best = dist.argmin(axis=1) if langs else np.zeros(len(part), dtype=np.int64)
                where = np.array(part)[ok]
                preds[where] = np.array(langs, dtype=object)[best[ok]] if langs else "und"
                scores[where] = 1.0 - dist[ok, best[ok]] / (size[ok] * top) if langs else 0.0
            cols = [batch.column(i) for i in range(len(keep))]
            preds = ["und" if p is None else p for p in preds]
            yield pa.record_batch([*cols, pa.array(preds, pa.string()), pa.array(scores)], names=[*batch.schema.names[: len(keep)], "__pred", "__score"])

    cols = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(keep)]
    given = docs.select(*cols, *([] if text_col in keep else [F.col(f"`{text_col}`").alias("__text")]))  # a text that is kept is sent once
    source = f"x{list(keep).index(text_col)}" if text_col in keep else "__text"
    schema = ", ".join([*(f"x{i} {given.schema[f'x{i}'].dataType.simpleString()}" for i in range(len(keep))), "__pred string, __score double"])
    out = given.mapInArrow(tidy_map(run), schema)
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(keep)], F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"))


def _parts(texts: list[str | None], chars: int = 400_000) -> Iterator[list[int]]:
    """Runs of texts of about so many characters together (a longer text is a run of its own)."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
