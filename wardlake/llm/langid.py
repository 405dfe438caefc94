"""Language identification by prediction by partial matching.

For each language, bytes are counted after every context of up to ``ORDER`` bytes, over all
learned texts. The counts are then frozen. A byte seen in a context n times out of N, with D
different bytes there, has probability n / (N + D); a byte new to the context costs the escape
D / (N + D) and is looked up in the context that is one byte shorter, without the bytes already
ruled out. The text's code length in bits under each language follows exactly, and the shortest
wins. Letters are lower-cased and other ASCII characters are blanks to the model.

The model that is sent to the tasks is bounded: of each order and language the most frequent
``grams`` stay, cut at a count level that is found from a small histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import stored

ORDER, GRAMS, UNKNOWN = 3, 100_000, "und"
#: Bytes that are turned to numbers at a time.
CHUNK = 1 << 21
#: A letter is a code point of Unicode category L, as str.isalpha() tells.
_LETTER = regex.compile(r"\p{L}")
_BLANKED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_PAD = b" " * ORDER


def model_bytes(text: str) -> bytes:
    return text.lower().encode().translate(_BLANKED)


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(codes of the last ORDER + 1 bytes at each place, bounds of the parts, whose they are).

    A text longer than a chunk comes in parts; each part is read after the bytes before it.
    """
    parts = [(i, t[max(0, a - ORDER):a].rjust(ORDER), t[a:a + CHUNK])
             for i, t in enumerate(texts) for a in range(0, len(t), CHUNK)]
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + len(parts[end][2]) <= CHUNK):
            total += len(parts[end][2])
            end += 1
        mine = parts[at:end]
        raw = np.frombuffer(b"".join(x for _, a, b in mine for x in (a, b)), np.uint8)
        wide = raw.astype(np.uint32)
        codes = np.zeros(len(raw) + 1, np.uint32)
        codes[ORDER:-1] = wide[ORDER:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
        sizes = np.array([len(b) for _, _, b in mine])
        ends = np.cumsum(sizes + ORDER)
        yield codes, np.stack([ends - sizes, ends], axis=1), [i for i, _, _ in mine]
        at = end


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, code, n`` from rows (lang, text): bytes with their context, over all rows."""
    def count(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy()
            texts = [model_bytes(t.as_py()) for t in batch.column(1)]
            for codes, bounds, owners in _chunks(texts):
                lang = np.repeat(of[owners], bounds[:, 1] - bounds[:, 0]).astype(np.int64)
                inside = np.concatenate([np.arange(a, b) for a, b in bounds.tolist()])
                group, keys = pd.factorize(lang << 32 | codes[inside])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF),
                     pa.array(np.bincount(group, minlength=len(keys)))],
                    names=["lang", "code", "n"])

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def frozen_counts(counts: DataFrame, grams: int = GRAMS) -> DataFrame:
    """``lang, order, code, n``: shorter contexts summed up, each order cut to its bound.

    Counts are compared by level (eight to a doubling), so that the histogram is small; levels
    stay from the top as long as the bound holds.
    """
    orders = [counts.select("lang", F.lit(k).alias("order"),
                            F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code"), "n")
              for k in range(ORDER + 1)]
    every = orders[0]
    for rows in orders[1:]:
        every = every.unionByName(rows)
    summed = stored(every.groupBy("lang", "order", "code").agg(F.sum("n").alias("n"))
                    .withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "grams")
    levels = summed.groupBy("lang", "order", "level").agg(F.count("*").alias("m")).collect()
    least: dict[tuple, int] = {}
    held: dict[tuple, int] = {}
    for r in sorted(levels, key=lambda r: -r.level):  # languages x orders x levels
        key = (r.lang, r.order)
        held[key] = held.get(key, 0) + r.m
        if held[key] <= grams:
            least[key] = r.level
    keep = F.lit(False)
    for (lang, order), level in least.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("order") == order)
                       & (F.col("level") >= level))
    return summed.where(keep).select("lang", "order", "code", "n")


class Tree:
    """Frozen statistics of one language: log2 probabilities of its grams, by order, and the
    factor that an escape from each context brings."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.codes: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        for codes, n in grams:
            order = np.argsort(codes)
            codes, n = codes[order], n[order].astype(np.float64)
            contexts, group = np.unique(codes >> 8, return_inverse=True)
            different = np.bincount(group, minlength=len(contexts))
            total = np.bincount(group, n, minlength=len(contexts)) + different
            lower = np.exp2(self.log2p(codes & ((1 << 8 * len(self.codes)) - 1)))
            rest = 1.0 - np.bincount(group, lower, minlength=len(contexts))
            # All 256 bytes seen: nothing is left to escape to.
            with np.errstate(divide="ignore"):
                escape = np.where(rest > 1e-9, np.log2(different / total)
                                  - np.log2(np.maximum(rest, 1e-9)), 0.0)
            self.bits.append(np.log2(n / total[group]))
            self.codes.append(codes)
            self.contexts.append(contexts)
            self.escapes.append(escape)

    def log2p(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each code after the bytes before it, by the longest context known."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(len(self.codes) - 1, -1, -1):
            if not len(self.codes[k]):
                continue
            mine = codes[todo] & ((1 << 8 * (k + 1)) - 1)
            at = np.searchsorted(self.codes[k], mine).clip(max=len(self.codes[k]) - 1)
            hit = self.codes[k][at] == mine
            out[todo[hit]] += self.bits[k][at[hit]]
            todo, mine = todo[~hit], mine[~hit]
            ctx = np.searchsorted(self.contexts[k], mine >> 8).clip(max=len(self.contexts[k]) - 1)
            known = self.contexts[k][ctx] == mine >> 8
            out[todo[known]] += self.escapes[k][ctx[known]]
        out[todo] -= 8.0  # bytes never seen
        return out


class Model:
    """All languages' trees, and the scores of all their longest grams side by side."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        frame = pd.DataFrame(rows, columns=["lang", "order", "code", "n"])
        self.languages = sorted(frame["lang"].unique())
        self.trees = []
        for lang in self.languages:
            mine = frame[frame["lang"] == lang]
            self.trees.append(Tree([
                (g["code"].to_numpy(np.int64), g["n"].to_numpy(np.int64))
                for g in (mine[mine["order"] == k] for k in range(ORDER + 1))]))
        longest = frame.loc[frame["order"] == ORDER, "code"].unique().astype(np.int64)
        self.known = np.sort(longest)
        self.table = self._scores(self.known)

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        return np.array([t.log2p(codes) for t in self.trees]).reshape(len(self.trees), len(codes))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.trees)))
        index = pd.Index(self.known)
        for codes, bounds, owners in _chunks(texts):
            which, distinct = pd.factorize(codes)
            distinct = distinct.astype(np.int64)
            at = index.get_indexer(distinct)
            scores = np.empty((len(self.trees), len(distinct)))
            scores[:, at >= 0] = self.table[:, at[at >= 0]]
            scores[:, at < 0] = self._scores(distinct[at < 0])
            for j, row in enumerate(scores):
                sums = np.add.reduceat(row[which], bounds.ravel())[::2]
                np.subtract.at(out[:, j], owners, sums)
        return out


def train(docs: DataFrame, grams: int = GRAMS, lang_col: str = "lang",
          text_col: str = "text") -> Model:
    """From all rows with a language and a text."""
    rows = (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return Model([tuple(r) for r in frozen_counts(gram_counts(rows), grams).collect()])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` per row of ``docs``.

    The score is the language's share if all were as likely beforehand. Texts that are null or
    without a letter, and all texts under a model without languages, are ``und`` with score 0.
    Equal code lengths go to the language that comes first. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        for batch in batches:
            names = shared.value.languages
            texts = [t.as_py() or "" for t in batch.column(1)]
            raw = [model_bytes(t) for t in texts]
            langs, scores, rates = [], [], []
            bits = shared.value.bits(raw)
            for text, b, mine in zip(texts, raw, bits, strict=True):
                if not names or not _LETTER.search(text):
                    langs.append(UNKNOWN), scores.append(0.0), rates.append(None)
                    continue
                best = int(np.argmin(mine))
                langs.append(names[best])
                scores.append(float(1.0 / np.exp2(np.clip(mine[best] - mine, -1000, 0)).sum()))
                rates.append(float(mine[best] / len(b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rates, pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        of, "doc_id long, lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text is 1 modulo 3; also rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))
