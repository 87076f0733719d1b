"""Spelling variants: words within one inserted, deleted or replaced code point, by Aho-Corasick automata of word halves.

Two words one edit apart agree in the first or in the second half of the longer one (either, at equal lengths): the half
without the edit stands in the other word at its start or at its end. Words are dealt to shards of about SHARD by a
hash; a shard's automaton holds both halves of each of its words, marked with the start or end they belong to, so a hit
is at the right offset. All words, in chunks of about CHUNK, run through every shard's automaton. A hit's words of
compatible length, the text's own or one more, are verified. Where one half belongs to more than FEW words of a length,
these are found by what is left of the other half around each place that an edit can be at, so a half that very many
words share costs its hits only. A shard and a chunk meet in one cogroup, both bounded; each pair of words is seen in
one of them, and only counts and best words leave it, never pairs.

Words and their counts are gathered in Arrow batches, summed a task before they are shuffled. Roots follow forms by
doubling: a form is at least twice as frequent as its word, so chains have at most log2 of the largest count and their
length is halved by each join.

Defined results: null and empty texts have no words. A null id leaves its text's words whole, as nothing is hashed for
it. Repeated rows count as often as they come. Extra columns are dropped. Empty tables give no rows. Texts and words of
any length are taken whole. Ties between forms go to the smaller word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, discard, quoted, stage, text_slices

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many words loses a code point before they are counted, as the hash of document and word says.
DAMAGED = 97
SHARD, CHUNK, FEW = 150_000, 400_000, 8
#: Words whose counts a task holds before it passes them on.
HELD = 200_000
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id as text, text as UTF-8) to partial counts of the words, edits made."""
    held: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for part, texts in text_slices(batches, 1):
        for name, text in zip(part.column(0).to_pylist(), texts, strict=True):
            seen: dict[str, int] = {}
            for word in RUN.findall(text.lower().decode()):  # bytes.lower() changes A-Z alone
                seen[word] = seen.get(word, 0) + 1
            start = None if name is None else zlib.crc32(f"{name}:".encode())
            for word, n in seen.items():
                if start is not None and (h := zlib.crc32(word.encode(), start)) % DAMAGED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield rows()
    if held:
        yield rows()


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    rows = docs.select(quoted(doc_id).cast("string").alias("id"), as_utf8(quoted(text)).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Halves:
    """The automaton of a shard's words: finds those within one edit that are longer than a text, or as long and greater."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.groups: list[tuple[bool, dict[int, list[int]], dict[int, dict[str, list[int]]]]] = []
        self.automaton = ahocorasick.Automaton()
        at: dict[str, int] = {}
        for i, u in enumerate(patterns):
            half = len(u) // 2
            for first, segment in ((True, "^" + u[:half]), (False, u[half:] + "$")):
                if (g := at.get(segment)) is None:
                    g = at[segment] = len(self.groups)
                    self.groups.append((first, {}, {}))
                    self.automaton.add_word(segment, g)
                self.groups[g][1].setdefault(len(u), []).append(i)
        if patterns:
            self.automaton.make_automaton()

    def _around(self, first: bool, length: int, members: list[int]) -> dict[str, list[int]]:
        """Members by what stands around each place of the half that may hold the edit."""
        out: dict[str, list[int]] = {}
        for i in members:
            u = self.patterns[i]
            for k in range(length // 2, length) if first else range(length // 2):
                out.setdefault(f"{u[:k]}\0{u[k + 1 :]}", []).append(i)
        return out

    def near(self, v: str) -> list[int]:
        found: set[int] = set()
        if not self.patterns:
            return []
        for _, g in self.automaton.iter(f"^{v}$"):
            first, by_length, around = self.groups[g]
            for length in (len(v), len(v) + 1):
                members = by_length.get(length)
                if members is None:
                    continue
                longer = length > len(v)
                if len(members) <= FEW:
                    found.update(i for i in members if i not in found and one_edit(self.patterns[i], v))
                    continue
                index = around.get(length)
                if index is None:
                    index = around[length] = self._around(first, length, members)
                for k in range(length // 2, length) if first else range(length // 2):
                    found.update(index.get(f"{v[:k]}\0{v[k if longer else k + 1 :]}", ()))
        return [i for i in found if len(self.patterns[i]) > len(v) or self.patterns[i] > v]


def one_edit(u: str, v: str) -> bool:
    """Whether v is u with one code point replaced, or u without one."""
    k = next((k for k, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(v))
    return u[k + 1 :] == v[k + (len(u) == len(v)) :] and u != v


def _met(patterns: pa.Table, texts: pa.Table) -> pa.Table:
    """A shard and a chunk to (word, n_near, best_n, best): what each word's near words here come to."""
    u, v = patterns["word"].to_pylist(), texts["word"].to_pylist()
    un, vn = patterns["n"].to_pylist(), texts["n"].to_pylist()
    halves = Halves(u)
    best: dict[str, tuple[int, int, str]] = {}

    def add(word: str, n: int, other: str) -> None:
        was = best.get(word)
        if was is None:
            best[word] = (1, n, other)
        else:
            better = n > was[1] or n == was[1] and other < was[2]
            best[word] = (was[0] + 1, n, other) if better else (was[0] + 1, was[1], was[2])

    for word, n in zip(v, vn, strict=True):
        for i in halves.near(word):
            add(word, un[i], u[i])
            add(u[i], n, word)
    counts, ns, others = zip(*best.values(), strict=True) if best else ((), (), ())
    return pa.table({"word": pa.array(best.keys(), pa.string()), "n_near": pa.array(counts, pa.int64()), "best_n": pa.array(ns, pa.int64()), "best": pa.array(others, pa.string())})


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of a staged (word, n) table that have near words."""
    total = counted.count()
    shards, chunks = max(1, -(-total // SHARD)), max(1, -(-total // CHUNK))

    def dealt(own: str, parts: int, other: str, copies: int) -> DataFrame:
        return counted.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    pairs = dealt("shard", shards, "chunk", chunks).groupBy("shard", "chunk").cogroup(dealt("chunk", chunks, "shard", shards).groupBy("shard", "chunk"))
    found = pairs.applyInArrow(_met, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(up: DataFrame) -> DataFrame:
    """(word, root) of a staged table (word, root) of words with forms, forms followed to their ends."""
    while True:
        then = up.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = stage(up.join(then, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        discard(up)
        up = step
        if up.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module."""
    counted = stage(words(docs, doc_id, text), "words")
    near = near_words(counted).withColumnRenamed("word", "_w")
    fits = F.col("best_n") >= 2 * F.col("n")
    rows = stage(counted.join(near, F.col("word") == F.col("_w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    discard(counted)
    roots = _roots(stage(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")).select(F.col("word").alias("_w"), "root")
    return rows.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
