"""Quality rules as a short-circuit cascade.

Each rule has a kernel over a batch of texts that says which texts it rejects. ``plan_cascade``
times the kernels and counts their rejections on the executors, on a sample by hash over all
partitions, and orders the rules by rejections per second; ``apply_cascade`` then runs them in that
order, each over the texts that are still alive. The verdict is the conjunction of all rules, so
the order changes the cost and never the result. ``quality_report`` needs the base counts of every
text; the rules beyond them run over the texts that the base rules left only.

Null and empty texts have no words and are rejected by the word-count rule. Very long texts are
judged as a whole. Repeated rows are judged alone; lines that tie count from the second on. Extra
columns are kept (a column named like the flag may not be among them); an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm._text import SPACE, Block, mix, slices, text_buffers, windows
from assayer.llm._work import releasing, ship

BLOCK_BYTES = 1 << 20
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


class Measures:
    """Lazily computed counts of a block of texts; each is made at most once."""

    def __init__(self, block: Block):
        self.block = block
        self._kept: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or name not in KERNELS:
            raise AttributeError(name)
        if name not in self._kept:
            self._kept[name] = KERNELS[name](self)
        return self._kept[name]


def _words(m: Measures):
    return m.block.words()


def _n_words(m: Measures) -> np.ndarray:
    return np.bincount(m.words[2], minlength=m.block.docs)


def _word_chars(m: Measures) -> np.ndarray:
    data = m.block.data
    return m.block.per_doc(((data & 0xC0) != 0x80) & ~SPACE[data])


def _n_symbols(m: Measures) -> np.ndarray:
    return m.block.per_doc(_SYMBOL[m.block.data])


def _letters(m: Measures) -> np.ndarray:
    data = m.block.data
    return m.block.per_doc(_LETTER[data] & ((data & 0xC0) != 0x80))


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal another entry of their text, and which equal an earlier one."""
    key = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def _lines(m: Measures) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, by text."""
    starts, ends, doc = m.block.lines()
    seen = np.zeros(len(m.block.data) + 1, np.int64)
    np.cumsum(~SPACE[m.block.data], out=seen[1:])
    full = seen[ends] > seen[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    _, later = _repeated(m.block.hashes(starts, ends), doc)
    return np.bincount(doc, minlength=m.block.docs), np.bincount(doc[later], minlength=m.block.docs)


def _n_repeat_words(m: Measures) -> np.ndarray:
    starts, ends, doc = m.words
    at, h = windows(m.block.hashes(starts, ends), doc, 8)
    twice, _ = _repeated(h, doc[at])
    cover = np.zeros(len(starts) + 9, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    hit = np.cumsum(cover)[: len(starts)] > 0
    return np.bincount(doc[hit], minlength=m.block.docs)


KERNELS: dict[str, Callable] = {
    "words": _words, "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols, "letters": _letters, "lines": _lines,
    "n_lines": lambda m: m.lines[0], "n_dup_lines": lambda m: m.lines[1], "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` gives a boolean for each text of the block."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


#: Production rules. All comparisons are of integers, so that every engine gives the same verdict.
RULES = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
    Rule("word_length", lambda m: (10 * m.word_chars < 22 * m.n_words) | (m.word_chars > 15 * m.n_words)),
    Rule("symbols", lambda m: 5 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: (m.n_lines >= 6) & (2 * m.n_dup_lines > m.n_lines)),
    Rule("letters", lambda m: 100 * m.letters < 60 * m.word_chars),
)
BASE_RULES = ("few_words", "repeated_windows")


def _blocks(column: pa.Array) -> Iterator[Block]:
    data, off = text_buffers(column)
    for a, b in slices(off, BLOCK_BYTES):
        yield Block(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _subset(block: Block, alive: np.ndarray) -> Block:
    lengths = np.diff(block.offsets)
    keep = np.repeat(alive, lengths)
    return Block(block.data[keep], np.append(0, np.cumsum(lengths[alive])))


def verdicts(block: Block, rules: tuple[Rule, ...]) -> np.ndarray:
    """True for the texts that no rule rejects; later rules see only what earlier ones left."""
    alive, at, m = np.ones(block.docs, bool), np.arange(block.docs), Measures(block)
    for rule in rules:
        left = alive[at]
        if 2 * left.sum() < len(at):
            at, m = at[left], Measures(_subset(block, alive))
        if not len(at):
            break
        alive[at] &= ~rule.rejects(m)
    return alive


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 500) -> tuple[Rule, ...]:
    """Rules by rejections per second of their kernels, measured on about ``sample_rows`` texts that a hash draws from all partitions.

    The sample fixes an execution order only; it never decides about a document. Texts stay on the executors.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for block in _blocks(batch.column(0)):
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += int(rule.rejects(Measures(block)).sum())
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    one_in = max(1, docs.count() // sample_rows)
    drawn = docs.select(F.col(text).cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(one_in)) == 0)
    sums = drawn.mapInArrow(releasing(run), "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    worth = {r.name: 0.0 for r in rules}
    for r in sums.collect():  # one row a rule
        worth[r["rule"]] = (r["rejected"] + 0.5) / (r["seconds"] + 1e-6)
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def apply_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", flag: str = "kept") -> DataFrame:
    """``docs`` with a boolean column ``flag``; the order of ``rules`` is the order of the cascade."""
    ship(docs.sparkSession)
    if flag in docs.columns:
        raise ValueError(f"the documents have a column {flag}; name another flag")
    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(flag, T.BooleanType())])
    names = [f.name for f in schema.fields[:-1]]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = np.concatenate([verdicts(block, rules) for block in _blocks(batch.column(at))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept)], names=[*names, flag])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(releasing(run), schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the base counts, whether a base rule fails, and the cascade's verdict."""
    ship(docs.sparkSession)
    base = [r for r in rules if r.name in BASE_RULES]
    rest = tuple(r for r in rules if r.name not in BASE_RULES)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{c} long" for c in columns) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for block in _blocks(batch.column(1)):
                m = Measures(block)
                failed = np.zeros(block.docs, bool)
                for rule in base:
                    failed |= rule.rejects(m)
                kept = ~failed
                if kept.any():
                    kept[kept] = verdicts(_subset(block, kept), rest)
                parts.append([*(getattr(m, c) for c in columns), failed, kept])
            arrays = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *columns, "base_failed", "kept"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(releasing(run), schema)
