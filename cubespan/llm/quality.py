"""Line-first cleaning (operator 6): rules on each line come first, then a document is judged by what they left.

A line is dropped when it has words and one of these holds: the last sentence in it ends before its middle or
not at all, it is made of navigation cells, most of its letters are capitals, it is full of symbols, it is a
stock phrase of web pages, most of its words repeat the word before, or it repeats an earlier line of its
document. A document is rejected when it fails the base rule, when
nothing is left, or when the dropped lines held more than max_lost of its characters.

Null and empty texts have no words; they fail the base rule and are rejected. A null id stays null; repeated rows
are judged each for itself. Columns of the input other than the id and the text pass through clean() unchanged.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.llm import _shared, _text

#: Stock phrases of web pages, in lower case; a line with one of them and few words more is boilerplate.
STOCK = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "sign up", "log in", "subscribe to", "click here", "read more", "share this", "skip to content", "back to top", "enable javascript", "lorem ipsum")
_STOCK = re.compile("|".join(map(re.escape, STOCK)))
_CELL = re.compile(r"\s[|>»•·]\s|\|")
_SENTENCE_END = tuple(".!?…。！？")
_CLOSERS = "\"')]}”’»"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Of SCHEMA, what clean() adds to its documents.
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, lost_share double, base_failed boolean, kept boolean, cleaned string"


@dataclass(frozen=True)
class Rules:
    """stock_words: a line with a stock phrase is dropped up to so many words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost: float = 0.5
    cells: int = 3
    max_capitals: float = 0.7
    max_symbols: float = 0.1
    stock_words: int = 12
    stutter_words: int = 10
    max_stutter: float = 0.5


def bad_line(line: str, rules: Rules) -> bool:
    """Whether a line with words fails one of the rules that need no other line."""
    body = line.strip()
    if not body.rstrip(_CLOSERS).endswith(_SENTENCE_END) and 2 * (max(map(body.rfind, _SENTENCE_END)) + 1) < len(body):
        return True
    if "|" in body or " > " in body or "»" in body or "•" in body or "·" in body:
        if len(_CELL.findall(body)) >= rules.cells:
            return True
    if len(_SYMBOLS.findall(body)) > rules.max_symbols * len(body):
        return True
    if body.isupper() or len(body) >= 8 and sum(map(str.isupper, body)) > rules.max_capitals * max(1, sum(map(str.isalpha, body))):
        return True
    spoken = body.split()
    if len(spoken) >= rules.stutter_words and sum(map(operator.eq, spoken, spoken[1:])) > rules.max_stutter * len(spoken):
        return True
    low = body.lower()
    return bool(_STOCK.search(low)) and len(low.split()) <= rules.stock_words


def _statistics(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Words, characters in words, symbols and repeated words of each document."""
    starts, ends, first = _text.words(data, off)
    n = np.diff(first)
    inside = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~_text.IS_SEPARATOR[data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    repeated = np.zeros(len(starts), bool)
    valid = np.flatnonzero(_text.within(first, 3))
    if len(valid):
        doc = np.repeat(np.arange(len(n)), n)[valid]
        g = _text.grams(_text.hash_spans(data, starts, ends), 3)[valid]
        g = _text.mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(g)
        g = g[order]
        same = g[1:] == g[:-1]
        twice = np.zeros(len(g), bool)
        twice[1:] = same
        twice[:-1] |= same
        repeated = _text.covered(valid[order[twice]], 3, len(starts))
    total = np.concatenate([[0], np.cumsum(repeated)])
    return [n, inside[off[1:]] - inside[off[:-1]], symbols[off[1:]] - symbols[off[:-1]], total[first[1:]] - total[first[:-1]]]


def judge(rules: Rules, batches: Iterator[pa.RecordBatch], with_text: bool = False) -> Iterator[pa.RecordBatch]:
    """SCHEMA for batches of (doc_id, text)."""
    has_word = re.compile(r"[^\x20\x09-\x0D]").search
    for whole in batches:
        data, off = _text.utf8(whole.column(1))
        for i, j in _text.parts(off, 4 << 20):
            ids, texts = whole.column(0).slice(i, j - i), whole.column(1).slice(i, j - i).to_pylist()
            n, chars, symbols, repeats = _statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n)
            dup, lines, bad, lost, kept, cleaned = [], [], [], [], [], []
            for text, fails in zip(texts, failed.tolist(), strict=True):
                seen: set[str] = set()
                d = b = gone = all_chars = 0
                left = []
                for line in (text or "").split("\n"):
                    if not has_word(line):
                        left.append(line)
                        continue
                    all_chars += len(line)
                    if line in seen:
                        d += 1
                    elif not bad_line(line, rules):
                        seen.add(line)
                        left.append(line)
                        continue
                    else:
                        seen.add(line)
                    b += 1
                    gone += len(line)
                share = gone / all_chars if all_chars else 1.0
                dup.append(d)
                lines.append(all_chars and len(seen) + d)
                bad.append(b)
                lost.append(share)
                kept.append(not fails and share <= rules.max_lost)
                cleaned.append("\n".join(left) if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, dup, repeats, lines, bad)), pa.array(lost, pa.float64()), pa.array(failed), pa.array(kept, pa.bool_()), pa.array(cleaned, pa.string())],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )
    _shared.release()


def line_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row of SCHEMA for each document, without the cleaned text. One pass, no shuffle."""
    _shared.small_batches(docs)
    chosen = rules or Rules()
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(lambda it: judge(chosen, it), SCHEMA)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The documents that pass, with their bad lines removed; columns and types as in docs. One pass, no shuffle."""
    _shared.small_batches(docs)
    chosen, names = rules or Rules(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, body = names.index(doc_id), names.index(text)
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(body)], names=["doc_id", "text"])
            done = pa.Table.from_batches(judge(chosen, iter([pair]), with_text=True)) if len(batch) else None
            if done is None:
                continue
            kept = done["kept"].combine_chunks()
            columns = [done["cleaned"].combine_chunks().cast(batch.column(k).type) if k == body else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(kept)
        _shared.release()

    return docs.mapInArrow(run, docs.schema)
