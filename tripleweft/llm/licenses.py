"""License scan by ordered signature rules with a keyword prefilter.

One automaton over the keywords of all rules passes each text once; only rules
one of whose keywords occurs are tried. Detections that lie within a detection
of the same or a better priority are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.arrays import ALPHANUMERIC, Words, slices
from tripleweft.llm.license_rules import Rule, build_rules
from tripleweft.llm.runtime import prepare

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_WORD = rb"[0-9a-z\x80-\xff]"
_BASE_PATTERNS = [
    (
        label,
        [word.encode() for word in phrase.split()],
        re.compile(rb"(?<!" + _WORD + rb")" + (rb"[^0-9a-z\x80-\xff]+").join(w.encode() for w in phrase.split()) + rb"(?!" + _WORD + rb")"),
    )
    for phrase, label in BASE.items()
]

# Gaps between words that rules see as one space: runs of blanks, with the
# comment marks that end a line or begin the next ones. A lone space stays.
_MARK = r"(?:/\*+|\*+/|<!--|-->|//+|\#+|\*+|;+|%+|--+|>+|\|+|\.\\\"|(?:dnl|rem)(?=\s))"
GAP = re.compile(rf"(?:[^\S\n]+{_MARK})?[^\S\n]*\n(?:\s*{_MARK})*\s*|[^\S\x20]\s*|\x20\s+")

DETECTION = pa.struct(
    [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]
)


@cache
def _scanner() -> tuple[list[Rule], ahocorasick.Automaton]:
    rules = build_rules()
    by_keyword: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for word in rule.keywords:
            by_keyword.setdefault(word, []).append(k)
    automaton = ahocorasick.Automaton()
    for word, which in by_keyword.items():
        automaton.add_word(word, tuple(which))
    automaton.make_automaton()
    return rules, automaton


def _one_line(text: str) -> tuple[str, Callable[[int], int]]:
    """`text` with every gap between words as one space, and the map of its offsets to those in `text`."""
    cuts, shifts, out, done, short = [], [], [], 0, 0
    for m in GAP.finditer(text):
        out += [text[done : m.start()], " "]
        done = m.end()
        short += done - m.start() - 1
        cuts.append(done - short)  # the first place after the space
        shifts.append(short)

    def back(at: int) -> int:
        k = bisect_right(cuts, at)
        return at + (shifts[k - 1] if k else 0)

    return "".join(out) + text[done:], back


def detect(text: str) -> list[tuple[int, int, Rule]]:
    """Detections in a lower-cased text that no other one suppresses, by start.

    Statements may wrap over lines, with comment marks, or have wide blanks:
    rules see each such gap as one space. Offsets are those of `text`.
    """
    rules, automaton = _scanner()
    line, back = _one_line(text)
    wanted = sorted({k for _, which in automaton.iter(line) for k in which})
    found = [(back(m.start()), back(m.end() - 1) + 1, rules[k]) for k in wanted for m in rules[k].pattern.finditer(line)]
    return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without detections contained in one of the same or a better priority.

    Of equal intervals the best priority stays, then the first label. One pass
    by start: an interval is contained if one that began no later, with a
    priority as good, reaches its end.
    """
    reach: dict[int, int] = {}
    kept = []
    for start, end, rule in sorted(found, key=lambda d: (d[0], -d[1], d[2].priority, d[2].label)):
        if all(to < end for priority, to in reach.items() if priority <= rule.priority):
            kept.append((start, end, rule))
        reach[rule.priority] = max(reach.get(rule.priority, -1), end)
    return kept


def _base_places(words: Words, row: int) -> list[tuple[int, str]]:
    """First words, counted in the document, of the base phrases in it."""
    data = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes()
    places = []
    for label, gate, pattern in _BASE_PATTERNS:
        if all(word in data for word in gate):
            places += [(m.start(), label) for m in pattern.finditer(data)]
    own = words.starts[words.first[row] : words.first[row + 1]] - words.offsets[row]
    at = np.searchsorted(own, [start for start, _ in places])
    return sorted((int(k), label) for k, (_, label) in zip(at, places, strict=True))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, base, detections` for every row of `doc_id, text`.

    `base` lists the places of the base phrases as `word, label`; `detections`
    the rules' finds that were not suppressed as `label, start, end, priority,
    confidence` in code points. Null and empty texts have no words and no
    finds, a null doc_id stays null, repeated rows each give a row, other
    columns are ignored. Texts are scanned whole.
    """
    prepare(docs.sparkSession)
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"), ALPHANUMERIC, lower=True)
            base, found = [], []
            for row in range(part.num_rows):
                text = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().decode("utf-8", "replace")
                base.append([{"word": k, "label": label} for k, label in _base_places(words, row)])
                found.append([(r.label, a, b, r.priority, r.confidence) for a, b, r in detect(text)])
            rows = [[dict(zip(("label", "start", "end", "priority", "confidence"), d, strict=True)) for d in ds] for ds in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(base, base_type), pa.array(rows, pa.list_(DETECTION))],
                ["doc_id", "n_words", "base", "detections"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, base array<struct<word:bigint,label:string>>, "
        "detections array<struct<label:string,start:bigint,end:bigint,priority:int,confidence:double>>",
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Counts, places and labels of `scan_licenses`, and the best confidence as score."""
    word, label = F.transform("base", lambda b: b["word"]), F.transform("base", lambda b: b["label"])
    every = F.concat(label, F.transform("detections", lambda d: d["label"]))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        joined(label).alias("base_labels"),
        joined(every).alias("labels"),
        F.coalesce(F.greatest(best, F.when(F.size("base") > 0, F.lit(0.6))), F.lit(0.0)).alias("score"),
    )
