"""License scan: ordered signature rules behind keywords, overlaps settled by priority and containment."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalspark.llm.decontamination import NORMAL
from evalspark.llm.license_rules import Rule, rules
from evalspark.llm.tables import texts
from evalspark.llm.textkit import ALNUM, Words, slices

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, detections array<struct<label:string,first:int,last:int,weight:double>>")


def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that stand: by priority, then length, then place; one inside a standing one is suppressed.

    A tree of prefix maxima over the starts holds how far any standing detection
    that starts no later reaches, so thousands of detections in one text stay cheap.
    """
    starts = sorted({begin for begin, _, _ in found})
    reach = [-1] * (len(starts) + 1)
    standing = []
    for begin, end, rule in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label)):
        own = k = bisect_right(starts, begin)
        furthest = -1
        while k:
            furthest, k = max(furthest, reach[k]), k & (k - 1)
        if furthest >= end:
            continue
        standing.append((begin, end, rule))
        while own < len(reach):
            reach[own] = max(reach[own], end)
            own += own & -own
    return sorted(standing, key=lambda d: (d[0], d[1]))


BLANKS = bytes.maketrans(b"\t\r\n", b"   ")


def one_blank(lowered: bytes) -> bytes:
    """The text with every run of blanks, as the patterns know them, as one space."""
    line = lowered.translate(BLANKS)
    while b"  " in line:
        line = line.replace(b"  ", b" ")
    return line


def detect(lowered: bytes) -> list[tuple[int, int, Rule]]:
    """The standing detections of a lower-cased text, as byte intervals."""
    present: dict[bytes, bool] = {}
    line, found = one_blank(lowered), []
    for rule in rules():
        if rule.keyword not in present:
            present[rule.keyword] = rule.keyword in line
        if present[rule.keyword]:
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(lowered)]
    return settle(found)


def base_places(lowered: bytes) -> list[tuple[int, str]]:
    """First word and label of every place where a base phrase's words stand consecutively."""
    line, places = None, []
    for phrase, label in PHRASES.items():
        sought = phrase.encode()
        if any(w not in lowered for w in sought.split()):
            continue
        if line is None:
            line = b" " + b" ".join(lowered.translate(NORMAL).split()) + b" "
        at = line.find(b" " + sought + b" ")
        while at >= 0:
            places.append((at, label))
            at = line.find(b" " + sought + b" ", at + 1)
    if not places:
        return []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    return sorted(zip(np.searchsorted(blanks, [at for at, _ in places]).tolist(), (label for _, label in places)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = sorted({r.keyword for r in rules()})
    for part in slices(batches):
        words = Words(part.column("text"), ALNUM, lower=True)
        whole = words.data.tobytes()
        line = one_blank(whole)
        seen = any(k in line for k in keywords)
        rows = []
        for row, (begin, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())):
            lowered = whole[begin:end] if seen else b""
            places, standing = base_places(lowered), detect(lowered)
            starts = words.starts[words.first[row]: words.first[row + 1]] - begin
            base = sorted({label for _, label in places})
            labels = sorted({*base, *(r.label for _, _, r in standing)})
            score = max([0.5 * bool(places), *(r.weight for _, _, r in standing)])
            rows.append((
                len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), score,
                [{"label": r.label, "first": int(np.searchsorted(starts, a, "right")) - 1, "last": int(np.searchsorted(starts, b)) - 1, "weight": r.weight}
                 for a, b, r in standing]))
        n_base, first, last, base, labels, score, detections = map(list, zip(*rows))
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()),
            pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()),
            pa.array(detections, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("weight", pa.float64())]))),
        ], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base counts, labels, score, and the standing detections with their word intervals.

    Words are runs of letters, digits and characters beyond ASCII, counted from
    0. A null or empty text has no words, empty labels and score 0. The score is
    the largest weight of a detection, at least 0.5 with a base phrase.
    """
    return texts(docs).mapInArrow(_scan, SCHEMA)
