"""License scans: exact phrases, and short notices with typing errors.

Two searches run over the words and the characters of every whole text after A-Z became a-z. Phrases are sequences of
words that must stand consecutively. Notices are found with up to k edits: a notice is cut into k + 1 seeds, so
at least one seed stands unchanged in any occurrence (pigeonhole). An automaton finds all seeds in one pass; only around
those the regex library's bounded-error matching verifies the notice and reports its span and edits. Words that name the
license take one edit per three letters; a version number takes one damaged or missing character, but no other digit, and
one of a single digit must stand as it is.

Defined results: null and empty texts have no words, no places and empty labels, score 0; a phrase counts at every
place where it starts; of overlapping occurrences of one notice the best is reported; repeated rows are scanned each
on their own; an empty table gives no rows. Only the id and text columns are read, other columns cannot clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from heatgrid.llm.common import LETTER_WORDS, LOWER, Words, map_texts, slices, text_bytes

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, notice), lower case. Labels follow the usual short identifiers of licenses.
NOTICES = [
    ("apache-2.0", "licensed under the apache license, version 2.0"),
    ("gpl-2.0", "licensed under the gnu general public license, version 2"),
    ("gpl-3.0", "licensed under the gnu general public license, version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification"),
    ("mpl-2.0", "subject to the terms of the mozilla public license, v. 2.0"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by-sa 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by-nc 4.0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1.0"),
]

#: Words of the notices that name a license.
NAMES = ("mit", "apache", "gnu", "lesser", "affero", "mozilla", "cc", "by", "sa", "nc", "cc0")
_WORD = regex.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z][a-z0-9]*")


PIECE = 8  # notices to a piece of a long row of them


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    seeds: tuple[tuple[int, str], ...]

    @classmethod
    def cut(cls, label: str, text: str, chars_per_edit: int) -> Notice:
        edits = max(1, len(text) // chars_per_edit)
        bounds = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
        return cls(label, text, edits, tuple((a, text[a:b]) for a, b in zip(bounds, bounds[1:])))

    def pattern(self, names: Sequence[str]) -> regex.Pattern:
        """The best match with up to `edits` edits, of them few in names and versions."""
        parts, at = [], 0
        for m in _WORD.finditer(self.text):
            word, version = regex.escape(m[0]), m[0][0].isdigit()
            if not version and m[0] not in names:
                continue
            edits, others = (int(len(m[0]) > 1) if version else len(m[0]) // 3), ":[^0-9]" if regex.search("[0-9]", m[0]) else ""
            # the library drops a bound of 0 within a fuzzy group, but looks ahead exactly
            word = f"(?:{word}){{e<={edits}{others}}}" if edits else f"(?={word}){word}"
            word = f"(?<![0-9]){word}(?![0-9])" if version else word
            parts += [regex.escape(self.text[at: m.start()]), word]
            at = m.end()
        return regex.compile(f"(?b)(?:{''.join(parts)}{regex.escape(self.text[at:])}){{e<={self.edits}}}")


class NoticeSearch:
    """Seed automaton and verifying patterns of some notices; one edit is allowed for every `chars_per_edit` characters."""

    def __init__(self, notices: Sequence[tuple[str, str]], chars_per_edit: int, names: Sequence[str] = NAMES):
        self.notices = [Notice.cut(label, text, chars_per_edit) for label, text in notices]
        self.patterns = [n.pattern(names) for n in self.notices]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, seed in notice.seeds:
                owners.setdefault(seed, []).append((i, offset))
        for seed, found in owners.items():
            self.automaton.add_word(seed, (len(seed), found))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def _matches(self, i: int, text: str, lo: int, hi: int) -> Iterator[regex.Match]:
        """The best match of a window, then those of the stretches before and behind it, until none is left."""
        least, todo = max(1, len(self.notices[i].text) - self.notices[i].edits), [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            m = self.patterns[i].search(text, lo, hi) if hi - lo >= least else None
            if m and m.end() > m.start():
                yield m
                todo += [(lo, m.start()), (m.end(), hi)]

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in characters, in order."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, owners) in self.automaton.iter(text) if self.any else ():
            for i, offset in owners:
                notice = self.notices[i]
                start = last + 1 - length - offset
                lo, hi = max(0, start - notice.edits), min(len(text), start + len(notice.text) + notice.edits + 1)
                spans = windows.setdefault(i, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                    spans[-1][0] = min(spans[-1][0], lo)
                else:
                    spans.append([lo, hi])
        found = set()
        for i, spans in windows.items():
            notice = self.notices[i]
            reach = len(notice.text) + 2 * notice.edits + 1
            for lo, hi in spans:
                # a long row of seeds is searched in pieces that overlap by more than a notice, so its cost grows with its length
                for at in range(lo, max(lo + 1, hi - reach), PIECE * reach):
                    for m in self._matches(i, text, at, min(hi, at + (PIECE + 1) * reach)):
                        found.add((notice.label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice.text)))
        # one notice can lie in another one's span (versions of one license): the fewest edits win there
        starts: list[int] = []
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: (f[3] / f[4], -f[4], f[1], f[0])):
            place = bisect.bisect_left(starts, f[1])  # kept spans do not overlap, so only the neighbours can
            if (place == 0 or kept[place - 1][2] <= f[1]) and (place == len(kept) or f[2] <= starts[place]):
                starts.insert(place, f[1])
                kept.insert(place, f)
        return kept


def phrase_places(words: Words, data: np.ndarray, phrases: Mapping[str, str]) -> list[tuple[str, np.ndarray]]:
    """For each phrase its label and the numbers of the words at which it starts within one document."""
    doc_end = np.repeat(words.first[1:], np.diff(words.first))
    folded = LOWER
    places = []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        known = Words(np.frombuffer(phrase.encode(), np.uint8), np.array([0, len(phrase.encode())]), LETTER_WORDS, LOWER).hash
        hits = np.flatnonzero(words.hash == known[0])
        hits = hits[hits + len(parts) <= doc_end[hits]] if len(hits) else hits
        for k in range(1, len(parts)):
            hits = hits[words.hash[hits + k] == known[k]]
        sure = [h for h in hits.tolist() if all(folded[data[words.starts[h + k]: words.ends[h + k]]].tobytes() == part for k, part in enumerate(parts))]
        places.append((label, np.array(sure, np.int64)))
    return places


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
                  notices: Sequence[tuple[str, str]] = NOTICES, chars_per_edit: int = 10, names: Sequence[str] = NAMES) -> DataFrame:
    """One row per document: its words, the places of phrases, the notices with span and edits, labels and a score.

    The score is 1 for an exact phrase, else the best notice's share of unchanged characters, else 0.
    """
    phrases, notices, names = dict(phrases), list(notices), tuple(names)
    kept: dict[str, NoticeSearch] = {}
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "it" not in kept:
            kept["it"] = NoticeSearch(notices, chars_per_edit, names)
        search = kept["it"]
        data, offsets = text_bytes(batch.column(1))
        rows: list[tuple] = []
        for a, b in slices(offsets):
            part, bounds = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
            words = Words(part, bounds, LETTER_WORDS, LOWER)
            places: dict[int, list[tuple[int, str]]] = {}
            for label, hits in phrase_places(words, part, phrases):
                for hit, d in zip(hits.tolist(), (np.searchsorted(words.first, hits, side="right") - 1).tolist()):
                    places.setdefault(d, []).append((hit - int(words.first[d]), label))
            raw = part.tobytes().lower()
            for d in range(b - a):
                spans = search.find(raw[bounds[d]: bounds[d + 1]].decode())
                at = places.get(d, [])
                base = {label for _, label in at}
                score = 1.0 if at else max((1.0 - f[3] / f[4] for f in spans), default=0.0)
                rows.append((
                    int(words.first[d + 1] - words.first[d]), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in spans})), max(0.0, score),
                    [{"label": f[0], "start": f[1], "end": f[2], "edits": f[3]} for f in spans],
                ))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    out = map_texts(docs, {"id": F.col(id_col)}, F.col(text), work, [
        ("id", docs.schema[id_col].dataType), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"),
        ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("notices", "array<struct<label:string,start:bigint,end:bigint,edits:int>>"),
    ])
    return out.withColumnRenamed("id", id_col)
