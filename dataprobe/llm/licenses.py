"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line; a block meets a template if it holds at least ``threshold`` of the template's different words.
The words of all templates are ordered by how many blocks of the whole corpus hold them. A block can only meet a
template if it holds one of the template's rarest words (prefix filter), has enough words (length filter), and, by
the places of that word in both ordered sets, can still reach the needed overlap (positional filter). What passes
is counted exactly. With ``wrapped``, windows over consecutive lines are blocks as well, as many words long as a
template with its share of ``threshold`` allows, where none of their lines meets the template alone. Templates are a parameter given in the program, so their index travels with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import Hashed, chunks, column, encode

THRESHOLD = 0.9

# fixed values: phrases of the base scan with their labels
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: common license notices
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _hashes(text: str) -> np.ndarray:
    return Hashed([text.encode()]).h


def _blocks(w: Hashed) -> np.ndarray:
    """For each word the number of its line, counted over all texts of the chunk."""
    a = np.frombuffer(w.src, dtype=np.uint8)
    breaks = a == 10
    breaks[w.at[1:-1] - 1] = True  # the blank between two texts
    return np.concatenate([[0], np.cumsum(breaks)])[w.start]


def _known(w: Hashed, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, word number in the vocabulary, index of a word) of the vocabulary words, each once per block."""
    if not len(vocabulary) or not len(w.h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(vocabulary, w.h), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[number] == w.h)
    block = _blocks(w)[at]
    _, once = np.unique(block * len(vocabulary) + number[at], return_index=True)
    return block[once], number[at[once]], at[once]


def block_counts(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Blocks of the whole corpus that hold each vocabulary word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            raws = [encode(t) for t in column(b, "text")]
            for lo, hi in chunks(raws):
                total += np.bincount(_known(Hashed(raws[lo:hi]), vocabulary)[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary), dtype=np.int32)), pa.array(total)], ["word", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in texts.mapInArrow(scan, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per vocabulary word
        out[r["word"]] = r["n"]
    return out


class Index:
    """Templates as sets of ranks (0 is the rarest vocabulary word), with the prefix words that lead to each."""

    def __init__(self, sets: list[np.ndarray], labels: list[str], counts: np.ndarray, threshold: float):
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sets = [np.sort(self.rank[s]) for s in sets]
        self.labels = labels
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for place, word in enumerate(s[: len(s) - self.need[t] + 1].tolist()):
                self.prefix.setdefault(word, []).append((t, place))

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """(template, containment) of the templates that a block, as ascending ranks, meets."""
        out, seen = [], set()
        for place, word in enumerate(block):
            for t, at in self.prefix.get(word, ()):
                if t in seen:
                    continue
                size = len(self.sets[t])
                # words before this one are in at most one of the two sets, or this template would have been seen
                if len(block) < self.need[t] or 1 + min(size - at - 1, len(block) - place - 1) < self.need[t]:
                    continue
                seen.add(t)
                overlap = len(np.intersect1d(self.sets[t], block, assume_unique=True))
                if overlap >= self.need[t]:
                    out.append((t, overlap / size))
        return out


def _windows(w: Hashed, vocabulary: np.ndarray, index: Index, spans: list[int], met: set[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    """(index of the first word, template, containment) of windows over lines; of overlapping ones the best. ``met``:
    (line, template) that match already."""
    if not len(vocabulary) or not len(w.h):
        return
    number = np.minimum(np.searchsorted(vocabulary, w.h), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[number] == w.h)
    ranks, line = index.rank[number[at]], _blocks(w)
    for t, s in enumerate(index.sets):
        need = index.need[t]
        inside = np.zeros(len(vocabulary), bool)
        inside[s] = True
        mine = inside[ranks]
        pos, own = at[mine], ranks[mine]
        # prefix filter: a window holds one of the rarest words; length filter: enough of the template's words
        inside[s[len(s) - need + 1 :]] = False
        rare = np.concatenate([[0], np.cumsum(inside[own])])
        end = np.searchsorted(pos, np.minimum(pos + spans[t], w.first[w.doc[pos] + 1]))
        start = np.arange(len(pos))
        ok = (end - start >= need) & (rare[end] > rare[start])
        ok[ok] = line[pos[start[ok]]] != line[pos[end[ok] - 1]]
        best, until = None, -1
        for i in np.flatnonzero(ok).tolist():
            j = int(end[i])
            overlap = len(set(own[i:j].tolist()))
            if overlap < need or any((x, t) in met for x in line[pos[i:j]].tolist()):
                continue
            if best and i >= until:
                yield best
                best = None
            if not best or overlap / len(s) > best[2]:
                best = (int(pos[i]), t, overlap / len(s))
            until = j
        if best:
            yield best


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (line from 0,
    label and containment of every block that meets a template). ``wrapped``: notices broken over lines count too.

    Null texts are empty; texts without words have no labels and score 0. Repeated rows are scanned each. Templates
    without words meet nothing. ``score`` is the highest containment found.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = [(label, np.unique(_hashes(t))) for label, t in templates]
    spans = [max(int(len(_hashes(t)) / threshold + 1e-9), len(h)) for (_, t), (_, h) in zip(templates, kept) if len(h)]
    kept = [(label, h) for label, h in kept if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h in kept])) if kept else np.zeros(0, np.uint64)
    sets = [np.searchsorted(vocabulary, h) for _, h in kept]
    index = Index(sets, [label for label, _ in kept], block_counts(base, vocabulary) if kept else np.zeros(0, np.int64), threshold)
    places = [(_hashes(p), label) for p, label in phrases]
    least = min(index.need, default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [encode(t) for t in column(b, "text")]
            for lo, hi in chunks(raws):
                m = hi - lo
                w = Hashed(raws[lo:hi])
                n_base, first, last = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
                labels: list[set[str]] = [set() for _ in range(m)]
                for p, label in places:
                    n = len(w.h) - len(p) + 1
                    if n <= 0:
                        continue
                    at = np.flatnonzero(w.h[:n] == p[0])
                    for j in range(1, len(p)):
                        at = at[w.h[at + j] == p[j]]
                    at = at[w.doc[at] == w.doc[at + len(p) - 1]]
                    doc = w.doc[at]
                    np.add.at(n_base, doc, 1)
                    np.minimum.at(first, doc, at - w.first[doc])
                    np.maximum.at(last, doc, at - w.first[doc])
                    for d in set(doc.tolist()):
                        labels[d].add(label)
                found: list[list[dict]] = [[] for _ in range(m)]
                block, number, at = _known(w, vocabulary)
                ranks = index.rank[number] if len(number) else number
                by = np.lexsort((ranks, block))
                block, ranks, at = block[by], ranks[by], at[by]
                cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(block) else np.zeros(1, np.int64)
                met: set[tuple[int, int]] = set()

                def add(word: int, t: int, share: float) -> None:
                    d = int(w.doc[word])
                    line = w.src.count(b"\n", w.at[d], w.start[word])
                    found[d].append({"line": line, "label": index.labels[t], "containment": share})

                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if y - x >= least:
                        for t, share in index.matches(ranks[x:y].tolist()):
                            met.add((int(block[x]), t))
                            add(at[x], t, share)
                if wrapped:
                    for x in _windows(w, vocabulary, index, spans, met):
                        add(*x)
                has = n_base > 0
                every = [labels[d] | {x["label"] for x in found[d]} for d in range(m)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0).slice(lo, m), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_base": pa.array(n_base),
                    "first_word": pa.array(first, mask=~has), "last_word": pa.array(last, mask=~has), "base_labels": [",".join(sorted(x)) for x in labels],
                    "labels": [",".join(sorted(x)) for x in every], "score": pa.array([max((x["containment"] for x in f), default=0.0) for f in found], pa.float64()),
                    "blocks": pa.array(found, pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))),
                })

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>")
