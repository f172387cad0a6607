"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a stretch of ``BLOCK`` words of a longer line, half of it shared with the next; with ``across``, such
stretches of the whole text are blocks too, of twice the words of the longest template if that is more, so that wrapped lines
hide no template. A template meets a
block if the block holds at least ``CONTAINED`` of its distinct words. Words are ordered by their frequency in the whole
corpus, rarest first. A block that meets a template of n words holds a of them, a = ceil(CONTAINED n), and so one of the n - a + 1
rarest (prefix filter), and has a template words at all (length filter); where the two agree, the
words before and behind that place must allow a common words (positional filter). What passes is counted exactly, so every such block is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from . import words as w
from .lean import lean

U = w.U
BLOCK, CONTAINED = 128, 0.8
# Phrases whose every occurrence is counted, and the label of each.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Sentences of well-known public licenses, and the label of each.
TEMPLATES = {
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-terms": "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-terms": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License",
    "mit-notice": "Released under the MIT License",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-notice": "subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain-notice": "This is free and unencumbered software released into the public domain",
}
# What tells a license from others with much the same words; a block must hold one of these, word for word.
REQUIRED = {
    "agpl-notice": ("gnu affero general public license",),
    "apache-2.0-notice": ("apache license version 2", "apache license 2", "apache license v2", "apache 2"),
    "apache-2.0-terms": ("as is basis",),
    "bsd-terms": ("source and binary forms",),
    "cc-by-notice": ("creative commons attribution 4", "creative commons attribution 3", "creative commons attribution 2", "creative commons attribution 1"),
    "cc-by-nc-notice": ("cc by nc 4", "cc by nc 3", "cc by nc 2", "cc by nc 1"),
    "cc-by-sa-notice": ("cc by sa",),
    "gpl-3.0-notice": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license 3"),
    "gpl-terms": ("gnu general public license",),
    "isc-terms": ("without fee",),
    "lgpl-notice": ("gnu lesser general public license", "gnu library general public license"),
    "mit-notice": ("mit license",),
    "mit-terms": ("obtaining a copy", "copy of this software"),
    "mpl-2.0-notice": ("mozilla public license v 2", "mozilla public license version 2", "mozilla public license 2"),
    "public-domain-notice": ("free and unencumbered", "into the public domain"),
}


def _hashes(text: str) -> np.ndarray:
    return next(w.blocks(pa.array([text]), w.ALNUM, True)).hashes


@dataclass
class Index:
    """Templates as sets of ranks in the frequency order of their words."""

    vocabulary: np.ndarray  # sorted hashes
    rank: np.ndarray  # of each
    labels: list[str]
    size: np.ndarray
    least: np.ndarray  # words that a block must hold
    prefix: np.ndarray  # (template, rank, position) of prefixes, by rank
    member: np.ndarray  # (templates, ranks)

    @classmethod
    def build(cls, templates: dict[str, str], frequency: dict[int, int], contained: float) -> Index:
        sets = [np.unique(_hashes(t)) for t in templates.values()]
        vocabulary = np.unique(np.concatenate([*sets, np.zeros(0, U)]))
        count = np.array([frequency.get(k, 0) for k in range(len(vocabulary))])
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.lexsort((np.arange(len(vocabulary)), count))] = np.arange(len(vocabulary))
        size = np.array([len(s) for s in sets])
        least = np.array([math.ceil(contained * n - 1e-9) for n in size])
        member, prefix = np.zeros((len(sets), len(vocabulary)), bool), []
        for t, s in enumerate(sets):
            r = np.sort(rank[np.searchsorted(vocabulary, s)])
            member[t, r] = True
            prefix += [(t, x, i) for i, x in enumerate(r[: size[t] - least[t] + 1].tolist())]
        prefix = np.array(sorted(prefix, key=lambda x: x[1]), np.int64).reshape(-1, 3)
        return cls(vocabulary, rank, list(templates), size, least, prefix, member)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are template words, and the vocabulary's entry of each of those."""
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[k] == h)
        return at, k[at]

    def join(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, share of it) for all that meet, from distinct (block, rank) pairs in order."""
        first = np.searchsorted(block, block)
        width = np.searchsorted(block, block, "right") - first
        position = np.arange(len(block)) - first
        lo, hi = np.searchsorted(self.prefix[:, 1], rank), np.searchsorted(self.prefix[:, 1], rank, "right")
        n = hi - lo
        row = np.repeat(np.arange(len(block)), n)
        p = self.prefix[lo[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        t = p[:, 0]
        before = np.minimum(p[:, 2], position[row])
        after = np.minimum(self.size[t] - p[:, 2], width[row] - position[row])  # this word and those behind it
        ok = (width[row] >= self.least[t]) & (before + after >= self.least[t])
        pairs = np.unique(np.stack([first[row[ok]], t[ok]]), axis=1)
        a, t = pairs
        size = np.searchsorted(block, block[a], "right") - a
        inside = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        held = np.bincount(np.repeat(np.arange(len(a)), size), self.member[np.repeat(t, size), rank[inside]], len(a))
        good = held >= self.least[t]
        return block[a[good]], t[good], held[good] / self.size[t[good]]


def _block_of(b: w.Words, limit: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each word, its block, and a second one where blocks of a long line overlap (-1: none). Blocks are numbered over all
    texts, by their first word; with ``across``, a text counts as one line."""
    n = len(b.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = b.doc()
    line = np.zeros(n, np.int64) if across else np.cumsum(b.data == 0x0A)[b.starts]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))[np.cumsum(new) - 1]
    half = (np.arange(n) - start) // (limit // 2)
    long = size > limit
    main = np.where(long, start + half * (limit // 2), start)
    other = np.where(long & (half > 0), start + (half - 1) * (limit // 2), -1)
    return main, other


def _frequencies(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            n = np.zeros(len(index.vocabulary), np.int64)
            for b in w.blocks(batch["text"], w.ALNUM, True):
                n += np.bincount(index.places(b.hashes)[1], minlength=len(n))
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["word", "n"])

    return run


def _phrases(b: w.Words, phrases: list[tuple[np.ndarray, str]]) -> list[tuple[np.ndarray, str]]:
    """Places, over all words, where each phrase starts within one text."""
    out, doc = [], b.doc()
    for h, label in phrases:
        at = np.flatnonzero(b.hashes == h[0])
        at = at[at + len(h) <= len(doc)]
        for k in range(1, len(h)):
            at = at[b.hashes[at + k] == h[k]]
        out.append((at[doc[at] == doc[at + len(h) - 1]], label))
    return out


def _blocks_of(b: w.Words, limit: int, across: int) -> list[np.ndarray]:
    """For each word, its blocks (-1: none); those of whole texts, of ``across`` words if any, are numbered after all others."""
    out = [*_block_of(b, limit)]
    if across:
        out += [np.where(x < 0, -1, x + len(b.starts)) for x in _block_of(b, across, True)]
    return out


def _holders(b: w.Words, blocks: list[np.ndarray], required: list[tuple[int, np.ndarray]], templates: int) -> np.ndarray:
    """block * templates + template of each block that holds a required phrase of the template."""
    out = [np.zeros(0, np.int64)]
    for (t, h), (at, _) in zip(required, _phrases(b, [(h, "") for _, h in required]), strict=True):
        for x in blocks:
            for y in blocks:
                same = x[at] == y[at + len(h) - 1]
                out.append(x[at][same & (x[at] >= 0)] * templates + t)
    return np.unique(np.concatenate(out))


def _scanned(shared, limit: int, across: int):
    def run(batches):
        index, phrases, required = shared.value
        needs = np.zeros(len(index.labels), bool)
        needs[[t for t, _ in required]] = True
        for batch in batches:
            rows = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for b in w.blocks(batch["text"], w.ALNUM, True):
                base: list[set] = [set() for _ in range(len(b))]
                found, n = _phrases(b, phrases), np.zeros(len(b), np.int64)
                every = np.sort(np.concatenate([at for at, _ in found]))
                doc = b.doc()
                for at, label in found:
                    n += np.bincount(doc[at], minlength=len(b))
                    for d in doc[at].tolist():
                        base[d].add(label)
                labels, score = [set(x) for x in base], np.where(n > 0, 1.0, 0.0)
                at, k = index.places(b.hashes)
                of = _blocks_of(b, limit, across)
                every_block = np.concatenate([x[at] for x in of])
                pairs = np.stack([every_block, index.rank[np.tile(k, len(of))]])[:, every_block >= 0]
                block, t, share = index.join(*np.unique(pairs, axis=1))
                good = ~needs[t] | np.isin(block * len(needs) + t, _holders(b, of, required, len(needs)))
                block, t, share = block[good], t[good], share[good]
                for d, x, s in zip(doc[block % max(len(doc), 1)].tolist(), t.tolist(), share.tolist(), strict=True):
                    labels[d].add(index.labels[x])
                    score[d] = max(score[d], s)
                first = np.searchsorted(every, b.at[:-1])
                rows["n_words"] += b.counts().tolist()
                rows["n_base"] += n.tolist()
                rows["first_word"] += [int(every[f]) - int(a) if m else None for f, a, m in zip(first, b.at[:-1], n, strict=True)]
                rows["last_word"] += [int(every[f + m - 1]) - int(a) if m else None for f, a, m in zip(first, b.at[:-1], n, strict=True)]
                rows["base_labels"] += [",".join(sorted(x)) for x in base]
                rows["labels"] += [",".join(sorted(x)) for x in labels]
                rows["score"] += score.tolist()
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["doc_id", *rows])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, across: bool = False, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs`` (doc_id, text).

    score is 1 where a phrase stands, else the largest share of a template held by a block that meets it, else 0. Null
    and empty texts have no words, no labels ('') and score 0. An empty table gives no rows. ``across``: see above.
    A block meets a template that is in ``required`` only if it also holds one of the phrases given there.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = Index.build(templates, {}, contained)
    counts = docs.select("text").mapInArrow(lean(_frequencies(spark.sparkContext.broadcast(first))), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    index = Index.build(templates, {r.word: r.n for r in counts.collect()}, contained)
    phrases = [(_hashes(p), label) for p, label in PHRASES.items()]
    stretch = max([BLOCK, *(2 * len(_hashes(t)) for t in templates.values())]) if across else 0
    needed = [(t, _hashes(p)) for t, label in enumerate(index.labels) for p in (required or {}).get(label, ())]
    return docs.mapInArrow(lean(_scanned(spark.sparkContext.broadcast((index, phrases, needed)), BLOCK, stretch)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
