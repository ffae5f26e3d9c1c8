"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased without the marks around them; a shingle is five of them. Templates of up to s shingles are sought in
windows of 2s shingles that begin at every s-th, so that a passage of s shingles lies whole in some window. A window that
holds 80 % of a template's shingles then has a Jaccard similarity with it above a bound that is known beforehand, and as
many bands of one row are taken as miss such a window with probability `miss` at most. Every template that a band retrieves
is checked word by word: the share of its shingles in the window and its surroundings must reach `share`; hashes only retrieve.

Defined cases: null text is the empty text, without matches. Templates of under five words cannot be sought (an error).
Texts of any length are scanned whole; a template is reported once a document, at its best place. Repeated rows give equal
rows; of equally good places the first is told, and templates that begin at one word are told by name. The templates are a parameter that goes to every worker, so their number must stay small. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from texmill.llm.text import small_batches, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
MAX = np.iinfo(np.uint64).max

#: Public notices; fixed texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bare(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}*#$%&|")


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(bare(word).encode())


def spelled(words: list[str], at: int) -> tuple[str, ...]:
    """The words of the shingle that begins at a place."""
    return tuple(map(bare, words[at : at + SHINGLE]))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE word hashes."""
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


@dataclass
class Sizes:
    """Templates of one size class, and their band keys."""

    size: int
    names: list[str]
    sets: list[np.ndarray]
    spelled: list[set[tuple[str, ...]]]
    seeds: np.ndarray
    keys: list[np.ndarray]  # by band: each template's least hash


def banded(values: np.ndarray, seed: np.uint64) -> np.ndarray:
    out = (values ^ seed) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def prepared(templates: Mapping[str, str], share: float, miss: float) -> list[Sizes]:
    sets, told = {}, {}
    for name, text in templates.items():
        own = WORD.findall(text)
        sets[name] = np.unique(shingles(np.array([word_hash(w) for w in own], np.uint64)))
        told[name] = {spelled(own, at) for at in range(len(own) - SHINGLE + 1)}
        if not len(sets[name]):
            raise ValueError(f"{name}: under {SHINGLE} words")
    rng, out = np.random.default_rng(11), []
    for size in sorted({1 << (len(s) - 1).bit_length() for s in sets.values()}):
        names = [n for n, s in sets.items() if 1 << (len(s) - 1).bit_length() == size]
        least = min(len(sets[n]) for n in names)
        window = 1 if size == 1 else 2 * size
        jaccard = min(1.0, share * least / (window + (1 - share) * least))
        bands = 1 if size == 1 else math.ceil(math.log(miss) / math.log(1 - jaccard))
        seeds = rng.integers(1, 1 << 63, bands, dtype=np.uint64)
        keys = [np.array([banded(sets[n], s).min() for n in names]) for s in seeds]
        out.append(Sizes(size, names, [sets[n] for n in names], [told[n] for n in names], seeds, keys))
    return out


def retrieved(values: np.ndarray, valid: np.ndarray, sizes: Sizes) -> set[tuple[int, int]]:
    """(first shingle of a window, template) that share a band key."""
    found: set[tuple[int, int]] = set()
    starts = np.arange(0, len(values), sizes.size)
    for seed, keys in zip(sizes.seeds, sizes.keys, strict=True):
        hashed = np.where(valid, banded(values, seed), MAX)
        least = hashed
        if sizes.size > 1:
            blocks = np.minimum.reduceat(hashed, starts)
            least = np.minimum(blocks, np.append(blocks[1:], MAX))
        order = np.argsort(keys)
        hit = np.flatnonzero(np.isin(least, keys))
        for i in hit.tolist():
            at = np.searchsorted(keys[order], least[i])
            while at < len(keys) and keys[order[at]] == least[i]:
                found.add((int(starts[i]) if sizes.size > 1 else i, int(order[at])))
                at += 1
    return found


def scan(texts: list[str], templates: list[Sizes], share: float, memory: dict[str, int]) -> list[list[tuple[str, int, int, float]]]:
    """For each text its matches (template, first word, end word, containment), by first word and name."""
    split = [WORD.findall(t) for t in texts]
    flat = [w for ws in split for w in ws]
    for w in set(flat):
        if w not in memory:
            memory[w] = word_hash(w)
    lengths = np.array([len(ws) for ws in split], np.int64)
    words = np.fromiter(map(memory.__getitem__, flat), np.uint64, len(flat))
    values, owner = shingles(words), np.repeat(np.arange(len(texts)), lengths)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not len(values):
        return out
    valid = owner[: len(values)] == owner[SHINGLE - 1 :]  # a shingle of two texts is none
    begins = np.cumsum(lengths) - lengths
    best: dict[tuple[int, str], tuple[float, int, int]] = {}
    for sizes in templates:
        for at, k in retrieved(values, valid, sizes):
            low, high = max(0, at - sizes.size), min(len(values), at + 3 * sizes.size)
            place = np.arange(low, high)
            place = place[valid[low:high] & np.isin(values[low:high], sizes.sets[k])]
            equal = {i: t for i in place.tolist() if (t := spelled(flat, i)) in sizes.spelled[k]}
            place = np.array(list(equal), np.int64)
            for text in np.unique(owner[place]).tolist():
                mine = place[owner[place] == text]
                held = len({equal[i] for i in mine.tolist()}) / len(sizes.spelled[k])
                spot = (held, -int(mine[0] - begins[text]), int(mine[-1] - begins[text]) + SHINGLE)
                if held >= share:
                    best[text, sizes.names[k]] = max(best.get((text, sizes.names[k]), spot), spot)
    for (text, name), (held, first, end) in best.items():
        out[text].append((name, -first, end, held))
    return [sorted(x, key=lambda m: (m[1], m[0])) for x in out]


def licensed(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, share: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """doc_id, matches: array of (template, first_word, end_word, containment), for each of docs(doc_id, text)."""
    known = prepared(templates, share, miss)
    kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            if len(memory) > 300_000:
                memory.clear()
            found = scan(batch.column("text").to_pylist(), known, share, memory)
            rows = [[dict(zip(("template", "first_word", "end_word", "containment"), m, strict=True)) for m in ms] for ms in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "matches"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, matches array<struct<template:string,first_word:long,end_word:long,containment:double>>")
