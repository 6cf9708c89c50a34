"""License scans with a positional index of rare licence words, verified by mandatory key phrases.

The licence vocabulary is small and fixed; its document frequencies are counted over all documents first. The index
keeps, for each template, the positions of its words of highest inverse document frequency. A file looks up every
place of an indexed word; each posting gives the place at which the template would start. Templates for which enough
distinct rare words agree on a start (within ``slack`` words) are candidates, and a candidate counts only where one of
its key phrases stands word for word near that start. Plain phrase search gives the base labels beside that.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import WORDS_ONLY, map_texts

#: Phrases that give a base label wherever their words stand one after the other.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, licence notice (public texts, normalised to words), mandatory key phrases.
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["under the mit license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ["gnu general public license version 3", "general public license version 3"],
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    (
        "bsd-3-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify and or distribute this software"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w.encode() for _, text, _ in templates for w in text.split())


def word_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, licence word -> documents that hold it), over all documents. The result has one row per word."""

    def rows():
        words = vocabulary(templates)

        def of(ids, texts):
            found: Counter[bytes] = Counter()
            for t in texts:
                found.update(words.intersection(t.translate(WORDS_ONLY).split()))
            return {"word": [b"", *found], "n": [len(texts), *found.values()]}

        return of

    source = docs.select(F.lit(0).alias("i"), text_col)
    counted = map_texts(source, "i", text_col, rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r.word): r.n for r in counted.collect()}
    return counts.pop(b"", 0), counts


class RareIndex:
    """Positions of the ``rare`` words of highest IDF of each key phrase of each template."""

    def __init__(self, n_docs: int, counts: dict[bytes, int], templates=TEMPLATES, rare: int = 4, slack: int = 3):
        self.slack, self.labels, self.need, self.sizes, self.phrases = slack, [], [], [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        idf = lambda w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) + 1
        for k, (label, text, phrases) in enumerate(templates):
            words = text.encode().split()
            # those of each mandatory phrase apart: a file with just one of them must be found through it
            best = {w for p in phrases for w in sorted(set(p.encode().split()), key=lambda w: (-idf(w), w))[:rare]}
            for at, w in enumerate(words):
                if w in best:
                    self.postings[w].append((k, at))
            self.labels.append(label)
            self.sizes.append(len(words))
            self.need.append(min(2, *(len(set(p.split())) for p in phrases)) if phrases else 2)
            self.phrases.append([p.encode().split() for p in phrases])
        self.weight = {w: idf(w) for w in vocabulary(templates)}
        self.total = [sum(self.weight[w] for w in text.encode().split()) for _, text, _ in templates]
        self.words = [text.encode().split() for _, text, _ in templates]

    def scan(self, words: list[bytes]) -> tuple[dict[str, tuple[int, int]], float]:
        """Labels with their first and last verified place, and the share of the best template's weight that is there."""
        postings = self.postings
        rare = [(i, w) for i, w in enumerate(words) if w in postings]
        if not rare:
            return {}, 0.0
        starts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in rare:
            for k, at in postings[w]:
                starts[k].append((i - at, w))
        found: dict[str, tuple[int, int]] = {}
        score = 0.0
        for k, places in starts.items():
            places.sort()
            low = 0
            near: Counter[bytes] = Counter()
            done = None
            for start, w in places:
                near[w] += 1
                while places[low][0] < start - self.slack:
                    near[places[low][1]] -= 1
                    if not near[places[low][1]]:
                        del near[places[low][1]]
                    low += 1
                if len(near) < self.need[k] or (done is not None and start <= done):
                    continue
                first, last = max(0, start - self.slack), start + self.sizes[k] + self.slack
                for p in self.phrases[k]:
                    m = len(p)
                    at = next((j for j in range(first, min(last, len(words)) - m + 1) if words[j : j + m] == p), None)
                    if at is not None:
                        seen = found.get(self.labels[k], (at, at))
                        found[self.labels[k]] = (min(seen[0], at), max(seen[1], at))
                        here = Counter(words[first:last]) & Counter(self.words[k])
                        score = max(score, sum(self.weight[x] * n for x, n in here.items()) / self.total[k])
                        done = start
                        break
        return found, min(1.0, score)


def base_places(words: list[bytes]) -> dict[str, list[int]]:
    """Base label -> the places where one of its phrases starts."""
    ends = [i for i, w in enumerate(words) if w == b"license"]
    found: dict[str, list[int]] = {}
    for phrase, label in BASE.items():
        p = phrase.encode().split()
        m = len(p)
        if places := [i - m + 1 for i in ends if i >= m - 1 and words[i - m + 1 : i + 1] == p]:
            found.setdefault(label, []).extend(places)
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: base places, labels and score.

    Returns id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: every template's
    label with its first and last verified place. Null and empty texts have no words, no labels (empty strings) and
    score 0. The score is 1 for a base phrase or a whole notice, else the weight of the best verified notice that is
    there. Only the fixed vocabulary's counts go through the driver; other columns are ignored.
    """
    n_docs, counts = word_frequencies(docs, templates, text_col)

    def rows():
        index = RareIndex(n_docs, counts, templates)

        def of(ids, texts):
            out = defaultdict(list)
            for t in texts:
                words = t.translate(WORDS_ONLY).split()
                out["n_words"].append(len(words))
                base = base_places(words) if b"license" in words else {}
                places = [i for x in base.values() for i in x]
                more, score = index.scan(words)
                out["n_base"].append(len(places))
                out["first_word"].append(min(places) if places else None)
                out["last_word"].append(max(places) if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted({*base, *more})))
                out["score"].append(1.0 if places else score)
                out["spans"].append([{"label": k, "first": a, "last": b} for k, (a, b) in sorted(more.items())])
            return {"id": ids, **out}

        return of

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first: long, last: long>>"
    )
    return map_texts(docs, id_col, text_col, rows, schema).withColumnRenamed("id", id_col)
