from __future__ import annotations

import re

from shiftledger.llm import licences
from tests.llm.odd import documents, result, rows


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, labels, score = [], set(), set(), 0.0
    for t in (*licences.BASE, *licences.MORE):
        own, (first, last) = t.words, t.key_at
        for at in range(1 - len(own), len(words)):
            there = [words[at + i] if 0 <= at + i < len(words) else None for i in range(len(own))]
            share = sum(a == b for a, b in zip(own, there, strict=True)) / len(own)
            if there[first:last] == own[first:last] and share >= (1 if t in licences.BASE else licences.ENOUGH):
                labels.add(t.label)
                score = max(score, share)
                if t in licences.BASE:
                    places.append(at)
                    base.add(t.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    "Under the MIT License.", "under-the_mit/license under the mit license", "Apache License, Version 2.0 cc by-nc 4.0; CC BY NC",
    "under the mit", "the mit license", "cc by cc by nc", "underé the mit license", "Licensed under a GNU General Public License",
    "GNU General Public License", "under the GNU General Public License v3", "Permission is hereby granted, free of charge, to any individual obtaining a copy of this software",
    "hereby granted free of charge to any person obtaining a copy of this software", "redistribution and use in source and binary forms, with or without modification, are permitted",
    "All rights\x00reserved", "K under the mit licen\u017fe", "apache license version 2 " * 3000, "mit " * 5000,
]


def test_scans_like_brute_force(spark):
    data = rows() + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1000, TEXTS[0])]
    want = sorted(((d, *plain(t)) for d, t in data), key=repr)
    assert result(licences.scanned(documents(spark, data))) == want


def test_empty_table_and_plan(spark):
    none = documents(spark, rows()[:1]).limit(0)
    assert licences.scanned(none).count() == 0
    plan = licences.scanned(documents(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_whole_key_phrase_is_found_whatever_other_words_slip_or_are_rare(spark):
    """The words that slip are the rarest of their template, and the key's words are frequent."""
    texts = [
        "redistribution and use in source and binary forms with or without changes are allowed",
        "so redistribution and use in source and binary forms with or without changes are allowed here",
        "permission is hereby granted free of charge to any individual receiving one copy of the software",
        "permission is hereby granted free of charge to any individual receiving one copy of that thing",
        "licenced under the gnu general public license",
        "redistribution and use in source and binary form with or without modification are permitted",
    ]
    common = [" ".join(t.key for t in licences.MORE if t.key)] * 5
    data = [(i, t) for i, t in enumerate(texts + common)]
    found = result(licences.scanned(documents(spark, data)))
    assert found == sorted(((d, *plain(t)) for d, t in data), key=repr)
    labels = {d: row for d, *_, row, _ in found}
    assert labels[0] == labels[1] == "bsd" and labels[2] == "mit" and labels[5] == ""
