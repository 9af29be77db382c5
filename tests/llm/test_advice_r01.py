
import itertools
import random
import re

import pytest

from inkwell.llm import cap_filters, licenses, near_copies


def five_words(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("rows", [None, 3])
def test_pipeline_near_copies_against_all_pairs(spark, monkeypatch, rows):
    """Copies of Jaccard 0.6 to 1, of short and long texts and in small tiles too: exactly the groups at 0.8 go to one document."""
    import corpus_pipeline as cp

    if rows:
        monkeypatch.setattr(near_copies, "TILE_ROWS", rows)
        monkeypatch.setattr(near_copies, "SET_ROWS", rows)
    random.seed(11)
    texts = [" ".join(random.choice("abcdefghij") + str(random.randrange(500)) for _ in range(n)) for n in (8, 9, 12, 20, 30, 60, 100, 200, 400, 900, 2500) for _ in range(3)] + ["", None, "one", "One", "\n"]
    for text in texts[:33]:
        for share in (0.003, 0.01, 0.02, 0.03, 0.05):
            words = text.split()
            for _ in range(max(1, int(share * len(words)))):
                words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = [(k, t, "en", "a", len(t or "")) for k, t in enumerate(texts)]
    sets = [five_words(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(jaccard(sets[a], sets[b]) < 1 for a, b in linked) > 60
    root = components(range(len(texts)), linked)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in dict(cp.STAGES)["simhash"](spark, df, "").collect()}
    assert left == {i for i in root if root[i] == i}


def test_pipeline_takes_passages_of_a_hot_source(spark):
    """A passage of over 50 words in 20 documents, a third of them in one source; short lines and a passage on two sources stay."""
    import corpus_pipeline as cp

    passage, rare = " ".join(f"word{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    sources = ["s0"] * 7 + [f"s{1 + k % 4}" for k in range(13)]
    rows = [(k, f"own {k}\n{passage}\nshort line" + (f"\n{rare}" if k in (0, 8) else ""), "en", s, 0) for k, s in enumerate(sources)]
    got = dict(cp.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    left = {r.doc_id: r.text for r in got.collect()}
    assert {i for i, t in left.items() if passage in t} == {0}
    assert all("short line" in t for t in left.values()) and {i for i, t in left.items() if rare in t} == {0, 8}


@pytest.mark.parametrize("words", [64, 256, 512, 1024])
def test_vectors_are_found_at_any_number_of_words(words):
    """Pairs at cosine 0.93 itself, of another seed than the one that set the filters."""
    assert cap_filters.miss_share(64, words, cap_filters.least_filters(64, words), pairs=1000, seed=77) <= 0.02


SPDX = {
    "MIT": "mit", "X11": "mit", "Apache-2.0": "apache-2", "Apache-1.1": "apache-1.1", "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "BSD-4-Clause": "bsd-4", "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense",
    "Artistic-2.0": "artistic-2", "PSF-2.0": "psf-2", "GPL-2.0-only": "gpl-2", "GPL-3.0-or-later": "gpl-3", "LGPL-2.1-only": "lgpl-2.1", "LGPL-3.0-only": "lgpl-3", "AGPL-3.0-only": "agpl-3", "MPL-2.0": "mpl-2", "MPL-1.1": "mpl-1.1",
    "EPL-1.0": "epl-1", "EPL-2.0": "epl-2", "CDDL-1.0": "cddl-1", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-NC-SA-4.0": "cc-by-nc-sa",
    "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "WTFPL": "wtfpl", "BSL-1.0": "boost-1", "OFL-1.1": "ofl-1.1", "ODbL-1.0": "odbl-1", "EUPL-1.2": "eupl-1.2",
}
BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_license_identifiers_and_bodies(spark):
    cases = [(f"SPDX-License-Identifier: {i}", label) for i, label in SPDX.items()] + [(f"code licensed under {i} here", label) for i, label in SPDX.items()] + [("it is under Apache-2.0", "apache-2")]
    cases += [(text, label) for label, text in BODIES.items()] + [("er kam mit license plates", None), ("the isc and zlib", None)]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    wrong = [(t, got[k].labels) for k, (t, label) in enumerate(cases) if (label in got[k].labels.split(",") and got[k].score > 0.8) != (label is not None)]
    assert wrong == []
