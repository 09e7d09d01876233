"""Base phrases against brute force, and the suppression of overlapping detections."""

import re
from collections import Counter

from corpusloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(rows):
    out = []
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(i, name) for name, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in at]
        out.append((doc_id, len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in at}))))
    return Counter(out)


def base_of(docs):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())


ROWS = [
    (1, "Licensed under CC BY-NC 4.0. All Rights, reserved!"), (2, None), (3, ""), (4, "...  \n"), (5, "CC BY CC BY cc-by"),
    (6, "GNU General Public License, version 3 or later. general public license"), (7, "xcc by cc byx É-general public license"),
    (8, "all rights reserved " * 3000), (8, "Ünïcode all rights reserved all rights reserved"), (9, "cc by"), (9, "cc by"), (None, "All rights reserved."),
    (10, "The Apache License, Version 2.0"), (11, "Released under the MIT License."), (12, "SPDX-License-Identifier: Apache-2.0"), (13, "a " * 50_000 + "cc by"),
]


def test_base_equals_brute_force(make_docs):
    assert base_of(make_docs(ROWS)) == brute(ROWS)
    assert base_of(make_docs([])) == Counter()


def test_base_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert base_of(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_rules_priorities_and_containment(make_docs):
    labels = {(r.doc_id, r.n_words): (set(filter(None, r.labels.split(","))), r.score) for r in licenses.scan(make_docs(ROWS)).collect()}
    assert labels[1, 10][0] == {"cc-by", "cc-by-nc-4.0", "licensed-under", "reserved"}  # "cc by nc" and "cc by" lie inside the versioned one
    assert labels[6, 11][0] == {"gpl", "gpl-3.0-or-later", "gpl-any"}  # the second mention stands alone
    assert labels[10, 6][0] == {"apache-2.0"}
    assert labels[11, 5][0] == {"mit-released"}
    assert labels[12, 6] == ({"apache-2.0"}, 1.0)
    assert labels[2, 0] == (set(), 0.0)
    assert len(licenses.rules()) > 300


def test_extra_columns_with_clashing_names(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs(ROWS[:6]).withColumns({c: F.lit("x") for c in ("words", "th", "hits", "base", "label", "_id")})
    assert base_of(docs) == brute(ROWS[:6])


def test_or_later_in_real_headers(make_docs):
    header = " * it under the terms of the GNU {}General Public License as\n * published by the Free Software Foundation{} either version {} of the\n * License, or (at your option) any later version."
    texts = [header.format("", ";", "2"), header.format("", ",", "3"), header.format("Lesser ", ";", "2.1"), header.format("Library ", ";", "2"), header.format("Affero ", ",", "3")]
    texts += ["GPL-3.0+", "under LGPL 2.1+ here", "GPLv2+", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: AGPL-3.0+", "GPL-2.0 only", "GNU GPL version 2", "GPLv3, C++"]
    want = ["gpl-2.0-or-later", "gpl-3.0-or-later", "lgpl-2.1-or-later", "lgpl-2.0-or-later", "agpl-3.0-or-later", "gpl-3.0-or-later", "lgpl-2.1-or-later", "gpl-2.0-or-later", "gpl-2.0-or-later", "agpl-3.0-or-later", "gpl-2.0-only", "gpl-2.0", "gpl-3.0"]
    rows = list(enumerate(texts))
    labels = {r.doc_id: [v for v in r.labels.split(",") if v not in ("gpl", "")] for r in licenses.scan(make_docs(rows)).collect()}
    assert [labels[k] for k in range(len(texts))] == [[w] for w in want]
    assert base_of(make_docs(rows)) == brute(rows)


def test_signs_between_phrases_never_join_words(make_docs):
    """A plus after a GNU version is a sign like any other to words and base phrases."""
    said = ["GPL-3.0", "General Public License 2", "CC BY", "all rights reserved", "LGPL2", "GPL v3", "foo"]
    texts = [a + sign + b for a in said for b in said for sign in ("+", "++", " + ", "+\n", "+-", "-", "_", "/", ".", ";", "\x7f", "\x00", " ")]
    texts += ["GPL-3.0+CC BY here", "General Public License 2+all rights reserved", "GPL-2.0+foo", "GPL2+LGPL2+x y", "GPL-3.0\u207aCC BY", "GPL-3.0+\u207ax"]
    rows = list(enumerate(texts))
    assert base_of(make_docs(rows)) == brute(rows)


def samples(pattern, full):
    """A shortest string that the pattern matches, or one with every optional part."""
    from re import _constants as c
    from re import _parser

    def text(parts):
        out = ""
        for op, arg in parts:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.NOT_LITERAL:
                out += "x"
            elif op is c.IN:
                out += "x" if arg[0][0] is c.NEGATE else chr(arg[0][1] if arg[0][0] is c.LITERAL else arg[0][1][0])
            elif op is c.BRANCH:
                out += text(arg[1][-1 if full else 0])
            elif op is c.SUBPATTERN:
                out += text(arg[3])
            elif op is c.MAX_REPEAT:
                low, high, inner = arg
                out += text(inner) * (min(int(high), 24) if full and int(high) < 100 else low)
            else:
                assert op is c.ASSERT_NOT, op
        return out

    return text(_parser.parse(pattern))


def test_every_match_holds_its_gate_and_keyword_and_lies_within_reach():
    for r in licenses.rules():
        for full in (False, True):
            found = samples(r["pattern"], full)
            assert re.fullmatch(r["pattern"], found), r
            assert r["keyword"] in found, (r, found)
            stems = [found[: m.start()].count(" ") for m in re.finditer(f"(?:^|(?<= )){r['gate']}", found)]
            assert r["gate"] in licenses.GATES and stems and found.count(" ") - min(stems) < licenses.REACH and max(stems) < licenses.REACH, (r, found)


def test_spans_are_those_of_the_whole_text(make_docs):
    filler = "lorem ipsum " * 300
    text = f"{filler}Licensed under the Apache License, Version 2.0. {filler}Released under the MIT License. x y z MIT License {filler}"
    rows = licenses.scanned(make_docs([(1, text), (2, "mit license"), (3, filler)]))
    got = {(r.doc_id, r.label, r.begin, r.stop) for r in licenses.detections(rows).collect()}
    words = WORD.findall(text.lower())
    at = words.index("apache") - 3
    assert (1, "apache-header", at, at + 8) in got and (2, "mit", 0, 2) in got and not [g for g in got if g[0] == 3]
    assert {" ".join(words[b:e]) for d, label, b, e in got if d == 1 and label.startswith("mit")} == {"released under the mit license", "mit license"}


def test_long_texts_full_of_stems(make_docs):
    rows = [(1, "license " * 30_000), (2, ("cc by " + "w " * 100) * 2_000)]
    assert base_of(make_docs(rows)) == brute(rows)
