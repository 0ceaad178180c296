import random

from tierline.llm import patience as p


def longest_common_plain(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
        best = row
    return best[-1]


def test_align_keeps_the_anchors_and_stays_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = p.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) <= longest_common_plain(a, b)
        if a and b and a[0] != b[0] and a[-1] != b[-1]:
            once = [b.index(w) for w in a if a.count(w) == 1 and b.count(w) == 1]
            assert len(got) >= len(p.increasing(once))
            # no gap between matches still holds a word unique to both of its sides
            edges = [(-1, -1), *got, (len(a), len(b))]
            for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False):
                x, y = a[i + 1 : i2], b[j + 1 : j2]
                assert not [w for w in x if x.count(w) == 1 and y.count(w) == 1]
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(got) == longest_common_plain(a, b)


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        v = rng.sample(range(12), rng.randint(0, 9))
        got = [v[i] for i in p.increasing(v)]
        best = [[]]
        for x in v:
            best += [s + [x] for s in best if not s or s[-1] < x]
        assert got == sorted(got) and len(got) == max(map(len, best))


def test_found_licenses(spark, documents):
    mit, gpl = p.TEMPLATES["MIT"], p.TEMPLATES["GPL-3.0-notice"]
    changed = gpl.replace("free software", "libre software").replace("modify", "change")
    rows = [
        (1, f"Some text. {mit} More text under the sun.", "en"),
        (2, "word the of " * 9000 + changed, "en"),
        (3, "the license of the word released by version", "en"),
        (4, None, "en"),
        (5, "", None),
        (6, p.TEMPLATES["CC-BY-NC-4.0"].upper() + "\n" + mit, "en"),
        (6, p.TEMPLATES["CC-BY-NC-4.0"].upper() + "\n" + mit, "en"),
        (None, mit, None),
        (7, "Licensed under CC BY 4.0", "en"),
    ]
    got = [(r.doc_id, [x.license for x in r.licenses]) for r in p.scan(documents(rows)).collect()]
    assert got[0] == (1, ["MIT"]) and got[1] == (2, ["GPL-3.0-notice"]) and got[7] == (None, ["MIT"])
    assert got[2:5] == [(3, []), (4, []), (5, [])] and got[5] == got[6] == (6, ["CC-BY-NC-4.0", "MIT"]) and got[8] == (7, ["CC-BY-4.0"])
    assert p.scan(documents([])).count() == 0


def test_runs_lose_no_place():
    """Every run of the text that reaches the coverage is found, or lies in a run that is."""
    rng = random.Random(3)
    known = p.Templates({"t": "a b c d e f g h"})
    template = known.codes[0]
    for _ in range(300):
        words = [rng.choice("abcdefghxyz").encode() for _ in range(30)]
        codes = [known.number.get(w, 0) for w in words]
        exact = [i for i in range(30) if len(p.align(codes[i : i + 12], template)) >= 7]
        assert bool(exact) <= bool(p.found_in(words, known)), words


def test_neighbours_are_told_apart(spark, documents):
    gpl = (p.__file__.rsplit("/", 1)[0]) + "/licenses/GPL-3.0.txt"
    with open(gpl) as f:
        full = f.read()
    said = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 7.": [],
        "Licensed under the GNU Library General Public License, version 2.": ["LGPL-2.0"],
        "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"],
        "Licensed under CC BY 3.0.": ["CC-BY-3.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        "Released under the BSD 3-Clause License.": ["BSD-3-Clause"],
        "Distributed under the Mozilla Public License, version 2.0.": ["MPL-2.0"],
        "Released under the ISC License.": ["ISC"],
        "Licensed under the CC0 1.0.": ["CC0-1.0"],
        "Licensed under the CC0 1.0 Universal Public Domain Dedication": ["CC0-1.0"],
        "Released under the MIT No Attribution License.": ["MIT-0"],
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    }
    rows = [(i, f"Some words before. {t} Some words after it.", "en") for i, t in enumerate(said)]
    affero = full.replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General", "GNU Affero General").replace("29 June", "19 November")
    rows += [(100, "word " * 300 + full + " word" * 300, "en"), (101, affero, "en")]
    got = {r.doc_id: [x.license for x in r.licenses] for r in p.scan(documents(rows)).collect()}
    assert {t: got[i] for i, t in enumerate(said)} == said
    assert got[100] == ["GPL-3.0"] and "GPL-3.0" not in got[101] and "AGPL-3.0" in got[101]
    texts = dict(reversed([(n, t) for n, t in p.forms() if len(t) > 600]))
    rare = texts["ISC"].replace("appear in all copies", "appear in copies"), texts["BSD-3-Clause"].replace("contributors may", "helpers may")
    assert [[known.names[t] for t, *_ in p.found_in(p.split_words(x), known)] for x in rare] == [["ISC"], ["BSD-3-Clause"]]
    for name, text in p.forms():
        assert name in [known.names[t] for t, *_ in p.found_in(p.split_words(text), known)], text[:80]


known = p.Templates(p.TEMPLATES, p.forms())


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert p.longest_common(a, p.word_masks(b), len(b)) == longest_common_plain(a, b)


def every_place(words, known, coverage, slack):
    """Places found by aligning at every start, none passed over."""
    hopeless, p._hopeless = p._hopeless, lambda *args: 1
    try:
        return p.found_in(words, known, coverage, slack)
    finally:
        p._hopeless = hopeless


def test_passing_over_loses_no_place():
    rng = random.Random(6)
    small = p.Templates({"t": "a b c d e f g h", "u": "a c e g b d f h i j k l m n o p"})
    for _ in range(400):
        words = [rng.choice("abcdefghijklmnopxyz").encode() for _ in range(rng.randint(0, 80))]
        for template in ("abcdefgh", "acegbdfhijklmnop"):
            at = rng.randint(0, len(words))
            words[at:at] = [c.encode() for c in template if rng.random() < 0.93]
        assert p.found_in(words, small, 0.8, 1.4) == every_place(words, small, 0.8, 1.4)


def test_a_near_miss_is_not_aligned_at_every_word(monkeypatch):
    """The words of a long license, its blocks out of order: the bags fit everywhere, the order nowhere."""
    full = dict(reversed([(n, t) for n, t in p.forms() if len(t) > 20_000]))["GPL-3.0"]
    words = p.split_words(full)
    blocks = [words[i : i + 40] for i in range(0, len(words), 40)]
    random.Random(1).shuffle(blocks)
    shuffled = [w for b in blocks for w in b]
    calls, align = [], p.align
    monkeypatch.setattr(p, "align", lambda a, b: calls.append(len(a) + len(b)) or align(a, b))
    found = p.found_in(shuffled * 2, known)
    assert not [x for x in found if len(known.codes[x[0]]) > 2000]
    assert sum(calls) < 60 * len(shuffled)
    calls.clear()
    assert "GPL-3.0" in [known.names[x[0]] for x in p.found_in(shuffled + words, known)]
