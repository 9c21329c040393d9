import json
import random
import re

import pytest

from loomline.llm import license_scan as S
from loomline.llm.queries import op9_license_scan


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_query_finds_every_planted_notice(spark, sf, documents):
    got = {r["doc_id"]: r["license"] for r in op9_license_scan(spark, sf).collect()}
    assert len(got) == documents.count()
    notices = {"Released under the MIT License.": "MIT-notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice"}
    some = 0
    for r in documents.collect():
        held = [n for t, n in notices.items() if t in (r["text"] or "")]
        some += bool(held)
        assert got[r["doc_id"]] in held if held else got[r["doc_id"]] is None
    assert some


def test_alignment_is_common_and_increasing():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = S.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= subsequence(a, b)
        assert S.align(a, a) == [(i, i) for i in range(len(a))]
    assert S.longest_increasing([5, 1, 4, 2, 3, 0, 6]) == [1, 3, 4, 6]


def test_full_texts_and_changes():
    rng = random.Random(6)
    scan = S.Scanner(S.TEMPLATES, S.COVERAGE).scan
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", "software", "license", "any", "word", "copy", "with"]) for _ in range(n))
    for name, t in S.TEMPLATES.items():
        for before, after in ((0, 0), (50, 50), (3000, 10)):
            found = {f[0]: f[1] for f in scan(f"{noise(before)} {t} {noise(after)}")}
            assert found[name] == 1.0
        w = t.split()
        if len(w) > 20:
            w[len(w) // 2] = "changed"
            del w[5]
            found = {f[0]: f[1] for f in scan(f"{noise(30)} {' '.join(w)} {noise(30)}")}
            assert found[name] >= 0.85
    assert scan(noise(2000)) == []


def best(text):
    lengths = {k: len(S.words(t)) for k, t in S.TEMPLATES.items()}
    return min(S.Scanner(S.TEMPLATES, S.COVERAGE).scan(text), key=lambda f: (-f[1], -lengths[f[0]], f[0]), default=(None,))[0]


def test_near_misses_and_prose():
    for text, want in {
        "Released under the BSD License.": "BSD-notice",
        "Released under the MIT-0 License.": "MIT-0-notice",
        "Licensed under CC BY 4.0.": "CC-BY-4.0-short-notice",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0-notice",
        "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0-notice",
        "Licensed under CC BY-NC 2.5.": None,
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-long-notice",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0-notice",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1-notice",
        "Licensed under the Apache License, Version 1.0.": None,
        S.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"): "GPL-2.0",
        S._BSD + S._BINARY: "BSD-2-Clause",
        S._BSD + S._BINARY + S._ENDORSE.replace("of the nor", "of the Example Foundation nor"): "BSD-3-Clause",
        "The film was released under the new license of its studio.": None,
        "Shops are licensed under the local rules, and this work is licensed under the old code, version 3.": None,
        "Not CC BY-NC-SA 4.0 but another one. Licensed under CC BY-NC 4.0. So it says.": "CC-BY-NC-4.0-notice",
    }.items():
        assert best(f"Some words before it. {text} And some after it.") == want, text


def test_text_put_into_a_license_does_not_hide_it():
    rng = random.Random(7)
    scan = S.Scanner(S.TEMPLATES, S.COVERAGE).scan
    w = S._MIT.split()
    for n in (10, 150, 300, 3000):
        middle = [f"n{rng.randrange(10**6)}" for _ in range(n)]
        assert {f[0]: f[1] for f in scan(" ".join(w[:25] + middle + w[25:]))}["MIT"] == 1.0


def test_coverage_against_brute_force():
    """Coverage is close to the longest common subsequence's share, and never above it, for texts with words put in, changed and left out."""
    rng = random.Random(5)
    scanner = S.Scanner(S.TEMPLATES, S.COVERAGE)
    names = [n for n in S.TEMPLATES if n.endswith("-text") or n in ("Zlib", "Unlicense", "BSL-1.0", "PostgreSQL", "OFL-1.1")]
    worst, told = 0.0, 0
    for turn in range(60):
        name = rng.choice(names)
        t = S.words(S.TEMPLATES[name])
        marked = {i for m in scanner.marks[[n for n, _ in scanner.templates].index(name)] for s in m for i in s}
        text = [f"n{rng.randrange(300)}" for _ in range(rng.randrange(40))]
        for i, x in enumerate(t):
            r = rng.random() if i not in marked else 1
            text += [] if r < 0.03 else [f"c{rng.randrange(99)}"] if r < 0.05 else [x, f"i{rng.randrange(99)}"] if r < 0.08 else [x]
        text += [f"n{rng.randrange(300)}" for _ in range(rng.randrange(40))]
        want = subsequence(text, t) / len(t)
        got = {f[0]: f[1] for f in scanner.scan(" ".join(text))}
        assert name in got and got[name] <= want + 1e-9
        worst, told = max(worst, want - got[name]), told + 1
    assert told == 60 and worst < 0.06


def test_one_name_for_one_license():
    scan = S.Scanner(S.TEMPLATES, S.COVERAGE).scan
    for name in ("MIT-text", "MIT-0-text", "ISC-text", "0BSD-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-3.0-text", "LGPL-2.1-text", "Apache-2.0"):
        assert [f[0] for f in scan(S.TEMPLATES[name])] == [name]


def test_edges(spark, odd_docs, no_docs):
    rows = S.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["license"] is None and r["coverage"] == 0 for r in rows)
    assert S.scan_licenses(no_docs).count() == 0


def plain_alignment(a, b):
    """Numbers of pairs and of anchors by recursion over lists, with a longest increasing subsequence of quadratic cost."""
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if once:
        size, before = [1] * len(once), [None] * len(once)
        for i in range(len(once)):
            for j in range(i):
                if once[j][1] < once[i][1] and size[j] + 1 > size[i]:
                    size[i], before[i] = size[j] + 1, j
        i, kept = size.index(max(size)), []
        while i is not None:
            kept.append(once[i])
            i = before[i]
        edges = [(-1, -1), *kept[::-1], (len(a), len(b))]
        inner = [plain_alignment(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:])]
        return len(kept) + sum(n for n, _ in inner), len(kept) + sum(m for _, m in inner)
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    more, anchored = plain_alignment(a, b) if n and a and b else (0, 0)
    return n + more, anchored


def test_alignment_against_plain_recursion():
    """Equal where the longest subsequence of anchors is the only one, as in texts whose words keep their order."""
    rng = random.Random(12)
    for _ in range(400):
        b = [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(30))]
        a = [y for x in b for y in ([] if rng.random() < 0.2 else [x, f"n{rng.randrange(9)}"] if rng.random() < 0.2 else [x])]
        pairs, anchors = S.patience(a, b)
        assert (len(pairs), anchors) == plain_alignment(a, b)


def marked_subsequence(text, t, phrases):
    """The longest common subsequence of which every phrase of the template is a part, in one piece in the text as well; 0 if there is none."""
    spots = {i: len(p) for p in phrases for i in range(len(t)) if t[i : i + len(p)] == p}
    inside = {i + k for i, n in spots.items() for k in range(n)}
    best = [[0] * (len(t) + 1) for _ in range(len(text) + 1)]
    for i in range(len(text) - 1, -1, -1):
        for j in range(len(t) - 1, -1, -1):
            x = max(best[i + 1][j], best[i][j + 1])
            if j in spots and text[i : i + spots[j]] == t[j : j + spots[j]]:
                x = max(x, best[i + spots[j]][j + spots[j]] + spots[j] + 1000)
            elif j not in inside and text[i] == t[j]:
                x = max(x, best[i + 1][j + 1] + 1)
            best[i][j] = x
    return best[0][0] - 1000 * len(spots) if best[0][0] >= 1000 * len(spots) else 0


def test_query_against_exact_subsequences(spark, sf, documents):
    """A notice is found where one sentence has a common subsequence that covers it and holds its phrases, and nowhere else."""
    got = {r["doc_id"]: json.loads(r["found"]) for r in op9_license_scan(spark, sf).collect()}
    notices = {n: (S.words(t), [S.words(p) for p in S.MARKS[n]]) for n, t in S.TEMPLATES.items() if len(S.words(t)) <= S.NOTICE and n in S.MARKS}
    texts = {n: S.words(t) for n, t in S.TEMPLATES.items() if len(S.words(t)) > S.NOTICE}
    some = 0
    for r in documents.collect():
        want = set()
        for sentence in re.split(r"(?<=[.!?])\s+|\n\s*\n", r["text"] or ""):
            w = S.words(sentence)
            for name, (t, phrases) in notices.items():
                if set(sum(phrases, [])) <= set(w) and marked_subsequence(w, t, phrases) >= S.COVERAGE * len(t):
                    want.add(name)
        assert {f["license"] for f in got[r["doc_id"]]} == want
        assert all(f["anchors"] > 0 and f["coverage"] >= S.COVERAGE for f in got[r["doc_id"]])
        some += len(want)
        w = S.words(r["text"] or "")
        for name, t in texts.items():
            if sum(x in set(w) for x in t) >= S.COVERAGE * len(t):
                assert subsequence(w, t) < S.COVERAGE * len(t)
    assert some


def test_no_find_without_anchors_in_order():
    """Texts that hold every word and every phrase of a license, but not in its order, and texts of which no word may anchor."""
    scan = S.Scanner(S.TEMPLATES, S.COVERAGE).scan
    shuffled = "Version 3 it is, the General Public one: see GNU General Public License for what under means"
    assert all(f" {p} " in f" {' '.join(S.words(shuffled))} " for p in ("gnu general public license", "version 3"))
    assert scan(shuffled) == []
    assert scan("The MIT License is what it isn't under") == []
    assert scan("It was under way. The book on the MIT License is out") == []  # a notice lies in one sentence
    text = f"Some words. {S.TEMPLATES['GPL-3.0-text']} Released under the MIT License."
    found = {f[0]: f[4] for f in scan(text)}
    assert found["MIT-notice"] >= 2 and found["GPL-3.0-text"] > 20
    assert S.Scanner({"none": "so so far far so far"}, S.COVERAGE, {}).scan("so so far far so far") == []


@pytest.mark.parametrize("text", ["", " \n\n ", "...", "One two. Three!  Four\n\nfive 2.0 six", "a\n \n\n. b?"])
def test_sentences(text):
    cuts = S.sentences(text)
    assert cuts[0] == 0 and cuts[-1] == len(S.words(text)) and sorted(set(cuts)) == cuts
    if "Three" in text:
        assert cuts == [0, 2, 3, 4, 8]
