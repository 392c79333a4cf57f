import random

import pytest

from riskweave.llm import license_scan as L
from riskweave.llm.license_texts import TEMPLATES

from .conftest import TEXTS


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(TEMPLATES)


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_among_prose(scanner, name):
    rng = random.Random(name)
    prose = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(5))
                             for _ in range(300))
    notice = TEMPLATES[name].replace(L.WILD, "Jane Roe 2021")
    text = f"{prose()}\n{notice}\n{prose()}"
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    assert [(f.license, f.exact) for f in found] == [(name, True)]


def line_of_prose(rng, size):
    # common words, some of them the templates'
    words = "the of and to software in use is a notice for work this all rights file by any".split()
    text = ""
    while len(text) < size:
        text += rng.choice(words) + " "
    return text


@pytest.mark.parametrize("size", [200, 600, 1200, 2000, 5000])
@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_inside_a_long_line(scanner, name, size):
    rng = random.Random(f"{name} {size}")
    notice = TEMPLATES[name].replace(L.WILD, "Jane Roe 2021")
    text = f"{line_of_prose(rng, size // 2)}{notice} {line_of_prose(rng, size // 2)}"
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    assert [(f.license, f.exact) for f in found] == [(name, True)]


@pytest.mark.parametrize("name", ["MIT-text", "BSD-2-Clause", "GPL-3.0-notice", "ISC"])
def test_a_changed_notice_is_found_inside_a_long_line(scanner, name):
    rng = random.Random(name)
    words = TEMPLATES[name].split()
    words[len(words) // 2] = "zebra"
    text = f"{line_of_prose(rng, 900)}{' '.join(words)} {line_of_prose(rng, 900)}"
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    assert [(f.license, f.exact) for f in found] == [(name, False)]
    assert [d[1] for d in found[0].differences] == ["zebra"]


LONG_ONES = ("Apache-2.0-header", "MIT-text", "BSD-2-Clause", "ISC", "GPL-3.0-notice", "MPL-2.0")


def exact_notices(scanner, text):
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    return [(f.license, f.exact) for f in found]


@pytest.mark.parametrize("joined", [" ", "\n", "\n\n"])
def test_many_long_notices_in_a_row(scanner, joined):
    names = LONG_ONES * 5
    found = exact_notices(scanner, joined.join(TEMPLATES[n] for n in names))
    assert sorted(found) == sorted((n, True) for n in names)


@pytest.mark.parametrize("name", ["BSD-2-Clause", "Apache-2.0-header", "MIT-text", "GPL-3.0"])
def test_a_notice_slides_over_the_cuts(scanner, name):
    rng = random.Random(name)
    # a stray cue before it; a step shorter than the notice, beyond three cuts
    for size in range(0, 9000, 50):
        text = f"copyright {line_of_prose(rng, size)}{TEMPLATES[name]} {line_of_prose(rng, 3000)}"
        assert exact_notices(scanner, text) == [(name, True)], size


def test_a_notice_among_cues_slides_over_the_cuts(scanner):
    for size in range(0, 700, 7):
        text = "license " * size + TEMPLATES["BSD-2-Clause"] + " license" * 400
        assert exact_notices(scanner, text) == [("BSD-2-Clause", True)], size


def test_a_notice_in_short_lines_after_many_familiar_ones(scanner):
    for n in range(0, 240, 3):
        text = "the license of this software\n" * n + TEMPLATES["BSD-2-Clause"].replace(
            ": ", ":\n").replace(". 2", ".\n2") + "\nthe license of this software" * 40
        assert exact_notices(scanner, text) == [("BSD-2-Clause", True)], n


def test_no_word_is_cut(scanner):
    for size in range(0, 40):
        text = "license" + "x" * size + " unlicensed" * 2000
        for a, b in scanner.blocks(text):
            assert {w for w in L.words_of(text[a:b]) if not w.startswith("licensex")} <= {
                "unlicensed", "license"}
            assert a == 0 or not (text[a - 1].isalnum() and text[a].isalnum())


def test_blocks_are_disjoint_and_go_on(scanner):
    text = "license " * 5000 + "\n" + "license of the software\n" * 3000
    last = 0
    for a, b in scanner.blocks(text):
        assert last <= a < b
        last = b
    assert last == len(text) or "licens" not in text[last:]


def test_strewn_words_are_no_notice(scanner):
    rng = random.Random(1)
    text = " ".join(f"{w} {line_of_prose(rng, 200)}"
                    for w in "released under the mit license".split())
    assert all(not scanner.findings(text[a:b]) for a, b in scanner.blocks(text))


def test_wrapped_lines(scanner):
    words = TEMPLATES["MIT-text"].split()
    text = "intro\n" + "\n".join(" ".join(words[i:i + 8]) for i in range(0, len(words), 8))
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    assert [(f.license, f.exact) for f in found] == [("MIT-text", True)]


def test_changed_wording_is_reported(scanner):
    text = TEMPLATES["MIT-text"].replace("free of charge", "for a fee")
    found, = scanner.findings(text)
    assert (found.license, found.exact) == ("MIT-text", False)
    assert found.differences == (("free of charge", "for a fee"),)


def test_similar_licenses_are_told_apart(scanner):
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0"):
        assert [f.license for f in scanner.findings(TEMPLATES[name])] == [name]


def test_compression_ranks_the_right_template_first(scanner):
    for name, text in TEMPLATES.items():
        assert scanner.rank(text.replace(L.WILD, " "))[0][1] == name


def test_two_notices_in_a_block(scanner):
    text = f"{TEMPLATES['MIT']} {TEMPLATES['CC-BY-NC-4.0']}"
    assert {f.license for f in scanner.findings(text)} == {"MIT", "CC-BY-NC-4.0"}


def test_a_text_of_cues_only(scanner):
    text = "license " * 50_000
    assert all(not scanner.findings(text[a:b]) for a, b in scanner.blocks(text))


def test_a_template_without_cue_is_refused():
    with pytest.raises(ValueError):
        L.Scanner({"x": "do as you like"})


def test_documents(documents, texts, edge_docs, no_docs):
    found = {r["doc_id"]: r for r in L.scan(documents).collect()}
    for i, text in texts:
        flat = " ".join(L.words_of(text or ""))
        planted = sorted(n for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0")
                         if " ".join(L.words_of(TEMPLATES[n])) in flat)
        assert found[i]["licenses"] == planted and found[i]["modified"] == []
    odd = L.scan(edge_docs).collect()
    assert len(odd) == len(TEXTS) and not any(r["n_blocks"] for r in odd)
    assert L.scan(no_docs).collect() == []


def test_savings_choose_the_notices(monkeypatch):
    blocks = [TEMPLATES["GPL-3.0-notice"], TEMPLATES["MIT"], TEMPLATES["BSD-2-Clause"]]
    found = [[f.license for f in L.Scanner(TEMPLATES).findings(b)] for b in blocks]
    assert found == [["GPL-3.0-notice"], ["MIT"], ["BSD-2-Clause"]]
    monkeypatch.setattr(L, "MIN_SAVING", 1.1)
    assert all(not L.Scanner(TEMPLATES).findings(b) for b in blocks)


def test_a_whole_text_wins_over_its_beginning(scanner):
    # with one word changed behind the part that is a notice of its own
    for name, part in (("MIT-full", "MIT-text"), ("ISC-full", "ISC")):
        assert TEMPLATES[name].startswith(TEMPLATES[part])
        found, = scanner.findings(TEMPLATES[name].replace("NO EVENT", "NO CASE"))
        assert (found.license, found.exact) == (name, False)
        assert found.differences == (("event", "case"),)


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_paragraphs_with_blank_lines(scanner, mark):
    words = TEMPLATES["MIT-full"].split()
    lines = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
    lines[5:5] = [""]
    lines[12:12] = ["", ""]
    text = "\n".join(["intro of a file", *(mark + line for line in lines), "code = 1"])
    found = [f for a, b in scanner.blocks(text) for f in scanner.findings(text[a:b])]
    assert [(f.license, f.exact) for f in found] == [("MIT-full", True)]


def test_many_short_notices_in_a_line(scanner):
    names = ["CC-BY-4.0", "MIT", "Apache-2.0", "GPL-2.0", "CC-BY-NC-4.0"] * 60
    text = " ".join(TEMPLATES[n] for n in names)
    assert exact_notices(scanner, text) == [(n, True) for n in names]


def test_a_template_too_short_to_compress_is_refused():
    with pytest.raises(ValueError):
        L.Scanner({"x": "licensed"})


def test_savings_do_not_depend_on_the_words_around(scanner):
    rng = random.Random(5)
    for name, text in TEMPLATES.items():
        for _ in range(20):
            block = (f"{line_of_prose(rng, 300)}{text.replace(L.WILD, 'Jane Roe 2021')} "
                     f"{line_of_prose(rng, 300)}")
            saved = max((-c.lost for c in scanner.rank(block) if c.license == name), default=0)
            assert saved > 2 * L.MIN_SAVING * scanner.worth[name], name
