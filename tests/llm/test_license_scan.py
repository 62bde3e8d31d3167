import random
import time

import pytest

from foliomill.llm import license_scan as ls
from foliomill.llm import queries


def names(text):
    return [name for name, *_ in ls.licenses_of(text)]


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_every_template_is_found_in_a_text(name):
    text = "Some words the reader may skip.\n" + ls.TEMPLATES[name].upper().replace(" ", "  ") + "\nAnd the end of it."
    found = ls.licenses_of(text)
    assert [f[0] for f in found] == [name] and found[0][3] > 0.9
    assert WORDS(text[found[0][1]:found[0][2]]) == WORDS(ls.TEMPLATES[name])


def WORDS(text):
    return ls.WORD.findall(text.lower())


def test_near_notices_and_others():
    changed = ls.TEMPLATES["MIT"].replace("Software", "Library", 2).replace("hereby ", "")
    assert names(changed) == ["MIT"]
    assert names("The license of the public is general. Under the sun, version 3 of the work.") == []
    assert names("Released under the MIT License. Released under the MIT License.") == ["MIT-notice"] * 2
    assert names("x " * 200_000 + ls.TEMPLATES["ISC"]) == ["ISC"]


@pytest.mark.parametrize("text", [None, "", " ", "the", "the the the " * 1000])
def test_texts_without_licence(text):
    assert ls.licenses_of(text) == []


def test_size_bounds_lose_nothing():
    # Dice reaches d only if the sizes are within the bounds; a size on the bound is inside.
    checked = 0
    for name, counts in ls._BIGRAMS.items():
        words = WORDS(ls.TEMPLATES[name])
        for n in range(2, len(words) * 2, max(1, len(words) // 10)):
            other = ls.bigrams((words * 2)[:n])
            if ls.dice(other, counts) >= ls.THRESHOLD:
                low, high = ls.bounds(counts.total(), ls.THRESHOLD)
                assert low <= other.total() <= high
                checked += 1
    assert checked


def test_query_finds_the_corpus_notices(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = sum(texts[row.doc_id].count(t) for n, t in ls.TEMPLATES.items() if n.endswith("-notice"))
        assert row.n_licenses >= min(1, wanted) and (wanted or row.n_licenses == 0)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "Released under the MIT License.", 3)], "doc_id long, text string, dice int")
    out = docs.select("doc_id", ls.licenses(docs["text"]).alias("found")).collect()
    assert sorted((str(r.doc_id), [f.license for f in r.found]) for r in out) == [("1", []), ("1", []), ("2", ["MIT"]), ("None", [])]
    assert docs.limit(0).select(ls.licenses(docs["text"])).count() == 0


def every_window(text, threshold):
    """Brute force: all windows of a text with all templates, the best ones that do not overlap."""
    matches = list(ls.WORD.finditer(text.lower()))
    words, found = [m.group() for m in matches], []
    pairs = ls.bigrams(words)
    for name, counts in ls._WORDINGS:
        most = (pairs & counts).total()
        if 2 * most < threshold * (most + counts.total()):  # not even with all common bigrams side by side
            continue
        for at in range(len(words) - 1):
            window, common = {}, 0
            for to in range(at, len(words) - 1):
                pair = (words[to], words[to + 1])
                window[pair] = window.get(pair, 0) + 1
                common += window[pair] <= counts[pair]
                value = 2 * common / (to - at + 1 + counts.total())
                if value >= threshold:
                    found.append((ls.rank(name), -value, at - to, at, name, to))
    kept = []
    for _, value, _, at, name, to in sorted(found):
        if all(to + 1 < other[1] or at > other[2] + 1 for other in kept):
            kept.append((name, at, to, round(-value, 6)))
    return sorted(((name, matches[at].start(), matches[to + 1].end(), value) for name, at, to, value in kept), key=lambda f: f[1])


def test_same_as_brute_force_over_all_windows_with_inserted_words():
    rng = random.Random(6)
    names_ = ["ISC", "MIT-notice", "GPL-3.0-notice", "CC-BY-4.0-notice", "GPL-3.0-or-later"]
    found = 0
    for _ in range(10):
        words = []
        for name in rng.choices(names_, k=2):
            part = WORDS(ls.TEMPLATES[name])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at:at + rng.randrange(3)] = rng.choices(["the", "license", "of", "other", "new"], k=rng.randrange(9))
            words += part + ["x"] * rng.randrange(3)
        text = " ".join(words)
        for threshold in (ls.THRESHOLD, 0.6):
            wanted = every_window(text, threshold)
            assert ls.licenses_of(text, threshold) == wanted
            found += len(wanted)
    assert found > 15


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0-or-later"])
@pytest.mark.parametrize("added", [4, 5, 6, 8, 12])
def test_words_inserted_in_the_middle(name, added):
    words = WORDS(ls.TEMPLATES[name])
    middle = len(words) // 2
    changed = " ".join(words[:middle] + [f"added{i}" for i in range(added)] + words[middle:])
    assert ls.dice(ls.bigrams(changed.split()), ls._BIGRAMS[name]) > ls.THRESHOLD
    assert names(changed) == [name]


def test_common_variant_of_mit():
    changed = ls.TEMPLATES["MIT"].replace("this permission notice shall", "this permission notice (including the next paragraph) shall")
    assert [(f[0], f[3] > 0.97) for f in ls.licenses_of(changed)] == [("MIT", True)]


@pytest.mark.parametrize("text, name", [
    ("This project is licensed under the MIT License - see the file.", "MIT-notice"),
    ("Code is available under the terms of the MIT license.", "MIT-notice"),
    ("Licensed under the Apache License 2.0", "Apache-2.0-notice"),
    ("It is distributed under the Apache 2.0 license", "Apache-2.0-notice"),
    ("Released under the 3-Clause BSD License.", "BSD-3-Clause-notice"),
    ("licensed under the GNU General Public License v2.0", "GPL-2.0-notice"),
    ("It is licensed under GPLv3.", "GPL-3.0-notice"),
    ("Published under the Mozilla Public License 2.0.", "MPL-2.0-notice"),
    ("Text is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License;", "CC-BY-SA-3.0-notice"),
    ("This is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0-notice"),
    ("Provided under CC0 1.0.", "CC0-1.0-notice"),
    ("Released under the Unlicense.", "Unlicense-notice"),
])
def test_usual_wordings_of_notices(text, name):
    assert names(text) == [name]


@pytest.mark.parametrize("name, old, new", [
    ("BSD-3-Clause", "the copyright holder", "Example Corporation"), ("BSD-2-Clause", "SOFTWARE", "LIBRARY"), ("MPL-2.0-text", "Contributor", "Author"),
    ("Unlicense", "software", "program"), ("GPL-2.0-text", "Program", "Work"), ("LGPL-2.1-text", "Library", "Package"),
    ("CC0-1.0-text", "Affirmer", "Giver"), ("Apache-2.0-text", "Work", "Thing"), ("AGPL-3.0-text", "patent", "claim"),
    ("LGPL-2.1-or-later", "library", "package"),
])
def test_bodies_with_other_words(name, old, new):
    changed = ls.TEMPLATES[name].replace(old, new)
    assert changed != ls.TEMPLATES[name] and name in names("Before it. " + changed + " After it.")


@pytest.mark.parametrize("path", sorted(ls.license_texts.FOLDER.glob("*.txt")), ids=lambda path: path.stem)
def test_every_published_text_is_one_licence(path):
    found = ls.licenses_of(path.read_text("utf-8", "replace"))
    assert [ls.spdx(f[0]) for f in found] == [(path.stem, "text")]


@pytest.mark.parametrize("name", ls.license_texts.TAGGED)
def test_tags(name):
    for tag in ls.license_texts._tags(name):
        assert [ls.spdx(n) for n in names(f"// SPDX-License-Identifier: {tag}\nint main() {{")] == [(name, "notice")]


def test_short_notices():
    assert names("This project is MIT licensed.") == names("It is MIT-licensed") == ["MIT-notice"]
    assert names("The code is Apache 2.0 licensed") == ["Apache-2.0-notice"]


@pytest.mark.parametrize("name, copies", [("MIT", 400), ("GPL-3.0-text", 16)])
def test_many_copies_take_linear_time(name, copies):
    text = f"{ls.TEMPLATES[name]}\n\nsome other words\n" * copies
    started = time.monotonic()
    assert names(text) == [name] * copies
    assert time.monotonic() - started < 10


def test_copies_side_by_side_agree_with_brute_force():
    rng = random.Random(8)
    for _ in range(6):
        parts = [WORDS(ls.TEMPLATES[rng.choice(["ISC", "MIT-notice", "MPL-2.0-header"])]) for _ in range(4)]
        words = [w for part in parts for w in part[rng.randrange(3):len(part) - rng.randrange(3)] + ["x"] * rng.choice([0, 0, 2])]
        text = " ".join(words)
        for threshold in (ls.THRESHOLD, 0.6):
            assert ls.licenses_of(text, threshold) == every_window(text, threshold)


def test_query_agrees_with_brute_force_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_license_scan"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = every_window(texts[row.doc_id] or "", ls.THRESHOLD)
        assert row.n_licenses == len(wanted)
        assert row.spans == ",".join(f"{ls.spdx(n)[0]}:{s}:{e}" for n, s, e, _ in wanted)
