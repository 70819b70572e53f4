"""License scans: notices anywhere in a line, brute force over all starts and templates, long lines, defined cases."""

import random
import time

from evispark.llm import licenses

WORDS = "some plain words about weather and music that permit nothing license free software public here 2 the".split()


def names(scanner, text):
    return [x["license"] for x in scanner.scan(text)]


def test_notices_anywhere_in_a_line():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT-notice"]
    cases = {
        "Some words.\nReleased under the MIT License.\nMore words.": ["MIT"],
        "a b c. Licensed under CC BY-NC 4.0. d e f": ["CC-BY-NC-4.0"],
        "Except where otherwise noted, content on this site is licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "This file is part of a long-named library by its many contributors and is released under the MIT License.": ["MIT"],
        "Who? What! Here: licensed under CC BY-SA 4.0. More": ["CC-BY-SA-4.0"],
        "x\n" + mit.replace("sell", "vend") + "\ny": ["MIT-notice"],
        " * " + licenses.TEMPLATES["Apache-2.0-notice"].replace(". ", ".\n * "): ["Apache-2.0-notice"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "Licensed under CC BY 3.0.": [],
        "Licensed under the Apache License, Version 1.1.": [],
        "They licensed the song to a studio; permission is rarely given.": [],
        "Released under the MIT License. Licensed under CC BY 4.0. Released under the MIT License.": ["MIT", "CC-BY-4.0", "MIT"],
    }
    assert {t: names(scanner, t) for t in cases} == cases
    hit = scanner.scan("Some words.\nReleased under the MIT License.\nMore words.")[0]
    assert (hit["start"], hit["end"], hit["differing"]) == (12, 42, 0)
    assert scanner.scan(None) == scanner.scan("") == []


def test_every_template_is_found_as_itself():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert names(scanner, f"begin words here {text} and the end") == [name]


def edits(want, have):
    """Fewest edits from want to any passage of have, one cell at a time."""
    row = [0] * (len(have) + 1)
    for i, w in enumerate(want, 1):
        new = [i]
        for j, h in enumerate(have, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != h)))
        row = new
    return min(row)


def test_scan_equals_brute_force_over_starts_and_templates():
    """A template is found exactly if some passage of the text has its words, all but a tenth, as far as no telling word differs."""
    rng = random.Random(3)
    short = {n: licenses.TEMPLATES[n] for n in ("MIT", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "Apache-2.0", "MPL-2.0", "ISC")}
    scanner = licenses.LicenseScanner(short)
    seen = 0
    for _ in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 30))
        name = rng.choice(list(short))
        notice = short[name].split()
        if rng.random() < 0.4:
            notice[rng.randrange(len(notice))] = rng.choice(WORDS)
        if rng.random() < 0.8:
            words += notice + rng.choices(WORDS, k=rng.randint(0, 30))
        text = " ".join(words)
        have = [w for w, _, _ in licenses._words(text)]
        within = {n for n, t in short.items() if edits(scanner.words[n], have) <= len(scanner.words[n]) // 10}
        exact = {n for n in within if edits(scanner.words[n], have) == 0}
        got = {x["license"] for x in scanner.scan(text)}
        assert exact <= got <= within
        seen += bool(got)
    assert seen > 40


def test_fit_words_equals_a_plain_programme():
    rng = random.Random(5)
    for _ in range(300):
        want, have = rng.choices("abcd", k=rng.randint(1, 6)), rng.choices("abcd", k=rng.randint(0, 12))
        differ, first, last, words = licenses.fit_words(want, have)
        assert differ == edits(want, have) and (differ == 0) == (not words)
        if differ == 0:
            assert have[first:last] == want


def test_time_is_linear_in_long_lines():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES)
    text = " ".join(random.Random(1).choices(WORDS[:11], k=40_000)) + " "
    spent = []
    for times in (1, 4):
        began = time.perf_counter()
        scanner.scan(text * times)
        spent.append(time.perf_counter() - began)
    assert len(text) * 4 > 1_000_000 and spent[1] < 10 * spent[0] + 1


def test_tables(spark):
    schema = "doc_id long, text string, licenses string, start int"
    rows = [(1, "Released under the MIT License.", "x", 1), (1, "Released under the MIT License.", "x", 1), (2, None, "y", 2), (None, "nothing", None, None)]
    found = licenses.find_licenses(spark.createDataFrame(rows, schema), keep=["doc_id", "licenses", "start"])
    assert found.columns == ["doc_id", "start", "licenses"]
    assert sorted((r.doc_id or 0, [x.license for x in r.licenses]) for r in found.collect()) == [(0, []), (1, ["MIT"]), (1, ["MIT"]), (2, [])]
    assert licenses.find_licenses(spark.createDataFrame([], schema)).count() == 0
    only = licenses.find_licenses(spark.createDataFrame(rows, schema), templates={})
    assert all(r.licenses == [] for r in only.collect())
