"""Licences that differ in a word or a version number are told apart, and every span is found."""

import pytest
from brevier.llm import license_scan


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"),
        ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc,cc-by-nc-nd"),
        ("Licensd under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensd undr CC BY-NC 4.0.", "cc-by-nc"),
        ("Mozilla Public License, version 1.1", "mpl-1-1"),
        ("Mozilla Public License, version 2.0", "mpl-2"),
        ("Mozila Public Licence, version 2.0", "mpl-2"),
        ("Licensed under the Apache License, Version 1.1", ""),
        ("Licensed under the Apache Licence, Version 2.0", "apache-2"),
        ("released under the MPL license", ""),
        ("relesed under the MIT licence", "mit"),
    ],
)
def test_rivals_keep_their_labels(text, labels):
    assert license_scan.scan(f"Words before. {text} Words after.")[5] == labels


def test_words_of_a_notice_stand_in_it_once():
    for phrase, _, words in license_scan.RULES:
        assert not words or f" {phrase} ".count(f" {words} ") == 1


def test_every_span_of_a_window():
    spans = lambda text: license_scan.scan(text)[7]
    assert spans("Released undr the MIT license and released under the MIT license") == "mit:0:4:1,mit:6:10:0"
    assert spans("released under the MIT license and Released undr the MIT license") == "mit:0:4:0,mit:6:10:1"
    assert spans("relased under the MIT license, released under the MIT license, released under the MIT licence") == "mit:0:4:1,mit:5:9:0,mit:10:14:1"
